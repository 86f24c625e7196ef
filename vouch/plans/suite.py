"""Check suites: declare checks, compile them to Spark plans, score them.

Compilation (``Suite.results``):

1. checks are grouped by the table they run on;
2. each check's column is analysed against its table (no job); one that
   does not analyse becomes a failed result whose message is the error,
   the way an exception fails a check;
3. all ``rows``/``value`` checks of one table become ONE ``agg`` - one scan
   of the table however many checks - and the one-row result is turned
   into one row per check;
4. ``plan`` checks add their own one-row plans, ``fixed`` checks literal rows;
5. the union gets the dependency skips and the points.

Everything stays lazy until the caller acts on the returned DataFrame.
"""

from __future__ import annotations

from typing import Any, Iterable

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import values as V
from vouch.functions.text import render_hint
from vouch.operators import checks as C
from vouch.operators import compare as CMP
from vouch.operators.graph import status_columns

# The dependency of the first check, the text of a failed
# precondition, the default hint and the default description of a field check.
NO_PREVIOUS = "-n/a-"
PREREQ_TEXT = "Execute prerequisites."
FIELD_HINT = "Found [[ACTUAL_VALUE]]"
FIELD_DESCRIPTION = 'Schema contains "{name}" of type {type_class} (nullable={nullable})'

class Suite:
    """An ordered list of checks with ids, points and dependencies."""

    def __init__(self, name: str, spark: SparkSession | None = None) -> None:
        self.name = name
        self.checks: list[C.Check] = []
        self._ids: set[str] = set()
        self._next_number = 0
        self._spark = spark
        self._results: DataFrame | None = None

    # ------------------------------------------------------------------
    # registration
    # ------------------------------------------------------------------
    def add(self, check: C.Check, test_id: str | None, points: int, depends_on: Any, hint: str | None,
            escape_html: bool) -> "Suite":
        if not isinstance(check.description, str):
            raise TypeError(f"description must be str, found {type(check.description).__name__}")
        if test_id is None:  # running number per suite, skipping ids already taken
            self._next_number += 1
            while f"{self.name}-{self._next_number}" in self._ids:
                self._next_number += 1
            test_id = str(self._next_number)
        full = f"{self.name}-{test_id}"
        if full in self._ids:
            raise ValueError(f"Duplicate test case id: {full}")
        if isinstance(depends_on, (str, bytes)):
            depends_on = [depends_on]
        elif depends_on is not None:
            depends_on = list(depends_on)
        if not depends_on:
            depends_on = [self.checks[-1].full_id if self.checks else NO_PREVIOUS]
        check.suite, check.test_id, check.points = self.name, str(test_id), int(points)
        check.depends_on, check.hint, check.escape_html = depends_on, hint, escape_html
        check.seq = len(self.checks) + 1
        self.checks.append(check)
        self._ids.add(full)
        self._results = None
        return self

    def _spark_of(self) -> SparkSession:
        if self._spark is not None:
            return self._spark
        for c in self.checks:
            if c.target is not None:
                return c.target.sparkSession
        active = SparkSession.getActiveSession()
        if active is None:
            raise RuntimeError("no Spark session for this suite")
        return active

    @staticmethod
    def _with_operands(check: C.Check, *values: Any) -> C.Check:
        """Record Column operands so their types are resolved in one batch."""
        check.operands = [v for v in values if isinstance(v, Column)]
        check.aggregate_operands = check.kind == C.VALUE
        return check

    @staticmethod
    def _value_of(value: Any, per_row: bool):
        """The checked value itself, for the hint of a value-form check."""
        return None if per_row else (lambda _d: C._col(value))

    # Common keyword arguments of every check.
    def _reg(self, check: C.Check, kw: dict) -> "Suite":
        return self.add(check, kw.get("test_id"), kw.get("points", 1), kw.get("depends_on"), kw.get("hint"),
                        kw.get("escape_html", False))

    def _both_none(self, actual: Any, expected: Any, description: str, kw: dict) -> "Suite":
        same = actual is None and expected is None
        return self._reg(C.Check(description, C.FIXED, fixed_passed=same, fixed_actual="None" if actual is None else type(actual).__name__), kw)

    # E1 -------------------------------------------------------------
    def expect(self, df: DataFrame, pred: Column | str, description: str, **kw) -> "Suite":
        """Custom per-row predicate: passes when no row makes it FALSE or NULL."""
        return self._reg(C.Check(description, C.ROWS, df, C.predicate(pred)), kw)

    def expect_value(self, df: DataFrame, agg_pred: Column | str, description: str, *, actual: Column | None = None, **kw) -> "Suite":
        """Custom predicate on aggregates of the table (one value)."""
        act = (lambda _d: actual) if actual is not None else None
        return self._reg(C.Check(description, C.VALUE, df, C.predicate(agg_pred), actual=act), kw)

    # E2 -------------------------------------------------------------
    def expect_equals(self, df: DataFrame, actual: Column | Any, expected: Column | Any, description: str, *,
                      per_row: bool = False, **kw) -> "Suite":
        kind = C.ROWS if per_row else C.VALUE
        act = None if per_row else (lambda _d: actual if isinstance(actual, Column) else F.expr(actual) if isinstance(actual, str) else F.lit(actual))
        return self._reg(self._with_operands(C.Check(description, kind, df, C.equals(actual, expected, not per_row), actual=act), actual, expected), kw)

    # E3 / E4 --------------------------------------------------------
    def expect_true(self, df: DataFrame, value: Column | str, description: str, *, per_row: bool = True, **kw) -> "Suite":
        kind = C.ROWS if per_row else C.VALUE
        return self._reg(self._with_operands(C.Check(description, kind, df, C.identity(value, True, not per_row), actual=self._value_of(value, per_row)), value), kw)

    def expect_false(self, df: DataFrame, value: Column | str, description: str, *, per_row: bool = True, **kw) -> "Suite":
        kind = C.ROWS if per_row else C.VALUE
        return self._reg(self._with_operands(C.Check(description, kind, df, C.identity(value, False, not per_row), actual=self._value_of(value, per_row)), value), kw)

    # E5 / E6 --------------------------------------------------------
    def expect_null(self, df: DataFrame, value: Column | str, description: str, *, per_row: bool = True, **kw) -> "Suite":
        kind = C.ROWS if per_row else C.VALUE
        return self._reg(self._with_operands(C.Check(description, kind, df, C.nullness(value, True, not per_row), actual=self._value_of(value, per_row)), value), kw)

    def expect_not_null(self, df: DataFrame, value: Column | str, description: str, *, per_row: bool = True, **kw) -> "Suite":
        kind = C.ROWS if per_row else C.VALUE
        return self._reg(self._with_operands(C.Check(description, kind, df, C.nullness(value, False, not per_row), actual=self._value_of(value, per_row)), value), kw)

    # E7 -------------------------------------------------------------
    def expect_length(self, df: DataFrame, value: Column | str, expected_length: int, description: str, *,
                      per_row: bool = True, **kw) -> "Suite":
        kind = C.ROWS if per_row else C.VALUE
        return self._reg(self._with_operands(C.Check(description, kind, df, C.length_is(value, expected_length, not per_row), actual=self._value_of(value, per_row)), value), kw)

    # E8 -------------------------------------------------------------
    def expect_close(self, df: DataFrame, actual: Column | str, expected: Column | Any, description: str, *,
                     tolerance: float = 0.01, per_row: bool = True, **kw) -> "Suite":
        kind = C.ROWS if per_row else C.VALUE
        act = None if per_row else (lambda _d: C._col(actual))
        return self._reg(self._with_operands(C.Check(description, kind, df, C.close_to(actual, expected, tolerance, not per_row), actual=act), actual), kw)

    # E9 -------------------------------------------------------------
    def expect_in(self, df: DataFrame, value: Column | str, allowed: list | DataFrame, description: str, *,
                  allowed_column: str | None = None, **kw) -> "Suite":
        """Membership.  A Python list of any length becomes one ``isin`` in the
        table's aggregate; a table of allowed values an anti join (no size
        limit on the set)."""
        if isinstance(allowed, DataFrame):
            if not isinstance(value, str):
                raise TypeError("membership in a table needs a column name")
            col = allowed_column or allowed.columns[0]
            return self._reg(C.Check(description, C.PLAN, df, C.anti_join_count(df, value, allowed, col)), kw)
        return self._reg(C.Check(description, C.ROWS, df, C.member_of(value, list(allowed), False)), kw)

    # E10 ------------------------------------------------------------
    def expect_rows_equal(self, actual: DataFrame, expected: DataFrame, key: list[str], description: str, **kw) -> "Suite":
        """Rows with the same key must be equal by column name; two None are equal."""
        if actual is None or expected is None:
            return self._both_none(actual, expected, description, kw)
        build = lambda _d: CMP.total_differing(CMP.keyed_difference(actual, expected, key))
        return self._reg(C.Check(description, C.PLAN, actual, build), kw)

    # E11 ------------------------------------------------------------
    def expect_tables_equal(self, actual: DataFrame, expected: DataFrame, description: str, *,
                            order_by: list[str] | None = None, **kw) -> "Suite":
        """Equal as multisets, or position by position in ``order_by`` order;
        two None are equal."""
        if actual is None or expected is None:
            return self._both_none(actual, expected, description, kw)
        if order_by:
            build = lambda _d: CMP.total_differing(CMP.ordered_difference(actual, expected, order_by))
        else:
            build = lambda _d: CMP.total_differing(CMP.bag_difference(actual, expected))
        return self._reg(C.Check(description, C.PLAN, actual, build), kw)

    # E12 ------------------------------------------------------------
    def expect_sequence(self, df: DataFrame, actual: Column | str, expected: Column | str | list, ordered: bool,
                        description: str, **kw) -> "Suite":
        return self._reg(C.Check(description, C.ROWS, df, C.sequence_matches(actual, expected, ordered, False)), kw)

    # E13 ------------------------------------------------------------
    def expect_field(self, schema: T.StructType | DataFrame, name: str, type_class: str, nullable: bool | None,
                     description: str | None = None, **kw) -> "Suite":
        """The first field called ``name`` has type class ``type_class`` (type
        parameters ignored) and, unless ``nullable`` is None, that nullability."""
        if isinstance(schema, DataFrame):
            schema = schema.schema
        found = [f for f in schema.fields if f.name == name]
        f = found[0] if found else None
        actual = None if f is None else f"{f.name}, {type(f.dataType).__name__}, {f.nullable}"
        ok = f is not None and type(f.dataType).__name__ == type_class and (nullable is None or f.nullable == nullable)
        desc = description or FIELD_DESCRIPTION.format(name=name, type_class=type_class, nullable=nullable)
        kw.setdefault("hint", FIELD_HINT)
        return self._reg(C.Check(desc, C.FIXED, fixed_passed=ok, fixed_actual=actual), kw)

    # E14 ------------------------------------------------------------
    def expect_schemas_equal(self, actual: T.StructType | DataFrame, expected: T.StructType | DataFrame,
                             description: str, *, ordered: bool = True, **kw) -> "Suite":
        if actual is None or expected is None:
            return self._both_none(actual, expected, description, kw)
        spark = self._spark_of()
        sa = actual.schema if isinstance(actual, DataFrame) else actual
        sb = expected.schema if isinstance(expected, DataFrame) else expected
        fa = CMP.field_table(spark, {"actual": sa})
        fb = CMP.field_table(spark, {"expected": sb})
        build = lambda _d: CMP.total_differing(CMP.schema_difference(fa, fb, ordered))
        return self._reg(C.Check(description, C.PLAN, fa, build), kw)

    # E15 / E16 ------------------------------------------------------
    def fail(self, description: str, **kw) -> "Suite":
        return self._reg(C.Check(description, C.FIXED, fixed_passed=False, fixed_actual="False"), kw)

    def fail_pre_req(self, test_id: str, error: Exception | str, depends_on: Any = None) -> "Suite":
        check = C.Check(f"{PREREQ_TEXT} {error}", C.FIXED, fixed_passed=False, message=str(error))
        return self.add(check, test_id, 1, depends_on, None, False)

    def expect_columns(self, df: DataFrame, columns: list[str], test_id: str, **kw) -> "Suite":
        """Precondition: the table has these columns; later checks depend on it."""
        missing = [c for c in columns if c not in df.columns]
        if missing:
            return self.fail_pre_req(test_id, f"missing columns: {', '.join(missing)}", kw.get("depends_on"))
        return self._reg(C.Check(f"Table has columns {', '.join(columns)}", C.FIXED, fixed_passed=True), {**kw, "test_id": test_id})

    def expect_path(self, path: str, test_id: str, **kw) -> "Suite":
        """Precondition: a table or folder exists (checked through the
        session's file system); later checks depend on it."""
        from vouch.session import path_exists

        spark = self._spark_of()
        if not path_exists(spark, path):
            return self.fail_pre_req(test_id, f"missing table: {path}", kw.get("depends_on"))
        return self._reg(C.Check(f"Table {path} exists", C.FIXED, fixed_passed=True), {**kw, "test_id": test_id})

    # E17 ------------------------------------------------------------
    def expect_registered(self, name: str, df: DataFrame, *args: Any, description: str | None = None, **kw) -> "Suite":
        fn = C.registered(name)
        build = lambda d: C.predicate(fn(d, *args))(d)
        return self._reg(C.Check(description or name, C.ROWS, df, build), kw)

    # ------------------------------------------------------------------
    # compilation
    # ------------------------------------------------------------------
    def _ancestors(self) -> dict[str, list[str]]:
        """Reachable earlier dependencies per check (the declared graph is
        driver metadata, bounded by the number of declared checks)."""
        seq_of = {c.full_id: c.seq for c in self.checks}
        by_id = {c.full_id: c for c in self.checks}

        def resolve(dep: str) -> str | None:
            if dep == NO_PREVIOUS:
                return None
            if dep in seq_of:
                return dep
            prefixed = f"{self.name}-{dep}"
            if prefixed in seq_of:
                return prefixed
            raise ValueError(f"unknown dependency {dep!r} in suite {self.name!r}")

        direct = {}
        for c in self.checks:
            deps = [resolve(d) for d in c.depends_on]
            direct[c.full_id] = [d for d in deps if d is not None and seq_of[d] < c.seq]
        out: dict[str, list[str]] = {}
        for c in self.checks:  # seq order: ancestors of earlier checks are final
            acc: set[str] = set()
            for d in direct[c.full_id]:
                acc.add(d)
                acc.update(out[d])
            out[c.full_id] = sorted(acc)
            by_id[c.full_id].ancestors = out[c.full_id]
        return out

    def _meta_frame(self) -> DataFrame:
        """Check metadata as ONE local relation (one row per declared check)."""
        rows = [
            (c.idx, c.suite, c.full_id, c.seq, c.description, c.points, c.hint, list(c.ancestors), c.escape_html)
            for c in self.checks
        ]
        return self._spark_of().createDataFrame(rows, META_SCHEMA)

    @staticmethod
    def _outcome(idx: Column, passed: Column, violations: Column, actual: Column, message: Column) -> Column:
        return F.struct(idx.cast("int").alias("idx"), passed.alias("raw_passed"), violations.cast("long").alias("violations"),
                        actual.cast("string").alias("actual"), message.alias("message"), F.lit(None).cast("int").alias("actual_length"))

    def _compile_group(self, df: DataFrame, items: list[tuple[C.Check, Column, Column]]) -> DataFrame:
        aggs = []
        for i, (_c, viol, act, size) in enumerate(items):
            aggs += [viol.cast("long").alias(f"_v{i}"), act.alias(f"_a{i}"), size.alias(f"_n{i}")]
        one = df.agg(*aggs)
        # one generator expression turns the single aggregate row into a row
        # per check (one call, however many checks)
        args = ", ".join(f"{c.idx}, _v{i}, _a{i}, _n{i}" for i, (c, *_) in enumerate(items))
        stacked = one.selectExpr(f"stack({len(items)}, {args}) AS (idx, violations, actual, actual_length)")
        return stacked.select(
            F.col("idx").cast("int").alias("idx"), (F.col("violations") == 0).alias("raw_passed"),
            F.col("violations").cast("long").alias("violations"), F.col("actual").cast("string").alias("actual"),
            F.lit("").alias("message"), F.col("actual_length").cast("int").alias("actual_length"))

    @staticmethod
    def _actual_of(c: C.Check, viol: Column) -> tuple[Column, Column]:
        """The value shown in the hint, and its length where it has one."""
        none = F.lit(None).cast("int")
        if c.kind == C.ROWS:
            return viol.cast("string"), none
        if c.actual is None:
            return F.lit(None).cast("string"), none
        value = c.actual(c.target)
        size = V.sized_length(value, C.column_type(c.target, value, True))
        return value.cast("string"), none if size is None else size.cast("int")

    def _seed_operand_types(self) -> None:
        """One analysis per (table, row/aggregate) for all checks' operands."""
        batches: dict[tuple[int, bool], tuple[DataFrame, list[Column]]] = {}
        for c in self.checks:
            if c.operands and c.target is not None:
                key = (id(c.target), c.aggregate_operands)
                batches.setdefault(key, (c.target, []))[1].extend(c.operands)
        for (_tid, aggregate), (df, cols) in batches.items():
            C.seed_types(df, cols, aggregate)

    @staticmethod
    def _group_of(groups: list, df: DataFrame) -> list:
        """The checks of one table: the same object, or a plan that is the same."""
        for known, items in groups:
            if known is df or (known.semanticHash() == df.semanticHash() and known.sameSemantics(df)):
                return items
        groups.append((df, []))
        return groups[-1][1]

    def _raw_parts(self) -> list[DataFrame]:
        self._seed_operand_types()
        try:
            return self._raw_parts_seeded()
        finally:
            C.clear_types()

    def _raw_parts_seeded(self) -> list[DataFrame]:
        spark = self._spark_of()
        fixed: list[tuple] = []
        groups: list[tuple[DataFrame, list[tuple[C.Check, Column, Column, Column]]]] = []
        plans: list[DataFrame] = []
        known_failed: set[str] = set()  # failures known before any data is read
        for c in self.checks:
            if c.kind == C.FIXED:
                fixed.append((c.idx, bool(c.fixed_passed), 0 if c.fixed_passed else 1, c.fixed_actual, c.message,
                              None if c.fixed_actual is None else len(c.fixed_actual)))
                if not c.fixed_passed:
                    known_failed.add(c.full_id)
                continue
            if known_failed.intersection(c.ancestors):
                # certain to be skipped, so never executed (nor analysed),
                # as a skipped check is never run
                fixed.append((c.idx, False, None, None, "", None))
                continue
            try:
                if c.kind == C.PLAN:
                    one = c.build(c.target)
                    plans.append(one.select(F.inline(F.array(self._outcome(
                        F.lit(c.idx), F.col("violations") == 0, F.col("violations"), F.col("actual"), F.lit(""))))))
                    continue
                pred = c.build(c.target)
                if c.kind == C.ROWS:
                    viol = F.count_if(~F.coalesce(pred, F.lit(False)))
                else:
                    viol = F.when(F.coalesce(pred, F.lit(False)), F.lit(0)).otherwise(F.lit(1))
                act, size = self._actual_of(c, viol)
                self._group_of(groups, c.target).append((c, viol, act, size))
            except Exception as e:  # noqa: BLE001 - an error fails its own check only
                fixed.append(_failed(c.idx, e))
                known_failed.add(c.full_id)
        parts: list[DataFrame] = []
        for df, items in groups:
            try:
                parts.append(self._compile_group(df, items))  # analysed once for the whole table
            except Exception:  # noqa: BLE001 - find the checks that do not analyse
                good = []
                for item in items:
                    c, viol, act, _size = item
                    try:
                        df.agg(viol.alias("_v"), act.alias("_a")).schema
                        good.append(item)
                    except Exception:  # noqa: BLE001
                        try:  # its columns may be bound to its own table object
                            parts.append(self._compile_group(c.target, [item]))
                        except Exception as e:  # noqa: BLE001
                            fixed.append(_failed(c.idx, e))
                if good:
                    parts.append(self._compile_group(df, good))
        parts.extend(plans)
        if fixed:
            parts.append(spark.createDataFrame(fixed, OUTCOME_SCHEMA))
        return parts

    def raw_results(self) -> DataFrame:
        """One row per check before dependencies: (meta..., raw_passed, violations, actual, message)."""
        self._ancestors()
        return self._compile_raw()

    def _compile_raw(self) -> DataFrame:
        for i, c in enumerate(self.checks):
            c.idx = i
        parts = self._raw_parts()
        meta = self._meta_frame()
        if not parts:
            return meta.join(self._spark_of().createDataFrame([], OUTCOME_SCHEMA), "idx").drop("idx")
        out = _united(parts)
        # the metadata relation is bounded by the number of declared checks
        return out.join(F.broadcast(meta), "idx").drop("idx")

    def results(self) -> DataFrame:
        """The results table (lazy; computed once per Suite object)."""
        if self._results is None:
            self._results = with_skips(self.raw_results())
        return self._results

    def record(self, path: str) -> DataFrame:
        """Append this run's results, stamped with ``run_ts``, to a results
        history table (the cross-suite record: latest result per check wins
        in ``scoring.latest_results``)."""
        out = self.materialise().withColumn("run_ts", F.current_timestamp())
        out.write.mode("append").parquet(path)
        return self._spark_of().read.parquet(path)

    def materialise(self) -> DataFrame:
        """Compute the results once and keep them (reliable checkpoint), so
        score, percentage and report never re-run the checks.

        An error in the data (a cast, a division by zero, a function of the
        caller that raises) fails the one check that raises it, with its
        message: if the fused run fails, halves of the checks are run until
        each such check is alone.  Any other error (a file that is lost or
        unreadable, an executor) is raised: it says nothing about the data."""
        from vouch.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(self._spark_of())
        try:
            self._results = self.results().checkpoint()
        except Exception as e:  # noqa: BLE001 - find the checks that raise
            if data_error(e) is None:
                raise
            self._results = with_skips(self._isolated()).checkpoint()
        return self._results

    def _isolated(self) -> DataFrame:
        """Raw results, with one row of error for each check that raises."""
        spark = self._spark_of()
        self._ancestors()
        for i, c in enumerate(self.checks):
            c.idx = i
        done: list[tuple] = []
        bad: set[str] = set()
        middle = len(self.checks) // 2  # all together have just failed
        self._run_halves(self.checks[:middle], done, bad)
        self._run_halves(self.checks[middle:], done, bad)
        return spark.createDataFrame(done, OUTCOME_SCHEMA).join(F.broadcast(self._meta_frame()), "idx").drop("idx")

    def _run_halves(self, checks: list[C.Check], done: list[tuple], bad: set[str]) -> None:
        """Run checks in one job; on an error in the data run its halves, the
        earlier one first.  ``bad`` names the checks known not to pass; what
        depends on one of these is skipped, so it is not run."""
        skipped = [c for c in checks if bad.intersection(c.ancestors)]
        done += [(c.idx, False, None, None, "", None) for c in skipped]
        checks = [c for c in checks if not bad.intersection(c.ancestors)]
        if not checks:
            return
        part = Suite(self.name, self._spark_of())
        part.checks = checks
        try:
            rows = _united(part._raw_parts()).collect()  # one row for each declared check
        except Exception as e:  # noqa: BLE001
            text = data_error(e)
            if text is None:
                raise
            if len(checks) == 1:
                done.append((checks[0].idx, False, 1, None, text, None))
                bad.add(checks[0].full_id)
                return
            middle = len(checks) // 2
            self._run_halves(checks[:middle], done, bad)
            self._run_halves(checks[middle:], done, bad)
            return
        done += [tuple(r[f] for f in OUTCOME_SCHEMA.names) for r in rows]
        failed = {r["idx"] for r in rows if not r["raw_passed"]}
        bad.update(c.full_id for c in checks if c.idx in failed)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_error(error: BaseException) -> str | None:
    """The message of an error that the data of a check caused, else None.

    Spark names the class of an error by an SQL state: 22... are errors of
    data, P0001 is raised by an expression.  A function of the caller that
    raises in a Python worker counts as well.  An unreadable file never does,
    whatever lies below it.
    """
    if isinstance(error, PythonException):
        lines = [x for x in str(error).strip().splitlines() if x.strip()]
        return lines[-1].strip() if lines else type(error).__name__
    state = getattr(error, "getSqlState", lambda: None)()
    if state is not None:
        return _first_line(error) if _of_data(state) else None
    thrown, found = getattr(error, "java_exception", None), None
    while thrown is not None:
        try:
            state = thrown.getSqlState()
        except Exception:  # noqa: BLE001 - a throwable without a state
            state = None
        if state is not None and not _of_data(state) and not state.startswith("XX"):
            return None
        if state is not None and _of_data(state) and found is None:
            found = str(thrown.getMessage()).strip().splitlines()[0]
        thrown = thrown.getCause()
    return found


def _of_data(state: str) -> bool:
    return state.startswith("22") or state == "P0001"


META_SCHEMA = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("suite", T.StringType()),
        T.StructField("test_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("check_points", T.IntegerType()),
        T.StructField("hint_template", T.StringType()),
        T.StructField("ancestors", T.ArrayType(T.StringType())),
        T.StructField("escape_html", T.BooleanType()),
    ]
)

OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("raw_passed", T.BooleanType()),
        T.StructField("violations", T.LongType()),
        T.StructField("actual", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("actual_length", T.IntegerType()),
    ]
)


def _failed(idx: int, e: Exception) -> tuple:
    """The outcome of a check whose evaluation raised."""
    return (idx, False, 1, None, _first_line(e), None)


def with_skips(raw: DataFrame) -> DataFrame:
    """Statuses, points, hints and messages from raw results whose
    ``ancestors`` column lists each check's earlier dependencies."""
    # One row per DECLARED check, so the window holds a bounded number of
    # rows; it keeps the plan a single branch (no self-join re-reading
    # the tables).
    failed = F.collect_set(F.when(~F.col("raw_passed"), F.col("test_id"))).over(Window.partitionBy("suite"))
    j = raw.withColumn("_failed", failed)
    skipped = F.coalesce(F.arrays_overlap(F.col("ancestors"), F.col("_failed")), F.lit(False))
    j = j.withColumn("_skipped", skipped)
    st = status_columns(F.col("raw_passed"), F.col("_skipped"), F.col("check_points"))
    return j.select(
        "suite", "test_id", "seq", "description", *st, "violations", "actual",
        render_hint(F.col("hint_template"), F.col("actual"), F.col("actual_length")).alias("hint"),
        F.when(F.col("_skipped"), F.lit("")).otherwise(F.col("message")).alias("message"), "escape_html",
    )


def _first_line(e: Exception) -> str:
    text = str(e).strip()
    return text.splitlines()[0] if text else type(e).__name__


def union_suites(suites: Iterable[Suite]) -> DataFrame:
    """Results of several suites compiled TOGETHER: checks of all suites on
    the same table share one aggregate (one scan per table in total), and
    dependencies stay within each suite."""
    suites = list(suites)
    if not suites:
        raise ValueError("no suites")
    combined = Suite("", suites[0]._spark_of())
    for s in suites:
        s._ancestors()
        combined.checks.extend(s.checks)
    return with_skips(combined._compile_raw())


def duplicate_ids(checks: DataFrame, id_col: str = "test_id") -> DataFrame:
    """Check ids declared more than once: (test_id, n).  A partial aggregate,
    so an id repeated a billion times is combined map-side."""
    return checks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
