"""Check declarations.

A check is declared, never run on the driver.  It holds a builder that,
given the table it runs on, returns a Spark ``Column``:

- ``rows``  - a per-row predicate; the check counts the rows where it is not
  TRUE (NULL counts as a violation) and passes when that count is 0, so an
  empty table passes;
- ``value`` - an aggregate predicate (e.g. ``count(*) == 15000``); the check
  passes when it is TRUE;
- ``plan``  - a check that needs its own plan (a join or a comparison of two
  tables); the builder returns a one-row DataFrame ``(violations, actual)``;
- ``fixed`` - a result known without touching data (schema checks, ``fail``,
  failed preconditions).

The suite planner (``vouch.plans.suite``) compiles every ``rows``/``value``
check on the same table into ONE ``agg``, so a table is scanned once however
many checks it has.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import values as V

ROWS, VALUE, PLAN, FIXED = "rows", "value", "plan", "fixed"


@dataclass
class Check:
    description: str
    kind: str
    target: DataFrame | None = None
    build: Callable[[DataFrame], Any] | None = None
    actual: Callable[[DataFrame], Column] | None = None
    fixed_passed: bool = False
    fixed_actual: str | None = None
    message: str = ""
    test_id: str | None = None
    points: int = 1
    depends_on: list[str] | None = None
    hint: str | None = None
    escape_html: bool = False
    seq: int = 0
    idx: int = 0  # position in the compiled batch (unique across suites compiled together)
    suite: str = ""
    ancestors: list[str] = field(default_factory=list)
    # Column operands whose types the builder needs, resolved in one batch per table
    operands: list[Column] = field(default_factory=list)
    aggregate_operands: bool = False

    @property
    def full_id(self) -> str:
        return f"{self.suite}-{self.test_id}"


def _col(c: Column | str | Any) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def table_schema(df: DataFrame) -> T.StructType:
    """The table's schema, fetched once per DataFrame object."""
    cached = getattr(df, "_vouch_schema", None)
    if cached is None:
        cached = df.schema
        try:
            df._vouch_schema = cached
        except AttributeError:  # pragma: no cover - frames that refuse attributes
            pass
    return cached


# Types of operand Columns resolved in a batch (id -> (column, type)); the
# column is kept so an id is never matched against a different object.
_TYPE_CACHE: dict[int, tuple[Column, T.DataType]] = {}


def seed_types(df: DataFrame, cols: list[Column], aggregate: bool) -> None:
    """Resolve many operands in ONE analysis; on any error leave them to the
    per-check path (which then isolates the bad one)."""
    if not cols:
        return
    try:
        types = column_types(df, cols, aggregate)
    except Exception:  # noqa: BLE001
        return
    for c, t in zip(cols, types):
        _TYPE_CACHE[id(c)] = (c, t)


def clear_types() -> None:
    _TYPE_CACHE.clear()


def column_type(df: DataFrame, c: Column | str, aggregate: bool = False) -> T.DataType:
    """Resolve a column against a table: a batch-resolved operand or a plain
    column name without analysis, any other expression by analysis (no job)."""
    if isinstance(c, Column):
        hit = _TYPE_CACHE.get(id(c))
        if hit is not None and hit[0] is c:
            return hit[1]
    if isinstance(c, str) and not aggregate:
        sch = table_schema(df)
        if c in sch.fieldNames():
            return sch[c].dataType
        c = F.col(c)
    probe = df.agg(c.alias("_v")) if aggregate else df.select(c.alias("_v"))
    return probe.schema["_v"].dataType


# ---------------------------------------------------------------------------
# Builders.  Each returns a function of the target table.
# ---------------------------------------------------------------------------


def predicate(p: Column | str) -> Callable[[DataFrame], Column]:
    """A boolean expression as given.  It is not analysed on its own: the
    table's combined aggregate rejects one that does not resolve or is not
    boolean, and the suite then pinpoints it (failing only that check)."""

    def build(df: DataFrame) -> Column:
        return F.expr(p) if isinstance(p, str) else p

    return build


def column_types(df: DataFrame, cols: list[Column], aggregate: bool) -> list[T.DataType]:
    """Types of several expressions in ONE analysis."""
    aliased = [c.alias(f"_v{i}") for i, c in enumerate(cols)]
    probe = df.agg(*aliased) if aggregate else df.select(*aliased)
    return [f.dataType for f in probe.schema.fields]


def equals(actual: Any, expected: Any, aggregate: bool) -> Callable[[DataFrame], Column]:
    def build(df: DataFrame) -> Column:
        a_is_col = isinstance(actual, (Column, str))
        b_is_col = isinstance(expected, Column)
        a = _col(actual) if a_is_col else F.lit(actual)
        b = expected if b_is_col else F.lit(expected)
        probe = [x for x, is_col in ((a, a_is_col), (b, b_is_col)) if is_col]
        types = iter(column_types(df, probe, aggregate)) if probe else iter(())
        at = next(types) if a_is_col else V.lit_type(actual)
        bt = next(types) if b_is_col else V.lit_type(expected)
        return V.py_equal(a, at, b, bt)

    return build


def identity(value: Any, want: bool, aggregate: bool) -> Callable[[DataFrame], Column]:
    """``x is True`` / ``x is False``: only a BOOLEAN TRUE/FALSE passes."""

    def build(df: DataFrame) -> Column:
        c = _col(value)
        dt = column_type(df, value if isinstance(value, str) else c, aggregate)
        if not isinstance(dt, T.BooleanType):
            return F.lit(False)
        return F.coalesce(c if want else ~c, F.lit(False))

    return build


def nullness(value: Any, want_null: bool, aggregate: bool) -> Callable[[DataFrame], Column]:
    def build(df: DataFrame) -> Column:
        c = _col(value)
        column_type(df, value if isinstance(value, str) else c, aggregate)
        return c.isNull() if want_null else c.isNotNull()

    return build


def length_is(value: Any, expected_length: int, aggregate: bool) -> Callable[[DataFrame], Column]:
    def build(df: DataFrame) -> Column:
        c = _col(value)
        n = V.sized_length(c, column_type(df, value if isinstance(value, str) else c, aggregate))
        if n is None:
            return F.lit(False)
        return F.coalesce(n == F.lit(expected_length), F.lit(False))

    return build


def close_to(actual: Any, expected: Any, tolerance: float, aggregate: bool) -> Callable[[DataFrame], Column]:
    def build(df: DataFrame) -> Column:
        a, b = _col(actual), (expected if isinstance(expected, Column) else F.lit(expected))
        column_type(df, actual if isinstance(actual, str) else a, aggregate)
        return V.floats_close(a, b, tolerance)

    return build


def member_of(value: Any, values: list[Any], aggregate: bool) -> Callable[[DataFrame], Column]:
    def build(df: DataFrame) -> Column:
        c = _col(value)
        return V.in_values(c, column_type(df, value if isinstance(value, str) else c, aggregate), list(values))

    return build


def sequence_matches(actual: Any, expected: Any, ordered: bool, aggregate: bool) -> Callable[[DataFrame], Column]:
    def build(df: DataFrame) -> Column:
        a = _col(actual)
        b = expected if isinstance(expected, Column) else (F.col(expected) if isinstance(expected, str) else F.array(*[F.lit(x) for x in expected]) if expected is not None else F.lit(None))
        at = column_type(df, actual if isinstance(actual, str) else a, aggregate)
        if not isinstance(at, T.ArrayType):
            return a.isNull() & b.isNull()
        return V.sequences_equal(a, b, ordered)

    return build


def anti_join_count(target: DataFrame, column: str, allowed: DataFrame, allowed_column: str) -> Callable[[DataFrame], DataFrame]:
    """Membership in a set given as a table: rows of ``target`` whose value is
    not in ``allowed`` (null-safe: a NULL key admits NULL values).

    The target is first counted by value, combined map-side, so a hot value is
    one row per task; only distinct values meet the set.  Values of another
    kind than the set's never match."""

    def build(_: DataFrame) -> DataFrame:
        keys = allowed.select(F.col(allowed_column).alias("_k")).distinct()
        if V.kind_of(target.schema[column].dataType) != V.kind_of(keys.schema["_k"].dataType):
            keys = keys.where(F.col("_k").isNull()).select(F.lit(None).cast(target.schema[column].dataType).alias("_k"))
        counted = target.groupBy(F.col(column).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        misses = counted.join(keys, F.col("_p").eqNullSafe(F.col("_k")), "left_anti")
        return misses.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violations")).select(
            "violations", F.col("violations").cast("string").alias("actual"))

    return build


# ---------------------------------------------------------------------------
# Registry of user-defined checks (named column builders).
# ---------------------------------------------------------------------------

_REGISTRY: dict[str, Callable[..., Column]] = {}


def register_check(fn: Callable[..., Column], name: str | None = None) -> Callable[..., Column]:
    """Register a named check: a function ``fn(df, *args) -> Column`` giving a
    per-row predicate.  The first parameter must take the table."""
    params = list(inspect.signature(fn).parameters)
    if not params:
        raise TypeError(f"check {fn.__name__}() must take the table as its first parameter")
    _REGISTRY[name or fn.__name__] = fn
    return fn


def registered(name: str) -> Callable[..., Column]:
    if name not in _REGISTRY:
        raise KeyError(f"no registered check named {name!r}")
    return _REGISTRY[name]


def registered_names() -> list[str]:
    return sorted(_REGISTRY)
