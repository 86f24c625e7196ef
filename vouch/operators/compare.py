"""Distributed equality of tables, rows and schemas.

Nothing here collects rows.  Results are small DataFrames of
``(side, rows_differing)`` with ``side`` in ``actual_only``,
``expected_only`` and (ordered / keyed modes) ``changed``.

Rows compare by column NAME (column order is free), values with Spark's
null-safe equality; NaN equals NaN here (Spark's grouping rule), unlike a
tolerance check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions.canonical import LANES, canonical_columns, digest_sums, is_nested, row_hashes, same_digest
from vouch.functions.values import kind_of
from vouch.session import ensure_checkpoint_dir

ACTUAL_ONLY, EXPECTED_ONLY, CHANGED = "actual_only", "expected_only", "changed"
_BLOCK_BITS = 12  # positions in a block: 4096
_BUCKET_BITS = 12  # buckets of hashes
_POS_BITS = 33  # monotonically_increasing_id keeps the partition id above bit 33


def _groupable(df: DataFrame) -> DataFrame:
    """Nested columns in the one form that groups and compares, also maps inside them."""
    return df.select(*canonical_columns(df, df.columns))


def _check_names(df: DataFrame, label: str) -> list[str]:
    names = df.columns
    if len(set(names)) != len(names):
        raise ValueError(f"{label} has repeated column names: {sorted(names)}")
    return sorted(names)


def _same_kinds(a: DataFrame, b: DataFrame, names: list[str]) -> bool:
    """Types come first: columns of one name whose kinds differ, also inside
    nested types, never compare equal (1 is not '1', and a whole number is not
    a floating one)."""
    return all(kind_of(a.schema[n].dataType) == kind_of(b.schema[n].dataType) for n in names)


def _sides(spark_df: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    """One aggregate row turned into (side, rows_differing) rows."""
    structs = [F.struct(F.lit(s).alias("side"), c.cast("long").alias("rows_differing")) for s, c in pairs]
    return spark_df.select(F.inline(F.array(*structs)))


def bag_difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Multiset difference both ways in ONE shuffle.

    Both sides are tagged and unioned, then grouped by the whole row; the
    partial (map-side) aggregate collapses repeated rows before the shuffle,
    so a row repeated a billion times costs one record per map task.  The
    result equals ``exceptAll`` both ways without computing either.  Rows with
    nested columns, which are wide in the form that groups, are grouped by hashes.
    """
    a_names = _check_names(actual, "actual")
    b_names = _check_names(expected, "expected")
    if a_names != b_names or not _same_kinds(actual, expected, a_names):
        counts = actual.agg(F.count(F.lit(1)).alias("n")).select(F.col("n"), F.lit(0).alias("m"))
        totals = counts.unionByName(expected.agg(F.count(F.lit(1)).alias("m")).select(F.lit(0).alias("n"), "m"))
        agg = totals.agg(F.sum("n").alias("a"), F.sum("m").alias("b"))
        return _sides(agg, [(ACTUAL_ONLY, F.col("a")), (EXPECTED_ONLY, F.col("b"))])
    a = actual.select(*[F.col(f"`{n}`") for n in a_names])
    b = expected.select(*[F.col(f"`{n}`") for n in a_names])
    if any(is_nested(f.dataType) for f in a.schema.fields):
        return _hashed_bag_difference(a, b)
    a, b = _groupable(a), _groupable(b)
    tagged = a.withColumn("_na", F.lit(1)).withColumn("_nb", F.lit(0)).unionByName(
        b.withColumn("_na", F.lit(0)).withColumn("_nb", F.lit(1))
    )
    per_row = tagged.groupBy(*[F.col(f"`{n}`") for n in a_names]).agg(F.sum("_na").alias("na"), F.sum("_nb").alias("nb"))
    agg = per_row.agg(
        F.coalesce(F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))), F.lit(0)).alias("b"),
    )
    return _sides(agg, [(ACTUAL_ONLY, F.col("a")), (EXPECTED_ONLY, F.col("b"))])


def _hashed_bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The multiset difference of rows by 128-bit hashes: first digests of buckets
    of hashes, which partial aggregation reduces in each task; then only the
    hashes of buckets that differ are shuffled, whatever the width of a row."""
    sides = []
    for rows, sign in ((a, 1), (b, -1)):
        # Wider numbers of one kind are equal, and made so before they are hashed.
        rows = rows.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in _common_types(a, b).items()])
        h1, h2 = row_hashes(rows, rows.columns)
        sides.append(rows.select(h1.alias("_h1"), h2.alias("_h2"), F.lit(sign).cast("bigint").alias("_s")))
    both = sides[0].unionByName(sides[1]).withColumn("_bucket", F.pmod("_h1", F.lit(1 << _BUCKET_BITS)).cast("int"))
    sums = digest_sums(F.col("_h1"), F.col("_h2"), F.col("_s"))
    digests = both.groupBy("_bucket").agg(F.sum("_s").alias("n"), *sums)
    differing = digests.where(" OR ".join(f"{c} <> 0" for c in ("n", *LANES))).select("_bucket")  # a row a bucket at most
    rows = both.join(F.broadcast(differing), "_bucket", "left_semi")
    agg = rows.groupBy("_h1", "_h2").agg(F.sum("_s").alias("d")).agg(
        *[F.coalesce(F.sum(F.greatest(d, F.lit(0))), F.lit(0)).alias(n) for n, d in (("a", F.col("d")), ("b", -F.col("d")))])
    return _sides(agg, [(ACTUAL_ONLY, F.col("a")), (EXPECTED_ONLY, F.col("b"))])


def _common_types(a: DataFrame, b: DataFrame) -> dict[str, T.DataType]:
    """The type that a union gives each column."""
    return {f.name: f.dataType for f in a.limit(0).unionByName(b.limit(0)).schema.fields}


def _rows_differ(names_a: list[str], names_b: list[str], left: str, right: str) -> Column:
    if names_a != names_b:
        return F.lit(True)
    same = F.lit(True)
    for n in names_a:
        same = same & F.col(f"{left}.`{n}`").eqNullSafe(F.col(f"{right}.`{n}`"))
    return ~same


def with_positions(df: DataFrame, order_by: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``_pos`` (0-based position in a total order) without a single-task sort.

    Range-partition on the order columns (all remaining columns break ties,
    so the order is total and recomputation gives the same positions), sort
    within partitions, tag rows with ``monotonically_increasing_id`` (its
    low 33 bits are the index inside the partition), count rows per
    partition and add the running offset.  The offsets table has one row per
    partition, so broadcasting it is bounded by the partition count.
    Rows repeated many times are spread by a salt, so no task holds a hot
    group of copies.

    The ranged, sorted frame is written to the checkpoint folder once; counts
    and numbers are both read from it, so positions never depend on an
    exchange being run only once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    names = order_by + [n for n in sorted(df.columns) if n not in order_by]
    keys = [F.col(f"`{n}`") for n in names if not isinstance(df.schema[n].dataType, T.MapType)]
    # Identical rows cannot be split by range bounds; a per-occurrence salt as
    # the last key spreads many copies of one row over several partitions
    # (their relative order is irrelevant: the copies are identical).
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    keys = keys + [F.col("_salt")]
    # Without an explicit count, AQE may coalesce small range partitions; it
    # merges only contiguous reducer ranges, so the global order is kept.
    ranged = (salted.repartitionByRange(partitions, *keys) if partitions else salted.repartitionByRange(*keys))
    ranged = ranged.sortWithinPartitions(*keys)
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright(F.col("_mid"), _POS_BITS).alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("_local"),
    ).checkpoint()
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    return tagged.join(F.broadcast(offsets), "_pid").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_off") + F.col("_local")).alias("_pos")
    )


def _hashed_positions(a: DataFrame, b: DataFrame, order_by: list[str]) -> DataFrame:
    """(_pos, _side, _h1, _h2): the position of each row of two tables and 128
    bits that stand for it.

    Both tables are ranged and sorted as one, the side first, so there is one
    sort in all; only the light columns are kept (checkpointed), and numbered
    from the rows of the partitions before, a table of one row per partition.
    """
    ensure_checkpoint_dir(a.sparkSession)
    names = order_by + [n for n in sorted(a.columns) if n not in order_by]
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    h1, h2 = row_hashes(both, sorted(a.columns))
    # The salt splits copies of one row, which are interchangeable.
    both = both.withColumn("_salt", F.monotonically_increasing_id())
    keys = [F.col("_side"), *[F.col(f"`{n}`") for n in names], F.col("_salt")]
    ranged = both.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_side", h1.alias("_h1"), h2.alias("_h2"), F.monotonically_increasing_id().alias("_mid"))
    rows = ranged.select("_side", "_h1", "_h2", F.shiftright("_mid", _POS_BITS).alias("_pid"), F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("_local")).checkpoint()
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_side") == 0).alias("_n0"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n0").over(Window.partitionBy()).alias("_first"))
    pos = F.col("_off") + F.col("_local") - F.when(F.col("_side") == 1, F.col("_first")).otherwise(F.lit(0))
    return rows.join(F.broadcast(offsets), "_pid").select(pos.alias("_pos"), "_side", "_h1", "_h2")


def ordered_difference(actual: DataFrame, expected: DataFrame, order_by: list[str]) -> DataFrame:
    """Position-by-position comparison in an explicit total order (the remaining
    columns break ties).  An order column that one side lacks is an error.

    Rows are compared by 128-bit hashes, first as digests of blocks of
    positions, which partial aggregation reduces inside each sorted partition;
    only the rows of blocks that differ are brought together by position.
    """
    a_names = _check_names(actual, "actual")
    b_names = _check_names(expected, "expected")
    for c in order_by:
        if c not in a_names or c not in b_names:
            raise ValueError(f"unknown order column: {c}")
    if a_names != b_names or not _same_kinds(actual, expected, a_names):
        return bag_difference(actual, expected)
    rows = _hashed_positions(_groupable(actual), _groupable(expected), order_by)
    block = F.shiftright("_pos", _BLOCK_BITS).alias("_block")
    # A row's place counts: the digest of a block is one of (position, row) pairs.
    digests = rows.groupBy(block, "_side").agg(F.count(F.lit(1)).alias("n"), *digest_sums(F.xxhash64("_pos", "_h1"), F.xxhash64("_h2", "_pos")))
    left, right = digests.where("_side = 0").alias("l"), digests.where("_side = 1").alias("r")
    differing = left.join(right, F.col("l._block") == F.col("r._block"), "full_outer").where(~same_digest("l", "r"))
    differing = differing.select(F.coalesce("l._block", "r._block").alias("_block"))
    pairs = rows.withColumn("_block", block).join(differing, "_block", "left_semi").groupBy("_pos").agg(
        *[F.max(F.when(F.col("_side") == s, F.col(h))).alias(f"{h}{s}") for s in (0, 1) for h in ("_h1", "_h2")])
    in_a, in_b = F.col("_h10").isNotNull(), F.col("_h11").isNotNull()
    differ = (F.col("_h10") != F.col("_h11")) | (F.col("_h20") != F.col("_h21"))
    agg = pairs.agg(F.count_if(in_a & ~in_b).alias("a"), F.count_if(in_b & ~in_a).alias("b"), F.count_if(in_a & in_b & differ).alias("c"))
    return _sides(agg, [(ACTUAL_ONLY, F.col("a")), (EXPECTED_ONLY, F.col("b")), (CHANGED, F.col("c"))])


def keyed_difference(actual: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Row-by-row comparison by key, also with NULL and repeated keys.

    Both sides are tagged and unioned, counted by whole row (map-side first)
    and then by key.  A key's surplus rows of one side pair off with the
    other side's as changed; the rest is there on one side only.  A key that
    occurs n and m times costs n + m rows, never n x m.
    """
    a_names = _check_names(actual, "actual")
    b_names = _check_names(expected, "expected")
    for k in key:
        if k not in a_names or k not in b_names:
            raise ValueError(f"unknown key column: {k}")
    whole = a_names == b_names and _same_kinds(actual, expected, a_names)
    if not _same_kinds(actual, expected, key):
        return bag_difference(actual, expected)
    names = a_names if whole else key
    cols = [F.col(f"`{n}`") for n in names]
    a, b = _groupable(actual.select(*cols)), _groupable(expected.select(*cols))
    tagged = a.withColumn("_na", F.lit(1)).withColumn("_nb", F.lit(0)).unionByName(b.withColumn("_na", F.lit(0)).withColumn("_nb", F.lit(1)))
    rows = tagged.groupBy(*cols).agg(F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb"))
    if whole:  # equal rows cancel out; where columns differ, no two rows are equal
        both = F.least("_na", "_nb")
        rows = rows.select(*cols, (F.col("_na") - both).alias("_na"), (F.col("_nb") - both).alias("_nb"))
    per_key = rows.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb"))
    changed = F.least("_na", "_nb")
    agg = per_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in
                        (("a", F.col("_na") - changed), ("b", F.col("_nb") - changed), ("c", changed))])
    return _sides(agg, [(ACTUAL_ONLY, F.col("a")), (EXPECTED_ONLY, F.col("b")), (CHANGED, F.col("c"))])


def _joined_difference(l: DataFrame, r: DataFrame, key: list[str], a_names: list[str], b_names: list[str]) -> DataFrame:
    cond = None
    for k in key:
        c = F.col(f"l.`{k}`") == F.col(f"r.`{k}`")
        cond = c if cond is None else cond & c
    ltag = l.withColumn("_in_l", F.lit(True)).alias("l")
    rtag = r.withColumn("_in_r", F.lit(True)).alias("r")
    j = ltag.join(rtag, cond, "full_outer")
    in_l = F.col("l._in_l").isNotNull()
    in_r = F.col("r._in_r").isNotNull()
    a_cols = [n for n in a_names if n not in key]
    b_cols = [n for n in b_names if n not in key]
    differ = _rows_differ(a_cols, b_cols, "l", "r")
    agg = j.agg(
        F.count_if(in_l & ~in_r).alias("a"),
        F.count_if(in_r & ~in_l).alias("b"),
        F.count_if(in_l & in_r & differ).alias("c"),
    )
    return _sides(agg, [(ACTUAL_ONLY, F.col("a")), (EXPECTED_ONLY, F.col("b")), (CHANGED, F.col("c"))])


def total_differing(diff: DataFrame) -> DataFrame:
    """Collapse (side, rows_differing) to the one-row check form."""
    return diff.agg(F.coalesce(F.sum("rows_differing"), F.lit(0)).cast("long").alias("violations")).select(
        "violations", F.col("violations").cast("string").alias("actual")
    )


# ---------------------------------------------------------------------------
# Schemas as tables
# ---------------------------------------------------------------------------

FIELD_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("type_class", T.StringType(), False),
        T.StructField("type_json", T.StringType(), False),
        T.StructField("nullable", T.BooleanType(), False),
    ]
)


def field_rows(schema: T.StructType, table_name: str) -> list[tuple]:
    return [
        (table_name, i + 1, f.name, type(f.dataType).__name__, f.dataType.json(), bool(f.nullable))
        for i, f in enumerate(schema.fields)
    ]


def field_table(spark, schemas: dict[str, T.StructType]) -> DataFrame:
    """One row per top-level field of each named schema (metadata only)."""
    rows = [r for name, s in schemas.items() for r in field_rows(s, name)]
    return spark.createDataFrame(rows, FIELD_SCHEMA)


def schema_difference(actual: DataFrame, expected: DataFrame, ordered: bool) -> DataFrame:
    """Compare two field tables (top-level nullability ignored, nested kept).

    Ordered: pair fields by position.  Unordered: fields as a set, so a
    repeated field collapses.
    """
    a = actual.select("pos", "name", "type_json")
    b = expected.select("pos", "name", "type_json")
    if ordered:
        return _joined_difference(a.alias("l"), b.alias("r"), ["pos"], ["name", "pos", "type_json"], ["name", "pos", "type_json"])
    ad = a.select("name", "type_json").distinct()
    bd = b.select("name", "type_json").distinct()
    only_a = ad.join(bd, ["name", "type_json"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    only_b = bd.join(ad, ["name", "type_json"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return only_a.select(F.lit(ACTUAL_ONLY).alias("side"), F.col("n").alias("rows_differing")).unionByName(
        only_b.select(F.lit(EXPECTED_ONLY).alias("side"), F.col("n").alias("rows_differing"))
    )
