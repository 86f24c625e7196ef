"""One form for equal values: what rows are grouped, hashed and compared by.

``canonical`` turns a value of any type into one that Spark can group and
order and whose hash is equal exactly where the value is: maps become entries
sorted by key, NULLs inside nested values become flags (Spark's hash functions
pass over NULLs, so ``[NULL, 1]`` and ``[1, NULL]`` would hash alike), and
floating values lose the sign of zero and the bits of NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digests are sums of lanes of 31 bits, which no table of fewer than 2^32 rows overflows.
_LANE = (1 << 31) - 1
LANES = ("d0", "d1", "d2", "d3")


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType))


def canonical(value: Column, dt: T.DataType, sized: bool = False) -> Column:
    """``sized`` puts the number of entries before those of an array or a map:
    Spark's hashes pass from one array to the next without a mark, so [1], [2]
    and [1, 2], [] would hash alike."""
    if sized and isinstance(dt, (T.ArrayType, T.MapType)):
        return F.struct(F.size(value).alias("n"), _entries(value, dt, True).alias("e"))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        name = dt.simpleString()
        return F.when(F.isnan(value), F.lit(float("nan")).cast(name)).when(value == 0, F.lit(0.0).cast(name)).otherwise(value)
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return _entries(value, dt, sized)
    if isinstance(dt, T.StructType) and dt.fields:
        fields = [_flagged(value.getField(f.name), f.dataType, sized).alias(f"f{i}") for i, f in enumerate(dt.fields)]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _entries(value: Column, dt: T.DataType, sized: bool) -> Column:
    if isinstance(dt, T.ArrayType):
        return F.transform(value, lambda x: _flagged(x, dt.elementType, sized))
    return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(
        canonical(e["key"], dt.keyType, sized).alias("k"), _flagged(e["value"], dt.valueType, sized).alias("v"))))


def _flagged(value: Column, dt: T.DataType, sized: bool = False) -> Column:
    return F.struct(value.isNull().alias("none"), canonical(value, dt, sized).alias("v"))


def canonical_columns(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns of ``names`` in canonical form (plain ones as they are)."""
    out = []
    for n in names:
        dt, c = df.schema[n].dataType, F.col(f"`{n}`")
        out.append((canonical(c, dt) if is_nested(dt) else c).alias(n))
    return out


def row_hashes(df: DataFrame, names: list[str]) -> tuple[Column, Column]:
    """128 bits that stand for a row's values of ``names``, NULLs included."""
    flags = [F.isnull(F.col(f"`{n}`")) for n in names]
    values = [canonical(F.col(f"`{n}`"), df.schema[n].dataType, sized=True) for n in names]
    return F.xxhash64(F.lit(1), *flags, *values), F.xxhash64(F.lit(2), *values, *flags)


def digest_sums(h1: Column, h2: Column, sign: Column | None = None) -> list[Column]:
    """Aggregates d0..d3: equal for equal bags of hashes, whatever their order.
    With a ``sign`` (1 or -1) of each row they are 0 where both bags are equal."""
    parts = [h.bitwiseAND(F.lit(_LANE)) if low else F.shiftrightunsigned(h, 33) for h in (h1, h2) for low in (True, False)]
    parts = parts if sign is None else [p * sign for p in parts]
    return [F.coalesce(F.sum(p), F.lit(0).cast("bigint")).alias(n) for p, n in zip(parts, LANES, strict=True)]


def same_digest(left: str, right: str) -> Column:
    """Whether the count ``n`` and the lanes of two joined digests agree."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("n", *LANES)])
