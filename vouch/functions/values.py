"""Value comparison rules as Column expressions.

The rules follow plain Python comparison semantics where a check compares
one value with another: no implicit string-to-number cast, NULL equals NULL,
NaN never equals anything in a tolerance test.  Every expression returns a
non-NULL boolean so a check can never be "unknown".
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions.canonical import canonical, is_nested

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_STRINGY = (T.StringType, T.VarcharType, T.CharType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC + (T.BooleanType,))


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, _STRINGY)


def lit_type(value: Any) -> T.DataType:
    """Spark type of a Python literal, as Python would see it."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(value, decimal.Decimal):
        return T.DecimalType(38, 18)
    if isinstance(value, dt.datetime):
        return T.TimestampType()
    if isinstance(value, dt.date):
        return T.DateType()
    if isinstance(value, (list, tuple)):
        kinds = [lit_type(v) for v in value if v is not None]
        return T.ArrayType(kinds[0] if kinds else T.NullType())
    raise TypeError(f"unsupported literal type {type(value).__name__}")


def py_equal(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    """``a == b`` with Python rules; always TRUE or FALSE.

    - NULL == NULL is true, NULL == x is false.
    - Numbers (booleans count as 0/1) compare by value; NaN equals nothing.
    - Strings compare with strings only: ``'1' == 1`` is false.
    - Arrays, structs and maps compare part by part by these rules.
    - Other values compare when both sides have the same Spark type.
    """
    both_null = a.isNull() & b.isNull()
    if isinstance(a_type, T.NullType) or isinstance(b_type, T.NullType):
        return F.coalesce(both_null, F.lit(False))
    if is_numeric(a_type) and is_numeric(b_type):
        return both_null | F.coalesce(_same_number(a, a_type, b, b_type), F.lit(False))
    if is_string(a_type) and is_string(b_type):
        return a.eqNullSafe(b)
    if kind_of(a_type) == kind_of(b_type):
        if is_nested(a_type):  # maps do not compare, so entries in one order
            return canonical(a, a_type).eqNullSafe(canonical(b, b_type))
        return a.eqNullSafe(b)
    # Nested values whose kinds differ somewhere inside are equal only where every part is.
    if isinstance(a_type, T.ArrayType) and isinstance(b_type, T.ArrayType):
        x, y = a_type.elementType, b_type.elementType
        pairs = F.forall(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: py_equal(p["x"], x, p["y"], y))
        return both_null | F.coalesce((F.size(a) == F.size(b)) & pairs, F.lit(False))
    if isinstance(a_type, T.StructType) and isinstance(b_type, T.StructType) and a_type.names == b_type.names:
        same = F.lit(True)
        for f, g in zip(a_type.fields, b_type.fields, strict=True):
            same = same & py_equal(a.getField(f.name), f.dataType, b.getField(g.name), g.dataType)
        return both_null | F.coalesce(a.isNotNull() & b.isNotNull() & same, F.lit(False))
    if isinstance(a_type, T.MapType) and isinstance(b_type, T.MapType) and kind_of(a_type.keyType) == kind_of(b_type.keyType):
        entry = [T.StructType([T.StructField("key", m.keyType), T.StructField("value", m.valueType)]) for m in (a_type, b_type)]
        return py_equal(_entries(a), T.ArrayType(entry[0]), _entries(b), T.ArrayType(entry[1]))
    return both_null


def _entries(m: Column) -> Column:
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), F.element_at(m, k).alias("value")))


def kind_of(dt: T.DataType) -> str:
    """Values of different kinds are never equal; the kind of a nested type
    names the kinds of all its parts."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, _INTEGRAL):
        return "integral"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "floating"
    if is_string(dt):
        return "string"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.ArrayType):
        return f"array<{kind_of(dt.elementType)}>"
    if isinstance(dt, T.MapType):
        return f"map<{kind_of(dt.keyType)},{kind_of(dt.valueType)}>"
    if isinstance(dt, T.StructType):
        return "struct<" + ",".join(f"{f.name!r}:{kind_of(f.dataType)}" for f in dt.fields) + ">"
    return type(dt).__name__


def _same_number(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    """Equality by exact value, never through a rounding cast."""
    ka, kb = kind_of(a_type), kind_of(b_type)
    whole = ("integral", "boolean")
    if ka in whole and kb in whole:
        return a.cast("long") == b.cast("long")
    if kb in whole:  # the whole number comes first
        a, ka, b, kb = b, kb, a, ka
    if kb == "floating":
        d = b.cast("double")
        if ka in whole:
            # beyond 2^53 a double is compared as the whole number that it is
            return (d == F.floor(d)) & (d >= F.lit(-(2.0 ** 63))) & (d < F.lit(2.0 ** 63)) & (b.try_cast("long") == a.cast("long"))
        if ka == "floating":
            return (a.cast("double") == d) & ~F.isnan(d)
        return _decimal_is_double(a, a_type, d)
    if ka == "floating":
        return _decimal_is_double(b, b_type, a.cast("double"))
    if ka in whole:
        return (b == F.floor(b)) & (b.cast("decimal(38,0)") == a.cast("long").cast("decimal(38,0)"))
    return a == b


def _decimal_is_double(d: Column, d_type: T.DecimalType, x: Column) -> Column:
    """A decimal equals a double only where the double is exactly that number.

    The whole parts are compared as decimals, the double's made of pieces of
    32 bits.  A fraction k / 10^s equals the double's only if that has at most
    s binary places: j / 2^s, and then k = j 5^s.
    """
    whole_type, scale = "decimal(38,0)", d_type.scale
    size = F.abs(x)
    # Parts beyond 2^32 are read by powers of two, which doubles divide and multiply exactly.
    top = F.floor(size / F.lit(2.0 ** 96)) if d_type.precision - scale > 28 else F.lit(0).cast("long")
    pieces, rest = [top], size - top.cast("double") * F.lit(2.0 ** 96)
    for power in (64, 32, 0):
        piece = F.floor(rest / F.lit(2.0 ** power))
        pieces.append(piece)
        rest = rest - piece.cast("double") * F.lit(2.0 ** power)
    number = pieces[0].cast(whole_type)
    for piece in pieces[1:]:
        number = F.try_add(F.try_multiply(number, F.lit(decimal.Decimal(2 ** 32)).cast("decimal(10,0)")).cast(whole_type), piece.cast(whole_type)).cast(whole_type)
    text = F.split(F.regexp_replace(d.cast("string"), "^-", ""), r"\.")
    same = text.getItem(0).cast(whole_type) == number
    if scale:
        steps = rest * F.lit(2.0 ** scale)
        k = F.try_multiply(F.floor(steps).cast("decimal(12,0)"), F.lit(decimal.Decimal(5 ** scale))).cast(whole_type)
        same = same & (steps == F.floor(steps)) & (text.getItem(1).cast(whole_type) == k)
    else:
        same = same & (rest == 0)
    near = F.coalesce((d.cast("double") == x) & ~F.isnan(x) & (size < F.lit(1e38)), F.lit(False))
    return F.when(near, same).otherwise(F.lit(False))


def floats_close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Both NULL pass; one NULL, unparsable text, NaN or inf-inf fail."""
    da, db = a.try_cast("double"), b.try_cast("double")
    close = F.abs(da - db) <= F.lit(float(tolerance))
    return (a.isNull() & b.isNull()) | F.coalesce(close & ~F.isnan(da - db), F.lit(False))


def sequences_equal(a: Column, b: Column, ordered: bool) -> Column:
    """Array comparison.  Ordered: element-wise equality.  Unordered: equal
    length and each side contained in the other (so [1,1,2] ~ [1,2,2])."""
    both_null = a.isNull() & b.isNull()
    if ordered:
        same = a.eqNullSafe(b)
    else:
        same = (
            (F.size(a) == F.size(b))
            & (F.size(F.array_except(a, b)) == 0)
            & (F.size(F.array_except(b, a)) == 0)
        )
    return both_null | (a.isNotNull() & b.isNotNull() & F.coalesce(same, F.lit(False)))


def sized_length(c: Column, dt: T.DataType) -> Column | None:
    """Length of a sized value chosen from its type; None where the type has
    no length (such a check fails rather than raising)."""
    if is_string(dt):
        return F.length(c)
    if isinstance(dt, T.BinaryType):
        return F.octet_length(c)
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return F.when(c.isNotNull(), F.size(c))
    return None


def parse_count(raw: Column, floor: Column | int = 0) -> Column:
    """Trimmed text of ASCII digits parses to a number, anything else is 0;
    the result is at least ``floor``."""
    t = F.trim(raw)
    parsed = F.when(t.rlike("^[0-9]+$"), t.try_cast("long")).otherwise(F.lit(0))
    parsed = F.coalesce(parsed, F.lit(0))
    fl = floor if isinstance(floor, Column) else F.lit(floor)
    return F.greatest(parsed, fl.cast("long"))


def comparable_values(c: Column, dt: T.DataType, values: list[Any]) -> tuple[Column, T.DataType, list[Any], bool]:
    """Python ``x in values`` rules for a column of type ``dt``: the column
    as compared, the key type, the values that can equal it (other kinds
    never match: ``'1' != 1``), and whether None is in the list."""
    has_none = any(v is None for v in values)
    key_type: T.DataType = dt
    if is_string(dt):
        keep = [v for v in values if isinstance(v, str)]
        key_type = T.StringType()
    elif is_numeric(dt):
        numbers = [v for v in values if isinstance(v, (int, float, decimal.Decimal)) and v == v]
        kind = kind_of(dt)
        if kind in ("integral", "boolean"):
            c, key_type = c.cast("long"), T.LongType()
            keep = [int(v) for v in numbers if not _endless(v) and v == int(v) and -(1 << 63) <= v < 1 << 63]
        elif kind == "floating":
            c, key_type = c.cast("double"), T.DoubleType()
            keep = [float(v) for v in numbers if isinstance(v, decimal.Decimal) or float(v) == v]
        else:
            keep = [decimal.Decimal(repr(v)) if isinstance(v, float) else decimal.Decimal(v) for v in numbers if not _endless(v)]
            keep = [d for d in keep if -d.as_tuple().exponent <= dt.scale and d.adjusted() < dt.precision - dt.scale]
            keep = [d.quantize(decimal.Decimal(1).scaleb(-dt.scale), context=decimal.Context(prec=38)) for d in keep]
    else:
        keep = [v for v in values if v is not None and kind_of(lit_type(v)) == kind_of(dt)]
    return c, key_type, keep, has_none


def _endless(v: Any) -> bool:
    return math.isinf(v)


def in_values(c: Column, dt: T.DataType, values: list[Any]) -> Column:
    """Python ``x in values``: membership with Python equality, NULL allowed
    when the list holds None.  Values of another kind never match."""
    cc, _key_type, keep, has_none = comparable_values(c, dt, values)
    member = cc.isin(keep) if keep else F.lit(False)
    out = F.coalesce(member, F.lit(False))
    if has_none:
        out = out | c.isNull()
    return out
