"""Property tests: Column rules against plain-Python statements of the rules.

Each example is a batch of generated rows evaluated in one Spark job.
"""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vouch.functions import text as TX
from vouch.functions import values as V

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))

floats = st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True, width=64),
                   st.integers(-5, 5).map(float))


def py_close(a, b, tol):
    if a is None and b is None:
        return True
    try:
        return abs(float(a) - float(b)) <= tol
    except Exception:
        return False


@SETTINGS
@given(st.lists(st.tuples(floats, floats), min_size=1, max_size=40), st.sampled_from([0.0, 0.01, 1.0]))
def test_floats_close_matches_python(spark, rows, tol):
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r.ok for r in df.select(V.floats_close(F.col("a"), F.col("b"), tol).alias("ok")).collect()]
    assert got == [py_close(a, b, tol) for a, b in rows]


small_lists = st.one_of(st.none(), st.lists(st.integers(0, 3), max_size=5))


def py_seq(a, b, ordered):
    if a is None and b is None:
        return True
    if a is None or b is None or len(a) != len(b):
        return False
    if ordered:
        return a == b
    return all(x in b for x in a) and all(x in a for x in b)


@SETTINGS
@given(st.lists(st.tuples(small_lists, small_lists), min_size=1, max_size=40))
def test_sequences_match_python(spark, rows):
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    out = df.select(V.sequences_equal(F.col("a"), F.col("b"), True).alias("o"),
                    V.sequences_equal(F.col("a"), F.col("b"), False).alias("u")).collect()
    assert [r.o for r in out] == [py_seq(a, b, True) for a, b in rows]
    assert [r.u for r in out] == [py_seq(a, b, False) for a, b in rows]


names = st.text(alphabet=st.sampled_from(list("aZ9_-. @#é")), max_size=12)


def py_clean(v, r="_"):
    v = re.sub(r"[^a-zA-Z0-9]", r, v)
    while r + r in v:
        v = v.replace(r + r, r)
    return v


@SETTINGS
@given(st.lists(names, min_size=1, max_size=40))
def test_clean_string_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.c for r in df.select(TX.clean_string("v").alias("c")).collect()]
    assert got == [py_clean(v) for v in values]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=40),
       st.lists(st.one_of(st.none(), st.integers(-3, 3), st.floats(-3, 3, allow_nan=False), st.text(max_size=1)),
                max_size=6))
def test_membership_matches_python(spark, values, allowed):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r.ok for r in df.select(V.in_values(F.col("v"), T.LongType(), allowed).alias("ok")).collect()]
    assert got == [v in allowed for v in values]
