"""Value rules (FIXTURES section 2: floats, sequences, counts, users)."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import text as TX
from vouch.functions import values as V


def test_floats_close(spark):
    rows = [
        (None, None, 0.01, True),        # both NULL pass
        (1.0, None, 0.01, False),        # one NULL fails
        (1.0, 1.01, 0.01, None),         # exactly tol apart: decided below with Python floats
        (float("nan"), 1.0, 0.01, False),
        (float("nan"), float("nan"), 0.01, False),
        (float("inf"), float("inf"), 0.01, False),
        (2.0, 2.5, 1.0, True),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "a double, b double, tol double")
    got = [r.ok for r in df.select(V.floats_close(F.col("a"), F.col("b"), 0.01).alias("ok")).collect()]
    want = []
    for a, b, tol, exp in rows:
        if a is None and b is None:
            want.append(True)
        elif a is None or b is None:
            want.append(False)
        else:
            want.append(abs(a - b) <= 0.01)
    assert got == want


def test_floats_from_text(spark):
    df = spark.createDataFrame([(" 12 ", "12.001"), ("abc", "1"), ("", "0"), ("1e1", "10")], "a string, b string")
    got = [r.ok for r in df.select(V.floats_close(F.col("a"), F.col("b")).alias("ok")).collect()]
    assert got == [True, False, False, True]


def test_sequences(spark):
    df = spark.createDataFrame(
        [([1, 1, 2], [1, 2, 2]), ([1, 2, 3], [3, 2, 1]), ([1, 2], [1, 2, 2]), (None, None), (None, [1]), ([], [])],
        "a array<int>, b array<int>",
    )
    out = df.select(
        V.sequences_equal(F.col("a"), F.col("b"), True).alias("ordered"),
        V.sequences_equal(F.col("a"), F.col("b"), False).alias("unordered"),
    ).collect()
    assert [r.ordered for r in out] == [False, False, False, True, False, True]
    assert [r.unordered for r in out] == [True, True, False, True, False, True]


def test_python_equality(spark):
    df = spark.createDataFrame([("1", 1, 1.0, True, None)], "s string, i long, d double, b boolean, n string")
    sch = {f.name: f.dataType for f in df.schema.fields}
    c = lambda n: (F.col(n), sch[n])
    r = df.select(
        V.py_equal(*c("s"), *c("i")).alias("s_i"),      # '1' == 1 -> False
        V.py_equal(*c("i"), *c("d")).alias("i_d"),      # 1 == 1.0 -> True
        V.py_equal(*c("b"), *c("i")).alias("b_i"),      # True == 1 -> True
        V.py_equal(*c("n"), F.lit(None), T.NullType()).alias("n_n"),  # None == None
        V.py_equal(*c("s"), *c("n")).alias("s_n"),
    ).first()
    assert (r.s_i, r.i_d, r.b_i, r.n_n, r.s_n) == (False, True, True, True, False)


def test_in_values(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "v string")
    with_none = [r.ok for r in df.select(V.in_values(F.col("v"), T.StringType(), ["a", None, 1]).alias("ok")).collect()]
    without = [r.ok for r in df.select(V.in_values(F.col("v"), T.StringType(), ["a"]).alias("ok")).collect()]
    assert with_none == [True, True, False]
    assert without == [True, False, False]


def test_parse_count(spark):
    df = spark.createDataFrame([(" 12 ",), ("-5",), ("abc",), ("",), (None,)], "raw string")
    got = [r.n for r in df.select(V.parse_count(F.col("raw"), 3).alias("n")).collect()]
    assert got == [12, 3, 3, 3, 3]


def test_clean_string_matches_python_rule(spark):
    import re

    def py_clean(v, r="_"):
        v = re.sub(r"[^a-zA-Z0-9]", r, str(v))
        while r + r in v:
            v = v.replace(r + r, r)
        return v

    values = ["mickey.mouse", "Donald..Duck!!", "a__b", "__x__", "plain", "UP-case", "é-accent", "a--b", "x y z"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in ["_", "-"]:
        got = [x.c for x in df.select(TX.clean_string("v", r).alias("c")).collect()]
        assert got == [py_clean(v, r) for v in values]


def test_hint_rendering(spark):
    import html

    vals = ["Bananas", None, "<a href='x'>&</a>", 'say "hi"']
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    tmpl = "Found, [[ACTUAL_VALUE]] ([[LEN_ACTUAL_VALUE]])"
    got = [r.h for r in df.select(TX.render_hint(F.lit(tmpl), F.col("v"), F.length("v")).alias("h")).collect()]
    want = []
    for v in vals:
        esc = html.escape(str(v))
        try:
            n = str(len(v))
        except TypeError:
            n = esc
        want.append(tmpl.replace("[[ACTUAL_VALUE]]", esc).replace("[[LEN_ACTUAL_VALUE]]", n))
    assert got == want
    assert got[0] == "Found, Bananas (7)" and got[1] == "Found, None (None)"


def test_line_count(spark):
    vals = ["", "a", "a\nb", "a\n", None]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r.n for r in df.select(TX.line_count("t").alias("n")).collect()]
    assert got[:4] == [len(v.split("\n")) + 1 for v in vals[:4]]


def test_path_parts(spark):
    vals = ["dbfs:/mnt/data/a/b.csv", "dbfs:/mnt/data/dir/", "plain/x", "/abs//"]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    r = df.select(
        TX.strip_prefix("p", "dbfs:/mnt/data/").alias("rel"), TX.path_kind("p").alias("kind"),
        TX.base_name("p").alias("base"), TX.rewrite_scheme("p", "dbfs", "/dbfs").alias("local"),
    ).collect()
    assert [x.rel for x in r] == ["a/b.csv", "dir/", "plain/x", "/abs//"]
    assert [x.kind for x in r] == ["file", "path", "file", "path"]
    assert [x.base for x in r] == ["b.csv", "dir", "x", "abs"]
    assert [x.local for x in r] == ["/dbfs/mnt/data/a/b.csv", "/dbfs/mnt/data/dir/", "plain/x", "/abs//"]
