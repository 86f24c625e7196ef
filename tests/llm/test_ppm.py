import math
import random

import numpy as np
from pyspark.sql import functions as F

import edge
from vouch.llm import ppm_language as P
from vouch.sources.tables import Tables


def naive_bits(texts, text, order):
    """Code length by the definition: counts of every context, escapes with exclusion."""
    counts = {}
    for t in texts:
        raw = b" " * order + t.encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                c = counts.setdefault(raw[i - k:i], {})
                c[raw[i]] = c.get(raw[i], 0) + 1
    raw, bits = b" " * order + text.encode(), 0.0
    for i in range(order, len(raw)):
        offered, escape = set(), 1.0
        for k in range(order, -1, -1):
            left = {s: c for s, c in counts.get(raw[i - k:i], {}).items() if s not in offered}
            total = sum(left.values()) + len(left)
            if raw[i] in left:
                bits -= math.log2(escape * left[raw[i]] / total)
                break
            if left:
                escape *= len(left) / total
            offered |= set(left)
        else:
            bits -= math.log2(escape / (256 - len(offered)))
    return bits


def trees(spark, rows, order, **bound):
    return P.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), order=order, **bound)


def test_code_lengths_equal_the_definition(spark):
    rng = random.Random(1)
    texts = {"a": ["".join(rng.choice("abcde ") for _ in range(300)) for _ in range(3)], "b": ["".join(rng.choice("bdfgé ") for _ in range(200)) for _ in range(2)]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    for order in (1, 2, 3):
        model = trees(spark, rows, order)
        for probe in ("abc def", "zzz", "é", texts["a"][0] + texts["b"][0]):
            want = [naive_bits(texts[lang], probe, order) for lang in ("a", "b")]
            assert np.allclose(model.lengths([probe.encode()])[0], want, rtol=1e-5)


def test_long_texts_in_pieces_and_bounded_trees(spark, monkeypatch):
    rows = [(1, "the cat sat on the mat and the dog ran " * 20, "en"), (2, "der hund und die katze sind im haus " * 20, "de")]
    model = trees(spark, rows, 3)
    probe = ("the dog und " * 700).encode()
    whole = model.lengths([probe, b"cat"])
    monkeypatch.setattr(P, "_CHUNK", 100)
    assert np.allclose(model.lengths([probe, b"cat"]), whole)
    small = trees(spark, rows, 3, max_cells=2000)
    assert small.cost.size <= 2000 and P.predict(small, ["the dog and the cat"])[0] == ["en"]


def test_held_out_accuracy(spark):
    docs = Tables(spark, "/root/testdata/sf0.01").documents
    docs = docs.withColumn("held_out", P.held_out())
    out = P.identify(docs, P.learn(docs.filter("NOT held_out")), ["doc_id", "held_out"]).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out AND lang_pred <> 'und'")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert out.filter("score < 0 OR score > 1").count() == 0


def test_edge_rows_and_empty_tables(spark):
    docs = edge.documents(spark)
    model = P.learn(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in P.identify(docs, model, ["doc_id"]).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (9, "de")} <= got and (5, "und") not in got
    nothing = P.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None
    assert {r["lang_pred"] for r in P.identify(docs, None, ["doc_id"]).collect()} == {"und"}
    assert P.identify(edge.empty(spark), model, ["doc_id"]).count() == 0
