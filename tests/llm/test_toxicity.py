import random

import numpy as np
from pyspark.sql import functions as F

import edge
from vouch.llm import toxicity as T
from vouch.sources.tables import Tables


def test_held_out_accuracy(spark):
    t = Tables(spark, "/root/testdata/sf0.1")
    held = F.pmod(F.xxhash64(F.lit("split"), F.col("doc_id")), F.lit(4)) == 0
    model = T.learn(t.documents, t.labels.filter(~held), "toxic", spread=3)
    out = T.grade_documents(t.documents, model).withColumnRenamed("toxic", "said").join(t.labels.filter(held), "doc_id")
    n = {(r["toxic"], r["said"]): r["count"] for r in out.groupBy("toxic", "said").count().collect()}
    assert n[(0, False)] >= 0.99 * (n[(0, False)] + n.get((0, True), 0))
    assert n[(1, True)] >= 0.85 * (n[(1, True)] + n.get((1, False), 0))


def test_ordered_grades_share_weights(spark):
    rng = random.Random(4)
    bad = [f"bad{i}" for i in range(8)]
    rows, marks = [], []
    for i in range(600):
        grade = i % 4
        words = [f"w{rng.randrange(400)}" for _ in range(60)] + rng.sample(bad, 2 * grade)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, grade))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = T.learn(docs.filter("doc_id < 400"), spark.createDataFrame(marks, "doc_id bigint, grade int"), "grade")
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    out = T.grade_documents(docs.filter("doc_id >= 400"), model).collect()
    assert np.mean([r["grade"] == r["doc_id"] % 4 for r in out]) > 0.7
    mean = [np.mean([r["severity"] for r in out if r["doc_id"] % 4 == g]) for g in range(4)]
    assert all(a + 0.5 < b for a, b in zip(mean, mean[1:]))


def test_probabilities_follow_the_links():
    m = T.OrdinalModel({T.feature_id("wbad"): 2.0}, np.array([1.0, 3.0]))
    assert m.score("Bad, bad. good") == 4.0 and m.score(None) == 0.0
    above = m.exceed(np.array([2.0]))[0]
    assert np.allclose(above, [1 / (1 + np.exp(-1)), 1 / (1 + np.exp(1))])


def test_edge_rows_and_empty_tables(spark):
    docs = edge.documents(spark)
    labels = spark.createDataFrame([(7, 1), (7, 0), (5, 0), (9, None), (None, 1), (4, 0)], "doc_id bigint, toxic int")
    for marks in (labels, labels.limit(0), labels.filter("toxic = 0")):
        model = T.learn(docs, marks, "toxic", spread=3)
        out = T.grade_documents(docs, model, docs.columns)
        assert out.count() == docs.count()
        if model is None:
            assert out.filter("severity <> 0").count() == 0
    assert T.grade_documents(edge.empty(spark), None).count() == 0


def plain_score(text, weights):
    """Distinct lower-cased words without signs around them; a word and its first 3, 4, 5 letters count each."""
    import xxhash

    total = 0.0
    for token in set((text or "").lower().split()):
        w = token.strip(T._STRIP)
        names = [] if not w else ["w" + w] + ["p" + w[:k] for k in (3, 4, 5) if len(w) >= k]
        total += sum(weights.get(xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) // 2, 0.0) for n in names)
    return total


def test_grading_equals_a_plain_scorer(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    model = T.learn(t.documents, t.labels, "toxic", spread=3)
    texts = {r["doc_id"]: r["text"] for r in t.documents.collect()}
    for r in T.grade_documents(t.documents, model).collect():
        s = plain_score(texts[r["doc_id"]], model.weights)
        above = [1 / (1 + np.exp(np.clip(c - s, -500, 500))) for c in model.thresholds]
        p = [1 - above[0], *[a - b for a, b in zip(above, above[1:])], above[-1]]
        assert abs(r["score"] - s) < 1e-6 and abs(r["severity"] - sum(above)) < 1e-6
        assert abs(p[r["grade"]] - max(p)) < 1e-9 and r["toxic"] == (above[0] > 0.5)


def test_fit_reaches_the_likelihood_of_a_plain_descent():
    rng = np.random.default_rng(3)
    n, k, f = 300, 3, 6
    x = rng.integers(0, 3, (n, f)).astype(float)
    s = x @ np.array([1.5, -1.0, 0.5, 0.0, 0.0, 1.0])
    y = (s + rng.logistic(size=n) > 2).astype(int) + (s + rng.logistic(size=n) > 4).astype(int)
    rows, cols = np.nonzero(x)
    w, t = T.fit_ordinal(rows, cols, x[rows, cols], y, f, l1=0.0, steps=2000)
    weight = n / (k * np.bincount(y, minlength=k))

    def loss(w, t):
        cum = np.column_stack([np.zeros(n), 1 / (1 + np.exp(x @ w - t[0])), 1 / (1 + np.exp(x @ w - t[1])), np.ones(n)])
        p = np.maximum(cum[np.arange(n), y + 1] - cum[np.arange(n), y], 1e-12)
        return float(-(weight[y] * np.log(p)).sum() / n)

    best = (np.zeros(f), np.array([-1.0, 1.0]))
    for _ in range(4000):  # numerical gradient, small steps
        g = []
        for i in range(f + 2):
            d = np.zeros(f + 2)
            d[i] = 1e-5
            g.append((loss(best[0] + d[:f], best[1] + d[f:]) - loss(best[0] - d[:f], best[1] - d[f:])) / 2e-5)
        best = (best[0] - 0.1 * np.array(g[:f]), best[1] - 0.1 * np.array(g[f:]))
    assert loss(w, t) <= loss(*best) + 1e-3


def test_a_repeated_id_is_learned_always_alike(spark):
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} word{i % 7}") for i in range(200)] + [(1, "another text of one"), (3, None)], "doc_id bigint, text string")
    marks = spark.range(200).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    fits = [T.learn(d, marks, "toxic") for d in (docs, docs.orderBy(F.desc("text")).repartition(7))]
    assert fits[0].weights == fits[1].weights and (fits[0].thresholds == fits[1].thresholds).all()
