"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's grade y in 0..K-1 follows P(y <= k) = sigmoid(t_k - s), with one
score s = w . x for all thresholds t_0 < t_1 < ...; its expected severity is
the sum over k of P(y > k).  Features are the document's distinct words and
their first 3, 4 and 5 letters; x counts the distinct words that have one.

The fit takes a bounded sample of the labelled documents (about
``per_grade`` of each grade, drawn by a hash of the id).  The ``n_features``
features whose document rates differ most between grade 0 and the others are
kept, and w is made sparse by an L1 penalty (proximal gradient steps), so long
clean texts gather no score from ordinary words.

Results: a null text or one without words has score 0; without labels, or with
one grade only, nothing is learned and every severity is 0; a document with
several labels has the highest, one with several texts is learned by the least
of them; labels are matched by ids that cast to bigint; repeated rows are scored
alike; no documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from vouch.llm.common import sampled, small_batches

_STRIP = ".,;:!?\"'()[]{}<>*#$%&/\\-_=+~`|…„“”«»¿¡"
_CACHE = 1 << 17
#: Least distance of two thresholds.
_GAP = 1e-3


def word_features(token: str) -> list[str]:
    """Features of a lower-cased token: the word and its beginnings."""
    w = token.strip(_STRIP)
    return [f"w{w}", *[f"p{w[:k]}" for k in (3, 4, 5) if len(w) >= k]] if w else []


def tokens(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def feature_id(name: str) -> int:
    return xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) >> 1


@dataclass
class OrdinalModel:
    """Weights by feature id, and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        known, total = self._known, 0.0
        for t in tokens(text):
            s = known.get(t)
            if s is None:
                if len(known) >= _CACHE:
                    known.clear()
                s = known[t] = sum(self.weights.get(feature_id(f), 0.0) for f in word_features(t))
            total += s
        return total

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_features: int,
                l1: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model (accelerated proximal
    gradient, all thresholds share the weights).  ``rows``/``cols``/``vals``
    are the non-zero features; ``y`` holds grades 0..K-1, all of them present.
    """
    n, k = len(y), int(y.max()) + 1
    grade_weight = n / (k * np.bincount(y, minlength=k).astype(float))
    g = grade_weight[y] / n
    share = np.cumsum(np.bincount(y, weights=grade_weight[y], minlength=k))[:-1] / n
    theta = np.log(share / (1 - share))
    w = np.zeros(n_features)
    scale = np.bincount(cols, weights=vals ** 2 * g[rows], minlength=n_features) + 1e-6
    rate = 1.0 / np.maximum(np.bincount(rows, weights=vals, minlength=n).max() ** 0.5, 1.0)
    vw, vt, w_old, momentum = w.copy(), theta, w, 1.0
    for _ in range(steps):
        s = np.bincount(rows, weights=vals * vw[cols], minlength=n)
        t = np.concatenate([[-np.inf], vt, [np.inf]])
        hi, lo = _sigmoid(t[y + 1] - s), _sigmoid(t[y] - s)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        ds = g * (dhi - dlo) / p
        dt = np.bincount(y, weights=-g * dhi / p, minlength=k)[:-1] + np.bincount(y, weights=g * dlo / p, minlength=k)[1:]
        step = rate / np.sqrt(scale)
        new = vw - step * np.bincount(cols, weights=vals * ds[rows], minlength=n_features)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0.0)
        # Thresholds take a plain step and stay in order.
        vt = np.maximum.accumulate(vt - np.clip(dt, -1.0, 1.0) - _GAP * np.arange(k - 1)) + _GAP * np.arange(k - 1)
        m = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        vw, w_old, momentum = new + (momentum - 1) / m * (new - w_old), new, m
    return w_old, vt


def _sample_features(rows: DataFrame) -> DataFrame:
    """(doc, grade, feature, n) of the sample."""

    def run(batches):
        for b in batches:
            docs, grades, feats, counts = [], [], [], []
            for doc, grade, text in zip(b.column("doc_id").to_pylist(), b.column("grade").to_pylist(), b.column("text").to_pylist(), strict=True):
                found: dict[int, int] = {}
                for t in tokens(text):
                    for f in word_features(t):
                        i = feature_id(f)
                        found[i] = found.get(i, 0) + 1
                docs += [doc] * len(found)
                grades += [grade] * len(found)
                feats += found
                counts += found.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(grades, pa.int32()), pa.array(feats, pa.int64()), pa.array(counts, pa.int32())],
                ["doc", "grade", "feature", "n"])

    return rows.select("doc_id", "grade", "text").mapInArrow(run, "doc bigint, grade int, feature bigint, n int")


def learn(docs: DataFrame, labels: DataFrame, grade: str, per_grade: int = 2000, n_features: int = 1 << 13, min_docs: int = 4,
          spread: int = 1) -> OrdinalModel | None:
    """Fit on labels (doc_id, ``grade`` = 0, 1, ...) of ``docs``.

    With ``spread`` > 1 and two-valued labels the sample knows one threshold
    only.  The scores that cut its toxic documents in ``spread`` equal parts
    are then added as the further thresholds, over the same weights, so the
    grades above 0 tell how much evidence a text holds.
    """
    small_batches(docs.sparkSession)
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(grade).isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(grade).cast("int")).alias("grade"))
    # At most about per_grade rows for every grade, so the join may broadcast them.
    chosen = F.broadcast(sampled(marks, "grade", "doc_id", per_grade))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # of several texts of an id always the same one
    feats = _sample_features(texts).persist()
    try:
        sizes = {r["grade"]: r["n"] for r in feats.groupBy("grade").agg(F.countDistinct("doc").alias("n")).collect()}
        grades = sorted(sizes)
        if len(grades) < 2:
            return None
        n0, n1 = sizes[grades[0]], sum(sizes[g] for g in grades[1:])
        low = F.col("grade") == grades[0]
        rates = feats.groupBy("feature").agg(F.count(F.when(low, 1)).alias("a"), F.count(F.when(~low, 1)).alias("b"))
        both = (F.col("a") + F.col("b") + 1.0) / (n0 + n1 + 2.0)
        z = F.abs(F.col("a") / n0 - F.col("b") / n1) / F.sqrt(both * (1 - both) + 1e-9)
        best = rates.filter(F.col("a") + F.col("b") >= min_docs).orderBy(z.desc(), "feature").limit(n_features).select("feature")
        found = feats.join(F.broadcast(best), "feature").select("doc", "feature", "n").toArrow()
        everyone = feats.select("doc", "grade").distinct().toArrow()
    finally:
        feats.unpersist()
    ids, order = everyone["doc"].to_numpy(), everyone["grade"].to_numpy()
    y = np.searchsorted(np.array(grades), order[np.argsort(ids)])
    doc, feature = found["doc"].to_numpy(), found["feature"].to_numpy()
    line = np.lexsort((feature, doc))
    rows = np.searchsorted(np.sort(ids), doc[line]).astype(np.int32)
    names, cols = np.unique(feature[line], return_inverse=True)
    cols, vals = cols.astype(np.int32), found["n"].to_numpy()[line].astype(float)
    del found, doc, feature, line
    if not len(names):
        return None
    w, t = fit_ordinal(rows, cols, vals, y, len(names))
    if spread > 1 and len(grades) == 2:
        s = np.bincount(rows, weights=vals * w[cols], minlength=len(y))
        cuts = np.quantile(s[y == 1], np.arange(1, spread) / spread)
        t = np.maximum.accumulate(np.concatenate([t, cuts]) + 1e-6 * np.arange(spread))
    return OrdinalModel({int(f): float(x) for f, x in zip(names, w, strict=True) if x}, t)


def grade_documents(docs: DataFrame, model: OrdinalModel | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with score, severity (expected grade), grade (most
    likely) and toxic (grade 0 is less likely than the others together)."""
    keep = ["doc_id"] if keep is None else keep
    return _graded(docs, model, keep).toDF(*keep, "score", "severity", "grade", "toxic")


def clean_documents(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """The rows of ``docs`` that are not graded toxic, with all their columns."""
    graded = _graded(docs, model, docs.columns)
    return graded.filter("NOT _toxic").select(*graded.columns[:len(docs.columns)]).toDF(*docs.columns)


def _graded(docs: DataFrame, model: OrdinalModel | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` by number (so no name can clash) and the grading."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"))
    ids = [f"_{i}" for i in range(len(keep))]
    out = ["_score", "_severity", "_grade", "_toxic"]

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column("_text").to_pylist()
            s = np.array([m.score(t) for t in texts]) if m else np.zeros(len(texts))
            above = m.exceed(s) if m else np.zeros((len(s), 1))
            full = np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1)
            grade = (full[:, :-1] - full[:, 1:]).argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ids], pa.array(s), pa.array(above.sum(1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] > 0.5)], [*ids, *out])

    schema = rows.select(*ids, F.lit(0.0).alias("_score"), F.lit(0.0).alias("_severity"), F.lit(0).alias("_grade"), F.lit(True).alias("_toxic")).schema
    return rows.mapInArrow(run, schema)
