"""The rows that the stages of the pipeline keep, against plain versions (sharding keeps all: OP9_SQL)."""

import random
import re

import pytest

from compare_util import duck
from conftest import SMALL_SF
from test_toxicity import plain_score
from vouch.llm import queries as Q


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL_SF}/documents.parquet")


def kept(stage, spark, docs):
    return sorted(r["doc_id"] for r in stage(spark, docs, SMALL_SF).select("doc_id").collect())


def test_toxicity_keeps_what_the_model_does_not_reject(spark, docs):
    model = Q.toxicity_model(spark, SMALL_SF)
    toxic = {r["doc_id"]: plain_score(r["text"], model.weights) > model.thresholds[0] for r in docs.collect()}
    assert 0 < sum(toxic.values()) < len(toxic)
    assert kept(Q.stage_toxicity, spark, docs) == sorted(i for i, t in toxic.items() if not t)


def test_near_duplicates_keep_the_least_id_of_every_group(spark, docs):
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    ids = sorted(sets)
    name = {i: i for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and name[a] != name[b]:
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {i: new if n == old else n for i, n in name.items()}
    assert len(set(name.values())) < len(ids)
    assert kept(Q.stage_near_duplicates, spark, docs) == sorted(set(name.values()))


def test_decontamination_drops_planted_items_and_nothing_else(spark, docs):
    rng = random.Random(2)
    items = [r["text"] for r in spark.read.parquet(f"{SMALL_SF}/benchmark.parquet").orderBy("item_id").limit(20).collect()]
    words = ["".join(rng.choice(["ka", "lo", "mi", "ra", "tu", "ves"]) for _ in range(4)) for _ in range(3000)]
    plain = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(100)]
    planted = [(100 + i, f"{plain[i][1]} {t} {plain[i + 20][1]}") for i, t in enumerate(items)]
    rows = spark.createDataFrame(plain + planted, "doc_id bigint, text string")
    assert kept(Q.stage_decontamination, spark, rows) == list(range(100))


def test_mixing_repeats_documents_by_the_taken_words_of_the_sql(spark, docs):
    want = []
    for i, size, taken in duck(SMALL_SF).execute(f"SELECT doc_id, size, taken FROM ({Q.OP8_SQL})").fetchall():
        want += [i] * int(taken / size + 0.5) if size else []
    assert len(set(want)) < len(want)
    assert kept(Q.stage_mixing, spark, docs) == sorted(want)
