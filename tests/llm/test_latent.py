import random

import numpy as np
import pytest

import edge
from vouch.llm import latent_decontam as L

RNG = random.Random(11)
SYLLABLES = ["ka", "lo", "mi", "ra", "tu", "ves", "dor", "pel", "sin", "qua", "bem", "fot"]
COMMON = ["the", "of", "and", "is", "to"]


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(3))


def prose(n):
    return [RNG.choice(COMMON) if RNG.random() < 0.4 else word() for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    items = [" ".join(prose(RNG.randint(18, 50))) + ". The answer " + " ".join(word() for _ in range(4)) + "." for _ in range(60)]
    rows, copies, reworded = [], set(), set()
    for i in range(400):
        words = prose(RNG.randint(30, 600))
        if i % 5 == 0:
            k = RNG.randrange(len(items))
            w = items[k].upper().split() if i % 2 else items[k].split()
            if i % 10 == 5:  # two of five words before the answer are replaced
                w = [word() if j < len(w) - 6 and RNG.random() < 0.4 else x for j, x in enumerate(w)]
                reworded.add((i, k))
            else:
                copies.add((i, k))
            at = RNG.randrange(len(words))
            words[at:at] = w
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return docs, bench, copies, reworded


def test_copies_and_paraphrases_are_found_and_clean_documents_left(planted):
    docs, bench, copies, reworded = planted
    found = {(r["doc_id"], r["item_id"]) for r in L.find_contamination(docs, bench).collect()}
    assert copies <= found
    assert len(reworded & found) >= 0.9 * len(reworded)
    assert found <= copies | reworded
    kept = {r["doc_id"] for r in L.clean_documents(docs, bench).select("doc_id").collect()}
    assert kept == {i for i in range(400)} - {i for i, _ in found}


def test_blocks_of_items_give_the_same_matches(planted):
    docs, bench, copies, _ = planted
    found = {(r["doc_id"], r["item_id"]) for r in L.find_contamination(docs, bench, L.Settings(items_per_block=25)).collect()}
    assert copies <= found


def test_candidate_recall_against_all_cosines(planted):
    """Of the windows whose full TF-IDF cosine with an item is high, the latent search finds 0.9 or more."""
    docs, bench, _, _ = planted
    s = L.Settings()
    corpus = L.read_corpus(docs, s)
    judge = L.make_judge(corpus, [(r["item_id"], r["text"]) for r in bench.collect()], s)
    idf = corpus.idf
    hits = met = 0
    for r in docs.collect():
        ids = judge.content(L.word_ids(r["text"]))
        for first in range(0, max(len(ids) - 16, 1), 16):
            t = ids[first:first + 32] & (len(idf) - 1)
            v = judge.embed[judge.slots[t]].sum(0)
            norm = float(judge.square[t].sum()) ** 0.5
            for k, item in enumerate(judge.items):
                q = item.words & (len(idf) - 1)
                shared = np.intersect1d(t, q)
                full = float((idf[shared] ** 2).sum()) / max(norm * float(judge.square[q].sum()) ** 0.5, 1e-9)
                if full >= 0.5:
                    hits += 1
                    met += float(v @ judge.q[:, k]) / norm >= s.min_cosine
    assert hits > 20 and met >= 0.9 * hits


def test_common_subsequence_equals_the_table():
    for _ in range(200):
        a = [RNG.randint(1, 6) for _ in range(RNG.randint(1, 30))]
        b = [RNG.randint(1, 6) for _ in range(RNG.randint(0, 80))]
        row = [0] * (len(a) + 1)
        for y in b:
            new = [0]
            for j, x in enumerate(a):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert L.common_subsequence(L.masks(np.array(a)), len(a), b) == row[-1]


def test_long_documents_are_read_whole(spark, planted):
    _, bench, _, _ = planted
    item = bench.filter("item_id = 3").first()["text"]
    docs = spark.createDataFrame([(1, " ".join(prose(150_000)) + " " + item), (2, item), (3, None), (4, "")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in L.find_contamination(docs, bench).collect()}
    assert found == {(1, 3), (2, 3)}


def test_edge_rows_and_empty_tables(spark, planted):
    _, bench, _, _ = planted
    docs = edge.documents(spark)
    out = L.clean_documents(docs, bench)
    assert out.columns == docs.columns and out.count() == docs.count()
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert L.find_contamination(docs, none).count() == 0
    assert L.find_contamination(edge.empty(spark), bench).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "...")], "item_id bigint, text string")
    assert L.find_contamination(docs, blank).count() == 0


def test_the_space_is_fitted_on_every_passage(spark, planted):
    """Of more documents than their weight every passage counts, not a drawn part."""
    docs, bench, _, _ = planted
    s = L.Settings(corpus_weight=50.0)
    corpus = L.read_corpus(docs, s)
    assert sorted(len(r["words"]) // 4 for r in corpus.rows.collect()) == sorted(len(L.word_ids(r["text"])) for r in docs.collect())
    assert corpus.weight ** 2 == pytest.approx(50 / 400)
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    used = np.unique(np.concatenate([L.word_ids(t) & 0xFFFF for _, t in items]))
    slots = np.zeros(1 << 16, np.int32)
    slots[used] = np.arange(1, len(used) + 1)
    texts = [(t, 1.0 / 8) for t in (r["text"] for r in docs.collect())] + [(t, 900.0) for _, t in items]
    gram = np.zeros((len(used) + 1,) * 2)
    for text, weight in texts:
        ids = L.word_ids(text) & 0xFFFF
        for i in range(0, len(ids), 64):
            row, w = np.zeros(len(gram)), corpus.idf[ids[i:i + 64]]
            np.add.at(row, slots[ids[i:i + 64]], w)
            row[0] = 0.0
            row /= max(float(w @ w), 1e-12) ** 0.5
            gram += weight * np.outer(row, row)
    basis = L.make_judge(corpus, items, s).embed / np.append(0.0, corpus.idf[used])[:, None].clip(1e-9)
    held = np.trace(basis.T @ gram @ basis) / np.linalg.eigvalsh(gram)[::-1][:s.rank].sum()
    assert held > 0.99


def test_recall_where_documents_are_more_than_their_weight(spark, planted):
    docs, bench, copies, reworded = planted
    found = {(r["doc_id"], r["item_id"]) for r in L.find_contamination(docs, bench, L.Settings(corpus_weight=20.0)).collect()}
    assert copies <= found <= copies | reworded
    assert len(reworded & found) >= 0.9 * len(reworded)


def test_clean_documents_agree_where_documents_are_more_than_their_weight(spark, planted):
    docs, bench, _, _ = planted
    s = L.Settings(corpus_weight=20.0)
    found = {r["doc_id"] for r in L.find_contamination(docs, bench, s).collect()}
    assert {r["doc_id"] for r in L.clean_documents(docs, bench, s).collect()} == set(range(400)) - found
    assert not hasattr(L, "drawn_documents")
