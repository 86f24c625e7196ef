"""Recall of copies by the length of the item, on more items than the rank."""

import random
import re

import pytest

from vouch.llm import latent_decontam as L

SYLLABLES = ["ka", "lo", "mi", "ra", "tu", "ves", "dor", "pel", "sin", "qua", "bem", "fot"]
COMMON = ["the", "of", "and", "is", "to"]


def prose(rng, n):
    return [rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choice(SYLLABLES) for _ in range(3)) for _ in range(n)]


def planted(spark, seed, lengths, n_items, copies, change=0.0):
    """Documents with and without a copy of an item; ``change`` of the copy's words are replaced."""
    rng = random.Random(seed)
    items = [prose(rng, rng.randint(*lengths)) for _ in range(n_items)]
    rows, held = [], set()
    for i in range(2 * copies):
        words = prose(rng, rng.randint(100, 400))
        if i % 2:
            copy = [prose(rng, 1)[0] if rng.random() < change else w for w in items[i // 2 % n_items]]
            at = rng.randrange(len(words))
            words[at:at] = copy
            held.add((i, i // 2 % n_items))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    return docs, bench, held


def found(docs, bench, s=None):
    return {(r["doc_id"], r["item_id"]) for r in L.find_contamination(docs, bench, s).collect()}


@pytest.mark.parametrize("lengths, change", [((150, 300), 0.0), ((150, 1000), 0.15)])
def test_long_items_are_found_in_full(spark, lengths, change):
    docs, bench, held = planted(spark, 5, lengths, 140, 140, change)
    assert found(docs, bench) == held


def test_half_of_a_long_item_is_no_match(spark):
    _, bench, _ = planted(spark, 5, (400, 1000), 20, 1)
    halves = [(r["item_id"], " ".join(r["text"].split()[:len(r["text"].split()) // 2])) for r in bench.collect()]
    assert not found(spark.createDataFrame(halves, "doc_id bigint, text string"), bench)


def test_blocks_are_bounded_by_units_of_long_items(spark):
    docs, bench, held = planted(spark, 6, (400, 600), 12, 24)
    s = L.Settings(items_per_block=100)
    assert len(list(L.item_blocks(bench, s))) > 1
    assert found(docs, bench, s) == held


def near(item, words):
    """Plain check: all words of the item but a sixth (none of seven) in order in as short a place."""
    misses = 0 if len(item) < 8 else len(item) // 6
    for at in range(-misses, len(words)):
        part = words[max(at, 0):at + len(item) + 2 * misses]
        row = [0] * (len(item) + 1)
        for y in part:
            new = [0]
            for j, x in enumerate(item):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        if row[-1] >= len(item) - misses:
            return True
    return False


@pytest.mark.parametrize("lengths", [(1, 3), (4, 6), (7, 10), (11, 20)])
def test_short_items_are_found_in_full_and_not_by_chance(spark, lengths):
    docs, bench, held = planted(spark, 7, lengths, 200, 200)
    got = found(docs, bench)
    texts, items = ({r[0]: r[1].split() for r in df.collect()} for df in (docs, bench))
    assert held <= got
    assert all(near(items[k], texts[d]) for d, k in got - held)
    if lengths[1] <= 6:  # word for word, and all that are
        say = {d: f" {' '.join(w)} " for d, w in texts.items()}
        assert got == {(d, k) for d, t in say.items() for k, w in items.items() if f" {' '.join(w)} " in t}
    else:
        assert got == held


def test_random_short_items_match_real_text_only_word_for_word(spark):
    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = [w for r in docs.limit(300).collect() for w in (r["text"] or "").lower().split() if w.isalpha()]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 6))) for _ in range(200)]
    got = found(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    texts = {r["doc_id"]: " " + " ".join(re.findall(r"[^\W_]+", (r["text"] or "").lower())) + " " for r in docs.collect()}
    assert all(f" {items[k]} " in texts[d] for d, k in got)


def test_an_item_of_common_words_changes_no_other_item(spark):
    docs, bench, held = planted(spark, 7, (11, 60), 60, 120)
    alone = found(docs, bench)
    assert alone == held
    more = bench.union(spark.createDataFrame([(1000, "the of and is to the of and is to the of and is to to"), (1001, "the and"), (1002, "of the to is")], bench.schema))
    assert {p for p in found(docs, more) if p[1] < 1000} == alone


def test_columns_with_dots_are_kept(spark):
    docs, bench, held = planted(spark, 7, (11, 20), 20, 10)
    rows = docs.selectExpr("*", "1 AS `a.b`", "map('k', 1) AS m", "2 AS parts")
    out = L.clean_documents(rows, bench)
    assert out.columns == rows.columns and out.count() == 20 - len({d for d, _k in held})


def test_words_of_a_short_item_far_apart_are_no_match(spark):
    item = ["kalomi", "ratuves", "dorpelsin", "quabemfot"]
    rng = random.Random(8)
    apart = [w for word in item for w in [word, *prose(rng, 120)]]
    rows = [(1, apart), (2, [*prose(rng, 90), *item, *prose(rng, 90)]), *[(i, prose(rng, 300)) for i in range(3, 100)]]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in rows], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert found(docs, bench) == {(2, 7)}
