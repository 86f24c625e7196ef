"""Benchmark decontamination by latent semantic retrieval and alignment.

1. Term weights: inverse frequencies of hashed words over the 64-word passages
   of all documents (counters of fixed size, summed over tasks).  Words in more
   than ``common`` of the passages are no content words.
2. Latent space: a randomised SVD of the TF-IDF matrix of passages, over the
   terms that the items have (other words count in the norms).  The passages
   are those of the benchmark items, which weigh ``item_weight`` times as much,
   and of all documents, which weigh together as ``corpus_weight`` of them.  A
   random test matrix is multiplied by A'A twice over the items, which gives the
   subspace that A'A of all passages is then applied to; every product is a Spark
   job whose tasks emit their share of the (terms x rank) result in pieces, which
   are summed by piece.
3. Candidates: every whole document is cut in windows of 32 words (step 16)
   and 64 words (step 32), and items in units of at most 64 words (step 16).  A
   window is a candidate for an item when the cosine of its TF-IDF vector with
   a unit's vector in the latent space reaches ``min_cosine`` times the unit's
   own cosine with it.  An item of fewer than 16 content words, or made mostly
   of common words, is small beside a window: it is also scored with all its
   words in windows as long as itself, which lie where a run of four of its
   words stands (such a match cannot be without one of these runs).
4. Checks: the longest common subsequence of the item's words and those of the
   place where the whole item would lie (with a margin) has to cover ``copied``
   of the item; or ``reworded`` of it, when it also covers ``answered`` of the
   item's answer (its last sentence).  In the short windows an item has to be
   there word for word (of 8 words or more, all but a sixth of them), and for
   fewer than 8 content words, which could meet by chance, nothing else counts.

What an item matches depends on no other item but through the latent space.
Items are taken in blocks of bounded size, each against all documents.

Results: a null or empty text, or one without words, is clean; an item without
words matches nothing; repeated rows are judged alike; items with equal texts
are each reported; no documents or no items give no matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from vouch.llm.common import small_batches, written

_BLOCK = 16
_MARGIN = 16
#: Content words of a unit of an item.
_UNIT = 4 * _BLOCK
#: Items of fewer content words are also sought with all their words, by runs of
#: so many; items of fewer content words than _FEW only so.
_SHORT, _FEW, _RUN = _BLOCK, 8, 4
#: Units that are scored together.
_UNITS = 1 << 12
#: Words of documents that are scored together.
_WORDS = 1 << 16
_PIECE = 1 << 10


#: ASCII characters other than letters and digits part words.
_PARTS_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def word_ids(text: str | None) -> np.ndarray:
    """30-bit hashes (1 at least) of the lower-cased words."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS_WORDS).split()
    ids = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    return np.maximum((ids >> np.uint64(34)).astype(np.int64), 1)


@dataclass(frozen=True)
class Settings:
    rank: int = 128
    term_bits: int = 16
    corpus_weight: float = 500.0
    item_weight: float = 30.0
    common: float = 0.1
    items_per_block: int = 4096
    min_cosine: float = 0.36
    copied: float = 0.7
    reworded: float = 0.5
    answered: float = 0.8


# -- sums over tasks ---------------------------------------------------------


def _pieces_of(values: np.ndarray, part: int):
    step = min(_PIECE, len(values))
    for i in range(0, len(values), step):
        piece = values[i:i + step]
        if piece.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // step], pa.int32()), pa.array([part], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["piece", "part", "data"])


def _add(batches):
    at, total = None, None
    names = ["piece", "data"]
    for b in batches:
        for piece, raw in zip(b.column("piece").to_pylist(), b.column("data").to_pylist(), strict=True):
            part = np.frombuffer(raw, "<f8")
            if piece != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)
                at, total = piece, part.copy()
            else:
                total += part
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)


def _summed(parts: DataFrame, rows: int, cols: int) -> np.ndarray:
    """The sum over tasks of their (rows x cols) matrices, sent in pieces; it
    has a fixed size, which is all that reaches the driver."""
    done = parts.repartition("piece").sortWithinPartitions("piece", "part").mapInArrow(_add, "piece int, data binary")
    out = np.zeros((rows, cols))
    for r in done.collect():
        piece = np.frombuffer(r["data"], "<f8").reshape(-1, cols)
        start = r["piece"] * min(_PIECE, rows)
        out[start:start + len(piece)] = piece
    return out


_PARTS = "piece int, part int, data binary"


# -- the latent space --------------------------------------------------------


_PASSAGE = 4 * _BLOCK


def _hash_words(keep: list[str]):
    """The rows with the hashes of their text's words in place of the text."""

    def run(batches):
        for b in batches:
            words = [word_ids(text.as_py()).astype("<i4").tobytes() for text in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(words, pa.binary())], [*keep, "words"])

    return run


def hashed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, words) of each row, ``words`` being 32-bit numbers."""
    small_batches(docs.sparkSession)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(_hash_words(keep), ", ".join([*kinds, "words binary"]))


def _unpacked(batch) -> list[np.ndarray]:
    return [np.frombuffer(raw, "<i4") for raw in batch.column("words").to_pylist()]


def _count_terms(bits: int):
    """The task's occurrences of each term; the first counter behind the terms
    counts the passages."""

    def run(batches):
        counts, none = np.zeros((1 << bits) + _PIECE), np.zeros(0, np.int32)
        for b in batches:
            ids = _unpacked(b)
            counts[:1 << bits] += np.bincount(np.concatenate([none, *ids]) & ((1 << bits) - 1), minlength=1 << bits)
            counts[1 << bits] += sum(-(-len(i) // _PASSAGE) for i in ids)
        yield from _pieces_of(counts, TaskContext.get().partitionId())

    return run


def inverse_frequencies(rows: DataFrame, bits: int) -> np.ndarray:
    """ln((passages + 1) / (occurrences + 1)) per hashed term, 0 at least: for
    all but common words, a passage has one occurrence."""
    counts = _summed(rows.select("words").mapInArrow(_count_terms(bits), _PARTS), (1 << bits) + _PIECE, 1)[:, 0]
    return np.maximum(np.log((counts[1 << bits] + 1.0) / (counts[:1 << bits] + 1.0)), 0.0)


#: Passages that are multiplied together.
_CHUNK = 1 << 6


def _gram_product(shared, idf, slots):
    """The task's share of A'A X, A being the weighted and L2-normed TF-IDF rows
    of its passages; ``slots`` numbers the terms kept (0: not kept).  A few
    passages at a time are a dense matrix over the terms they have."""

    def run(batches):
        x, weight, slot = shared.value.astype(np.float32), idf.value, slots.value
        out, place = np.zeros(x.shape), np.zeros(len(x), np.int64)
        for b in batches:
            share, ends, texts, given = np.zeros(x.shape, np.float32), [0], _unpacked(b), []
            for ids, w in zip(texts, b.column("weight").to_pylist(), strict=True):
                at, n = ends[-1], len(ids)
                ends += [*range(at + _PASSAGE, at + n, _PASSAGE), at + n] if n else []
                given += [w] * (len(ends) - 1 - len(given))
            if not given:
                continue
            every, ends, given = np.concatenate(texts), np.array(ends), np.array(given)
            for i in range(0, len(given), _CHUNK):
                part = ends[i:i + _CHUNK + 1]
                terms, lens = every[part[0]:part[-1]] & (len(weight) - 1), np.diff(part)
                rows, w = np.repeat(np.arange(len(lens)), lens), weight[terms]
                norm = np.sqrt(np.maximum(np.bincount(rows, weights=w * w, minlength=len(lens)), 1e-12))
                some = np.flatnonzero(slot[terms])
                rows, cols = rows[some], slot[terms[some]]
                held = np.zeros(len(x), bool)
                held[cols] = True
                found = np.flatnonzero(held)
                place[found] = np.arange(len(found))
                tfidf = np.bincount(rows * len(found) + place[cols], weights=w[some] * (given[i:i + _CHUNK] / norm)[rows], minlength=len(lens) * len(found))
                tfidf = tfidf.astype(np.float32).reshape(len(lens), -1)
                share[found] += tfidf.T @ (tfidf @ x[found])
            out += share
        yield from _pieces_of(out, TaskContext.get().partitionId())

    return run


def latent_basis(rows: DataFrame, own: DataFrame, idf: np.ndarray, slots: np.ndarray, rank: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal right singular vectors (slots x rank; row 0 is 0) and singular
    values of the passages of ``rows`` and of the items' ``own`` (words, weight).

    The items weigh most, so two products over their few passages find the
    subspace; the last product, over all passages, turns it to the whole."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    n = int(slots.max()) + 1
    start = np.random.default_rng(seed).standard_normal((n, min(rank + 8, n)))
    weights, places = sc.broadcast(idf), sc.broadcast(slots)
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def product(part: DataFrame, x: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(np.linalg.qr(x)[0])
        out = _summed(part.mapInArrow(_gram_product(shared, weights, places), _PARTS), *x.shape)
        shared.destroy()
        return out

    x = start
    for _ in range(2):
        x = product(own, x)
        # A little of every direction, as the items may have fewer than the rank.
        x += 1e-3 * max(float(np.abs(x).max()), 1e-12) / len(x) ** 0.5 * start
    x = product(rows.union(own).coalesce(tasks), x)
    weights.destroy()
    places.destroy()
    q, r = np.linalg.qr(x)
    u, s, _ = np.linalg.svd(r)
    basis = (q @ u)[:, :rank]
    basis[0] = 0.0
    return basis, np.sqrt(s[:rank])


# -- items and scoring -------------------------------------------------------


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray
    #: All words and those of the answer, of an item that is sought word for word.
    whole: np.ndarray | None = None
    whole_answer: np.ndarray | None = None
    #: Sought in no other way.
    short: bool = False

    @property
    def misses(self) -> int:
        """Words that may lack of the whole: none of seven, else a sixth, so that
        of misses + 1 equal parts one is there and has four words."""
        return 0 if len(self.whole) < 2 * _RUN else len(self.whole) // 6


def make_item(item_id, text: str | None) -> Item:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if word_ids(s).size]
    return Item(item_id, word_ids(text), word_ids(sentences[-1] if len(sentences) > 1 else ""))


def run_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    out = np.zeros(max(len(ids) - width + 1, 0), np.uint64)
    for i in range(width):
        out = (out ^ ids[i:i + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(m: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, one big-integer step a word."""
    full = (1 << size) - 1
    v = full
    for w in words:
        if (match := m.get(w)) is not None:
            u = v & match
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def unit_starts(size: int) -> list[int]:
    """Where the units of an item of ``size`` content words begin."""
    return [*range(0, size - _UNIT, _BLOCK), max(size - _UNIT, 0)]


class Judge:
    """Finds the items of one block in documents."""

    def __init__(self, items: list[Item], idf: np.ndarray, basis: np.ndarray, slots: np.ndarray, s: Settings) -> None:
        self.s, self.bits, self.slots = s, s.term_bits, slots
        terms = 1 << s.term_bits
        self.kept = idf >= np.log(1.0 / s.common)
        self.items = [self.made(i) for i in items if len(i.words)]
        weight = np.zeros(len(basis))
        weight[slots] = idf
        self.embed = (basis * weight[:, None]).astype(np.float32)
        # The last term stands for padding.
        self.square = np.append(idf ** 2, 0.0).astype(np.float32)
        self.slots = np.append(slots, 0)
        self.units = [(k, at) for k, i in enumerate(self.items) for at in unit_starts(len(i.words))]
        self.unit_of = {k: u for u, (k, _) in enumerate(self.units)}
        q = np.zeros((len(self.units), basis.shape[1]))
        for u, (k, at) in enumerate(self.units):
            ids = self.items[k].words[at:at + _UNIT] & (terms - 1)
            v = self.embed[self.slots[ids]].sum(0, dtype=np.float64)
            own = float(v @ v)
            # cosine(x, unit) / cosine(unit, unit) = x . v * |unit| / (|x| * own)
            q[u] = v * (float(self.square[ids].sum()) ** 0.5 / own) if own > 0 else 0.0
        self.q = q.T.astype(np.float32)
        self.masks = [masks(i.words) for i in self.items]
        self.answers = [masks(i.answer) for i in self.items]
        # Windows are scored against the units of long items; short ones are sought by runs:
        # width -> hash of a run -> (item, place of the run in it).
        self.scored = np.array([u for u, (k, _) in enumerate(self.units) if not self.items[k].short], np.int64)
        self.long_q = np.ascontiguousarray(self.q[:, self.scored])
        self.runs: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, item in enumerate(self.items):
            if item.whole is not None:
                size, parts = len(item.whole), item.misses + 1
                width = min(_RUN, size)
                hashes = run_hashes(item.whole, width)
                for at in sorted({size * p // parts for p in range(parts)}):
                    self.runs.setdefault(width, {}).setdefault(int(hashes[at]), []).append((k, at))
        self.whole = {k: (masks(i.whole), masks(i.whole_answer)) for k, i in enumerate(self.items) if i.whole is not None}
        self.marked = {}
        for width, table in self.runs.items():
            self.marked[width] = np.zeros(1 << 16, bool)
            self.marked[width][np.array(list(table), np.uint64) >> np.uint64(48)] = True

    def made(self, item: Item) -> Item:
        """The item in content words and, where these are few, with all its words."""
        words, answer = self.content(item.words), self.content(item.answer)
        if len(words) < _FEW:
            return Item(item.item_id, item.words, item.answer, item.words, item.answer, short=True)
        if len(words) < _SHORT or 2 * len(words) < len(item.words):
            return Item(item.item_id, words, answer, item.words, item.answer)
        return Item(item.item_id, words, answer)

    def content(self, ids: np.ndarray) -> np.ndarray:
        """The words that are not left out as common."""
        return ids[self.kept[ids & (len(self.kept) - 1)]]

    def find(self, texts: list[np.ndarray]) -> list[dict[int, tuple[float, float, bool, int]]]:
        """Per document, given by its words: item index -> (cosine, coverage,
        answer found, first content word)."""
        out: list[dict] = [{} for _ in texts]
        docs = [self.content(ids) for ids in texts]
        todo: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for i, ids in enumerate(docs):
            for start in range(0, max(len(ids) - 64, 1), _WORDS):
                part = ids[start:start + _WORDS + 64]
                if len(part):
                    todo.append((i, start, part))
                    size += len(part)
                if size >= _WORDS:
                    self._score(todo, docs, out)
                    todo, size = [], 0
        if todo:
            self._score(todo, docs, out)
        for ids, found in zip(texts, out, strict=True):
            for width, table in self.runs.items():
                self._seek(ids, found, width, table)
        return out

    def _seek(self, ids: np.ndarray, found: dict, width: int, table: dict) -> None:
        """Short items where one of their runs of words stands."""
        hashes, tried = run_hashes(ids, width), set()
        for place in np.flatnonzero(self.marked[width][hashes >> np.uint64(48)]).tolist():
            for k, at in table.get(int(hashes[place]), ()):
                item = self.items[k]
                size, misses, start = len(item.whole), item.misses, place - at
                if (k, start) in tried:
                    continue
                tried.add((k, start))
                low = max(0, start - misses)
                words = ids[low:start + size + misses]
                own, said = self.whole[k]
                held = common_subsequence(own, size, words.tolist())
                if size - held > misses or not self._is_near(words, k):
                    continue
                cover, asked = held / size, len(item.whole_answer)
                answer = asked > 0 and common_subsequence(said, asked, words.tolist()) >= self.s.answered * asked
                cosine = self._cosine(words, k)
                if k not in found or (cover, cosine) > found[k][1::-1]:
                    found[k] = (cosine, cover, answer, int(self.kept[ids[:low] & (len(self.kept) - 1)].sum()))

    def _is_near(self, words: np.ndarray, k: int) -> bool:
        """Whether the latent cosine is high enough (an item without weight has none)."""
        return not self.q[:, self.unit_of[k]].any() or self._cosine(words, k) >= self.s.min_cosine

    def _cosine(self, words: np.ndarray, k: int) -> float:
        """The score of a window for a short item, which is one unit."""
        ids = words & (len(self.kept) - 1)
        norm = max(float(self.square[ids].sum()), 1e-9) ** 0.5
        return float(self.embed[self.slots[ids]].sum(0) @ self.q[:, self.unit_of[k]]) / norm

    def _score(self, todo, docs, out) -> None:
        if not len(self.scored):
            return
        pad = 1 << self.bits
        lens = np.array([-(-len(p) // _BLOCK) for *_, p in todo])
        terms = np.full(int(lens.sum()) * _BLOCK, pad, np.int64)
        at = 0
        for (_, _, p), n in zip(todo, lens, strict=True):
            terms[at:at + len(p)] = p & (pad - 1)
            at += int(n) * _BLOCK
        # Only the items' terms have a vector.
        slot = self.slots[terms]
        at = np.flatnonzero(slot)
        blocks = np.zeros((len(terms) // _BLOCK, self.embed.shape[1]), np.float32)
        if len(at):
            held, first = np.unique(at // _BLOCK, return_index=True)
            blocks[held] = np.add.reduceat(self.embed[slot[at]], first, axis=0)
        squares = self.square[terms].reshape(-1, _BLOCK).sum(1)
        owner = np.repeat(np.arange(len(todo)), lens)
        local = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
        known: dict[int, dict] = {}
        for width, step in ((2, 1), (4, 2)):
            sums, norms = blocks.copy(), squares.copy()
            for j in range(1, width):
                same = owner[j:] == owner[:-j]
                sums[:-j] += blocks[j:] * same[:, None]
                norms[:-j] += squares[j:] * same
            pick = np.flatnonzero(local % step == 0) if step > 1 else slice(None)
            picked, norms = sums[pick], np.sqrt(np.maximum(norms[pick], 1e-9))[:, None]
            rows = np.arange(len(owner))[pick]
            for left in range(0, len(self.scored), _UNITS):
                score = (picked @ self.long_q[:, left:left + _UNITS]) / norms
                for a, u in zip(*np.nonzero(score >= self.s.min_cosine), strict=True):
                    o = int(owner[rows[a]])
                    doc, start, _ = todo[o]
                    first = start + int(local[rows[a]]) * _BLOCK
                    k, at = self.units[self.scored[left + int(u)]]
                    # Where the whole item would lie.
                    size = len(self.items[k].words)
                    margin = max(_MARGIN, size // 4)
                    last = first + width * _BLOCK + max(size - at - _UNIT, 0) + margin
                    self._check(docs[doc], out[doc], k, max(0, first - at - margin), last, float(score[a, u]), known.setdefault(doc, {}))

    def _check(self, ids, found, k: int, low: int, last: int, cosine: float, known: dict) -> None:
        if (k, low, last) not in known:
            known[k, low, last] = self._align(ids[low:last].tolist(), k)
        cover, answer = known[k, low, last]
        if cover < self.s.reworded:
            return
        if (cover >= self.s.copied or answer) and (k not in found or (cover, cosine) > found[k][1::-1]):
            found[k] = (cosine, cover, answer, low)

    def _align(self, words: list[int], k: int) -> tuple[float, bool]:
        """What ``words`` cover of the item, and whether they hold its answer."""
        item = self.items[k]
        cover = common_subsequence(self.masks[k], len(item.words), words) / len(item.words)
        if cover < self.s.reworded or not len(item.answer):
            return cover, False
        return cover, common_subsequence(self.answers[k], len(item.answer), words) >= self.s.answered * len(item.answer)


@dataclass
class Corpus:
    """Term weights over all documents, all of them as hashed words, and the
    weight of each in the latent space."""

    idf: np.ndarray
    rows: DataFrame
    weight: float


def read_corpus(docs: DataFrame, s: Settings, keep: list[str] | None = None) -> Corpus:
    rows = written(hashed(docs, keep or []), "words")
    return Corpus(inverse_frequencies(rows, s.term_bits), rows, min(1.0, s.corpus_weight / max(rows.count(), 1)) ** 0.5)


def make_judge(corpus: Corpus, block: list, s: Settings) -> Judge:
    """The latent space of a block of (item_id, text), ready to score."""
    items = [make_item(i, t) for i, t in block]
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *[i.words & ((1 << s.term_bits) - 1) for i in items]]))
    slots = np.zeros(1 << s.term_bits, np.int32)
    slots[used] = np.arange(1, len(used) + 1)
    texts = corpus.rows.sparkSession.createDataFrame([(t,) for _, t in block], "text string").coalesce(1)
    own, rows = (r.select("words", F.lit(w).alias("weight")) for r, w in ((hashed(texts, []), s.item_weight), (corpus.rows, corpus.weight)))
    basis, _ = latent_basis(rows, own, corpus.idf, slots, s.rank)
    return Judge(items, corpus.idf, basis, slots, s)


def item_blocks(benchmark: DataFrame, s: Settings):
    """Lists of (item_id, text), each of about ``items_per_block`` items; a long
    item counts once for each of its units."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    words = F.size(F.split("text", r"[^0-9A-Za-z\u0080-\uffff]+"))
    units = F.ceil((F.greatest(words, F.lit(_UNIT)) - _UNIT) / _BLOCK) + 1
    n = -(-(items.agg(F.sum(units).alias("n")).first()["n"] or 0) // s.items_per_block)
    for i in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()]


def _judged(docs: DataFrame, keep: list[str], judge: Judge, whole_rows: bool) -> DataFrame:
    """Matches of a block of items in hashed documents (keep, item_id, cosine,
    coverage, answer_found, first_word), or with ``whole_rows`` the rows of
    ``docs``, which have their text, without a match."""
    spark = docs.sparkSession
    small_batches(spark)
    judge = spark.sparkContext.broadcast(judge)
    ids = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, ids, strict=True)],
                       F.col("text").cast("string").alias("_text") if whole_rows else F.col("words"))

    def run(batches):
        j = judge.value
        for b in batches:
            found = j.find([word_ids(t.as_py()) for t in b.column("_text")] if whole_rows else [w.astype(np.int64) for w in _unpacked(b)])
            if whole_rows:
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ids], ids).filter(pa.array([not f for f in found], pa.bool_()))
                continue
            at = [i for i, f in enumerate(found) for _ in f]
            hits = [(j.items[k].item_id, *v) for f in found for k, v in sorted(f.items())]
            cols = list(zip(*hits, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(pa.array(at, pa.int64())) for c in ids], *[pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]],
                [*ids, "item_id", "cosine", "coverage", "answer_found", "first_word"])

    names = [f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    if whole_rows:
        return rows.mapInArrow(run, ", ".join(names)).toDF(*keep)
    out = rows.mapInArrow(run, ", ".join([*names, "item_id bigint, cosine double, coverage double, answer_found boolean, first_word bigint"]))
    return out.toDF(*keep, "item_id", "cosine", "coverage", "answer_found", "first_word")


def find_contamination(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, item_id, cosine, coverage, answer_found, first_word: the best
    window of every document and benchmark item that match."""
    s = s or Settings()
    corpus = read_corpus(docs, s, ["doc_id"])
    out = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id bigint, cosine double, "
                                            "coverage double, answer_found boolean, first_word bigint")
    for block in item_blocks(benchmark, s):
        out = out.union(_judged(corpus.rows, ["doc_id"], make_judge(corpus, block, s), whole_rows=False))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that match no item."""
    s = s or Settings()
    corpus = read_corpus(docs, s)
    for block in item_blocks(benchmark, s):
        docs = _judged(docs, docs.columns, make_judge(corpus, block, s), whole_rows=True)
    return docs
