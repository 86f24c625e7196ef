"""Language identification by prediction by partial matching.

Every language has a context tree over bytes.  The deepest context that the
tree holds predicts the next byte; a byte never seen there escapes to the next
shorter context (with the bytes already offered excluded), down to a uniform
choice.  A context with n occurrences of q different bytes gives a byte seen c
times c / (n + q) and the escape q / (n + q).  A text's code length in a
language is the sum over its bytes; the language with the shortest code wins.

The statistics are frozen after the fit, so the code length of a byte depends
only on (context, byte) and is tabulated once for all languages.  The tree is
of variable order: the contexts of up to ``order`` bytes seen most often are
nodes, as many as fit in ``max_cells`` table cells, and other contexts use
their longest suffix that is a node.  That bounds the broadcast table.

The fit takes about ``per_language`` labelled documents of each language (a
bounded sample, drawn by a hash of the id); every whole text is scored.

Results: a null text and one without a letter is ``und`` with score 0, and so
is every text when nothing was learned; ties go to the smaller name; repeated
rows are scored alike; no documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import sampled, small_batches

UNDETERMINED = "und"
_PAD = b" "
_CHUNK = 1 << 20


@dataclass
class ContextTrees:
    """Frozen code lengths of all languages.

    ``symbols`` maps a byte to its symbol (the last one stands for bytes never
    seen), ``node_of`` maps the last ``order`` symbols to the deepest node, and
    ``cost[node * n_symbols + symbol]`` has the bits in every language.
    """

    languages: list[str]
    order: int
    symbols: np.ndarray
    node_of: np.ndarray
    cost: np.ndarray

    @property
    def n_symbols(self) -> int:
        return int(self.symbols.max()) + 1

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; long texts go in pieces."""
        k, pad = self.order, _PAD * self.order
        out = np.zeros((len(texts), len(self.languages)))
        pieces: list[bytes] = []
        owners: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            t = pad + t
            for start in range(0, len(t) - k, _CHUNK):
                piece = t[start:start + _CHUNK + k]
                pieces.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= _CHUNK:
                    self._add(pieces, owners, out)
                    pieces, owners, size = [], [], 0
        if pieces:
            self._add(pieces, owners, out)
        return out

    def _add(self, pieces: list[bytes], owners: list[int], out: np.ndarray) -> None:
        k, a = self.order, self.n_symbols
        s = self.symbols[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(s) - k
        context = s[:n].astype(np.int64)
        for j in range(1, k):
            context = context * a + s[j:j + n]
        cost = self.cost[self.node_of[context].astype(np.int64) * a + s[k:]]
        lens = np.array([len(p) for p in pieces])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        # Positions that would predict the next piece's own context cost nothing.
        bounds = np.empty(2 * len(lens), np.int64)
        bounds[0::2], bounds[1::2] = starts, starts + lens - k
        if bounds[-1] >= n:
            bounds = bounds[:-1]
        sums = np.add.reduceat(cost, bounds, axis=0, dtype=np.float64)[0::2]
        np.add.at(out, np.array(owners), sums)


def _count_grams(order: int):
    """(lang, gram, n): counts of packed (context, byte) strings, summed over
    pieces of about a megabyte of one language."""

    def count(lang: str, grams: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(grams), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
                lang = lang.as_py()
                whole = _PAD * order + text.as_py().encode("utf-8", "surrogatepass")
                for start in range(0, len(whole) - order, _CHUNK):
                    raw = np.frombuffer(whole[start:start + _CHUNK + order], np.uint8).astype(np.int64)
                    n = len(raw) - order
                    gram = np.zeros(n, np.int64)
                    for j in range(order + 1):
                        gram = (gram << 8) | raw[j:j + n]
                    held.setdefault(lang, []).append(gram)
                    size[lang] = size.get(lang, 0) + n
                    if size[lang] >= _CHUNK:
                        yield count(lang, held.pop(lang))
                        size[lang] = 0
        for lang, grams in held.items():
            yield count(lang, grams)

    return run


def _costs(counts: list[np.ndarray]) -> np.ndarray:
    """Bits of each symbol given the counts of the longest context first.

    ``counts[j]``: one row per node; the last column stands for every byte
    never seen.
    """
    rows, a = counts[0].shape
    p = np.zeros((rows, a))
    escape = np.ones(rows)
    offered = np.zeros((rows, a), bool)
    for c in counts:
        left = np.where(offered, 0.0, c)
        n, q = left.sum(1), (left > 0).sum(1)
        some = n > 0
        total = np.where(some, n + q, 1.0)
        p += np.where(left > 0, left, 0.0) * (escape / total)[:, None] * some[:, None]
        escape = np.where(some, escape * np.where(some, q, 0) / total, escape)
        offered |= c > 0
    rest = np.maximum(256 - offered.sum(1), 1)
    p = np.where(offered, p, (escape / rest)[:, None])
    return -np.log2(np.maximum(p, 1e-300))


def build_trees(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, max_cells: int) -> ContextTrees:
    """Trees from counts of (context, byte) strings packed in integers."""
    used = np.unique(np.concatenate([(gram >> (8 * j)) & 255 for j in range(order + 1)]))
    symbols = np.full(256, len(used), np.int16)
    symbols[used] = np.arange(len(used))
    a = len(used) + 1
    digits = np.stack([symbols[(gram >> (8 * (order - j))) & 255].astype(np.int64) for j in range(order + 1)])
    codes = np.zeros(len(gram), np.int64)
    for j in range(order):
        codes = codes * a + digits[j]
    # Suffix contexts of each length, the most frequent first within the bound.
    room = max(1, max_cells // (a * len(languages)))
    node_of = np.zeros(a ** order, np.int32)
    root = np.zeros(len(n), np.int64)
    blocks = [np.stack([_costs([_table(lang, digits[-1], n, a, li, root, 1)]) for li in range(len(languages))], axis=-1)]
    nodes = 1
    for length in range(1, order + 1):
        suffix = codes % a ** length
        found, inverse = np.unique(suffix, return_inverse=True)
        weight = np.bincount(inverse, weights=n)
        keep = np.argsort(-weight, kind="stable")[:max(0, room - nodes)]
        keep.sort()
        if not len(keep):
            break
        place = np.full(len(found), -1, np.int64)
        place[keep] = np.arange(len(keep))
        row = place[inverse]
        layers = []
        for li in range(len(languages)):
            tables = [_table(lang, digits[-1], n, a, li, row, len(keep))]
            for shorter in range(length - 1, -1, -1):
                short_codes, short_row = np.unique(codes % a ** shorter, return_inverse=True)
                whole = _table(lang, digits[-1], n, a, li, short_row, len(short_codes))
                tables.append(whole[np.searchsorted(short_codes, found[keep] % a ** shorter)])
            layers.append(_costs(tables))
        blocks.append(np.stack(layers, axis=-1))
        # All full contexts that end in a kept suffix now use its node.
        full = node_of.reshape(-1, a ** length)
        full[:, found[keep]] = np.arange(nodes, nodes + len(keep), dtype=np.int32)[None, :]
        nodes += len(keep)
    table = np.concatenate(blocks).reshape(nodes * a, len(languages)).astype(np.float32)
    return ContextTrees(languages, order, symbols, node_of, table)


def _table(lang, symbol, n, a, li, row, rows) -> np.ndarray:
    mine = (lang == li) & (row >= 0)
    flat = np.bincount(row[mine] * a + symbol[mine], weights=n[mine], minlength=rows * a)
    return flat.reshape(rows, a)


def learn(labelled: DataFrame, per_language: int = 1000, order: int = 3, max_cells: int = 1 << 23) -> ContextTrees | None:
    """Fit on a sample of (doc_id, text, lang) rows; None without any."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND text <> '' AND lang IS NOT NULL")
    sample = sampled(rows, "lang", "doc_id", per_language).select("lang", "text")
    grams = sample.mapInArrow(_count_grams(order), "lang string, gram bigint, n bigint")
    found = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    languages = sorted(found["lang"].unique())
    lang = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    return build_trees(languages, lang, found["gram"].to_numpy(), found["n"].to_numpy().astype(float), order, max_cells)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(trees: ContextTrees | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and the share of its probability under equal priors."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    asked = [i for i, t in enumerate(texts) if has_letter(t)] if trees else []
    if asked:
        bits = trees.lengths([texts[i].encode("utf-8", "surrogatepass") for i in asked])
        best = bits.argmin(1)
        share = 1.0 / np.exp2(np.minimum(0.0, bits.min(1)[:, None] - bits)).sum(1)
        for i, b, s in zip(asked, best, share, strict=True):
            names[i], scores[i] = trees.languages[b], float(s)
    return names, scores


def identify(docs: DataFrame, trees: ContextTrees | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trees)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def run(batches):
        trees = model.value
        for b in batches:
            names, scores = predict(trees, b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    schema = rows.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4 (a null id does not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
