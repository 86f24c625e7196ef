"""Prefix trie of rebuilt conversations in balanced parentheses.

A node is a distinct sequence of first d turns (role, text); conversations that
start with it are its members.  Members of a node and of its only child may be
the same; such nodes form a chain, and the trie proper is the one of chains
(named by their smallest member and their number of members).

1. Turns are ranged over partitions by (conversation, turn), so a conversation
   of any length is spread; positions, keys and text lengths along it are sums
   of whole partitions plus a window inside one.  A node's key is a sum of
   hashes of (position, role, text), so no task walks a conversation.
2. Nodes, their members, children and parents are aggregates and joins; a node
   or parent with more than a thousandth of all rows is joined by broadcast
   (there are fewer than a thousand).
3. The paths of chains from the root to every childless node are ranged over
   shards in lexicographic order.  Of N turns, a path has at most sqrt(2 N)
   chains, as each was left by another conversation.  A shard writes its
   part of the trie as balanced parentheses: "(" opens a chain, ")" closes it.
   With the least excess of every block and of every pair, quadruple, ... of
   blocks, findclose skips to where a subtree ends; the childless chains below
   are the pairs "()" counted up to there, the savings a difference of
   cumulative sums.
4. Chains on the spine shared by neighbouring shards are opened in each of
   them, and their savings counted where they are opened first (a shard is told
   the last path of the shard before).  So the parts of a chain add up, and
   grouping by chain merges the shared spines.

Results: null role or text is empty; turns are ordered by turn (null first),
then role and text, repeated rows stay; rows of a null conversation id belong to
no conversation and are left out; a conversation rebuilt to nothing is a member
of the root only; no conversations give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vouch.llm.common import by_class, small_batches, written

#: Parentheses in one block of the excess index.
BLOCK = 256
_LANE = (1 << 31) - 1
_LANES = [f"l{i}" for i in range(4)]
_KEY = ["depth", "k1", "k2"]
#: Bytes of decimal ids that are passed on as one row.
_PIECE = 1 << 16
SCHEMA = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")


# ----------------------------------------------------------------------
# balanced parentheses
# ----------------------------------------------------------------------
class Parentheses:
    """A sequence of parentheses (True opens) with a range min-max index.

    ``excess`` up to a position is the number of pairs open after it.  The
    index holds the least excess of each block and, level by level, of twice as
    many blocks.
    """

    def __init__(self, opens: np.ndarray) -> None:
        self.opens = opens
        n = len(opens)
        blocks = max(1, -(-n // BLOCK))
        step = np.zeros(blocks * BLOCK, np.int64)
        step[:n] = np.where(opens, 1, -1)
        inside = np.cumsum(step.reshape(blocks, BLOCK), axis=1)
        total = inside[:, -1]
        self._before = np.concatenate([[0], np.cumsum(total)[:-1]])
        leaves = 1 << (blocks - 1).bit_length()
        tree = np.full(2 * leaves, np.iinfo(np.int64).max)
        tree[leaves:leaves + blocks] = inside.min(axis=1) + self._before
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        self._tree, self._leaves, self._step = tree, leaves, step.reshape(blocks, BLOCK)
        self._pairs = np.concatenate([[0], np.cumsum(opens[:-1] & ~opens[1:])]) if n else np.zeros(1, np.int64)

    def _first(self, block: int, at: int, most: int) -> int | None:
        """The first place from ``at`` on in the block where the excess is at most ``most``."""
        run = self._before[block] + np.cumsum(self._step[block])
        hits = np.flatnonzero(run[at:] <= most)
        return block * BLOCK + at + int(hits[0]) if len(hits) else None

    def findclose(self, i: int) -> int:
        """The place of the parenthesis that closes the one opened at ``i``."""
        block, at = divmod(i, BLOCK)
        most = int(self._before[block] + self._step[block][:at].sum())  # the excess before i
        got = self._first(block, at + 1, most) if at + 1 < BLOCK else None
        if got is not None:
            return got
        node = self._leaves + block
        while True:  # up to the next subtree on the right that goes low enough
            while node & 1:
                node >>= 1
            node += 1
            if self._tree[node] <= most:
                break
        while node < self._leaves:
            node = 2 * node if self._tree[2 * node] <= most else 2 * node + 1
        return self._first(node - self._leaves, 0, most)

    def pairs(self, i: int, j: int) -> int:
        """The "()" that lie within places i to j."""
        return int(self._pairs[j] - self._pairs[i])


def _shards(batches):
    """Paths sorted by (shard, path), the last path of the shard before first, to
    (conv, members, leaves, saved) of every chain of each shard."""
    shard, trie = None, None
    for b in batches:
        flat = b.column("path").flatten()
        convs, members, saved = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("c", "m", "s"))
        ends = np.concatenate([[0], np.cumsum(b.column("path").value_lengths().to_numpy(zero_copy_only=False))])
        for i, (s, own) in enumerate(zip(b.column("shard").to_pylist(), b.column("own").to_pylist(), strict=True)):
            if s != shard:
                if trie is not None:
                    yield trie.rows()
                shard, trie = s, _Shard()
            at = slice(ends[i], ends[i + 1])
            trie.add(list(zip(convs[at].tolist(), members[at].tolist(), strict=True)), saved[at].tolist(), own)
    if trie is not None:
        yield trie.rows()


class _Shard:
    """The part of the trie that a shard's paths make, in balanced parentheses."""

    def __init__(self) -> None:
        self.bits: list[bool] = []
        self.chains: list[tuple[int, int]] = []
        self.saved: list[int] = []
        self._open: list[tuple[int, int]] = []
        self._before: list[tuple[int, int]] = []

    def add(self, path: list[tuple[int, int]], saved: list[int], own: bool) -> None:
        if not own:
            self._before = path
            return
        same = _shared(self._open, path)
        counted = _shared(self._before, path)  # opened by an earlier shard
        self.bits += [False] * (len(self._open) - same) + [True] * (len(path) - same)
        for d in range(same, len(path)):
            self.chains.append(path[d])
            self.saved.append(0 if d < counted else saved[d])
        self._open = path

    def rows(self):
        bits = np.array(self.bits + [False] * len(self._open), bool)
        tree, opened = Parentheses(bits), np.flatnonzero(bits)
        closes = [tree.findclose(int(i)) for i in opened]
        leaves = [tree.pairs(int(i), j) for i, j in zip(opened, closes, strict=True)]
        sums, rank = np.concatenate([[0], np.cumsum(np.array(self.saved, np.int64))]), np.concatenate([[0], np.cumsum(bits)])
        below = sums[rank[np.array(closes, np.int64) + 1]] - sums[rank[opened]] if len(opened) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _m in self.chains], pa.int64()), pa.array([m for _c, m in self.chains], pa.int64()), pa.array(leaves, pa.int64()), pa.array(below, pa.int64())],
            ["chain", "members", "leaves", "below"])


def _shared(x: list, y: list) -> int:
    n = 0
    for a, b in zip(x, y):
        if a != b:
            break
        n += 1
    return n


# ----------------------------------------------------------------------
# turns and nodes
# ----------------------------------------------------------------------
def heads_of(conv: Column) -> Column:
    """How many turns a conversation takes from the one it is rebuilt on."""
    return (F.crc32(conv.cast("string")) % 6).cast("bigint")


def base_of(conv: Column) -> Column:
    return conv - conv % 100


def _before_parts(df: DataFrame, names: list[str]) -> DataFrame:
    """(conv, part) with the sums of ``names`` over the parts of the conversation
    before; a window holds as many rows as the conversation has partitions."""
    w = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("conv", "part").agg(*[F.sum(n).alias(n) for n in names])
    return sums.select("conv", "part", *[F.coalesce(F.sum(n).over(w), F.lit(0).cast("bigint")).alias(f"b_{n}") for n in names])


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, n) of every conversation as rebuilt, and its turns: conv, part,
    depth, chars and the lanes of the turn's hash."""
    t = turns.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn"),
                     F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.filter("conv IS NOT NULL").withColumn("_salt", F.monotonically_increasing_id())  # equal rows are split too
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_salt")]
    ranged = t.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)
    hashes = [F.xxhash64(F.lit(i), "role", "text") for i in (1, 2)]
    ranged = ranged.select("conv", *[h.alias(f"h{i}") for i, h in enumerate(hashes)], F.char_length("text").cast("bigint").alias("chars"),
                           F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    own = written(ranged, "trie-turns")

    parts = _before_parts(own.withColumn("one", F.lit(1).cast("bigint")), ["one"])
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy("row"))
    counts = own.groupBy("conv").agg(F.count(F.lit(1)).alias("own_n"))
    first = own.join(parts, ["conv", "part"]).filter("b_one < 5").withColumn("pos", F.col("b_one") + inside).filter("pos <= 5")
    base = first.filter(F.col("conv") == base_of(F.col("conv"))).select(F.col("conv").alias("base"), "pos", "h0", "h1", "chars")
    base = written(base, "trie-bases")
    convs = counts.select("conv", "own_n", base_of(F.col("conv")).alias("base"), heads_of(F.col("conv")).alias("h"))
    # A base has at most 199 conversations, those from base - 99 to base + 99.
    size = base.groupBy("base").agg(F.count(F.lit(1)).alias("_b"))
    convs = convs.join(size, "base", "left").select("conv", "own_n", "base", "h", F.least("h", F.coalesce("_b", F.lit(0))).alias("taken"))
    convs = written(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))), "trie-convs")

    head = convs.join(base, "base").filter("pos <= taken").select("conv", F.lit(-1).alias("part"), F.col("pos").alias("depth"), "h0", "h1", "chars")
    shift = parts.join(convs.select("conv", "h", "taken"), "conv")  # one row for each conversation and partition
    tail = own.join(shift, ["conv", "part"]).withColumn("pos", F.col("b_one") + inside).filter("pos > h")
    tail = tail.select("conv", "part", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "h0", "h1", "chars")
    rows = head.union(tail)
    lanes = []
    for i in (0, 1):
        mixed = F.xxhash64(F.lit(i), "depth", f"h{i}")
        lanes += [mixed.bitwiseAND(F.lit(_LANE)), F.shiftrightunsigned(mixed, 32).bitwiseAND(F.lit(_LANE))]
    return convs.select("conv", "n"), written(rows.select("conv", "part", "depth", "chars", *[x.alias(n) for x, n in zip(lanes, _LANES)]), "trie-rebuilt")


def _keyed(rows: DataFrame) -> DataFrame:
    """conv, depth, k1, k2 of each turn's node, p1, p2 of its parent, chars of the
    turn and path_chars up to it."""
    sums = [*_LANES, "chars"]
    inner = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.join(_before_parts(rows, sums), ["conv", "part"])
    r = r.select("conv", "depth", "chars", *_LANES, *[(F.col(f"b_{n}") + F.sum(n).over(inner)).alias(f"t_{n}") for n in sums])
    key = [F.xxhash64(F.lit(i), "depth", *[f"t_{n}" for n in _LANES]) for i in (1, 2)]
    parent = [F.xxhash64(F.lit(i), F.col("depth") - 1, *[F.col(f"t_{n}") - F.col(n) for n in _LANES]) for i in (1, 2)]
    return r.select("conv", "depth", key[0].alias("k1"), key[1].alias("k2"), parent[0].alias("p1"), parent[1].alias("p2"), "chars", F.col("t_chars").alias("path_chars"))


def _nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each node but the root: members, ends, children, parent and chain."""
    ends = convs.select("conv", F.col("n").alias("depth"), F.lit(True).alias("_end"))
    # The last turn of a conversation carries its id as an end.
    marked = rows.join(ends, ["conv", "depth"], "left")
    end = F.when(F.col("_end"), F.col("conv"))
    n = marked.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("members"), F.min("conv").alias("conv"), F.count(end).alias("n_ends"), F.min(end).alias("first_end"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"), F.min("path_chars").alias("path_chars"))
    return written(n, "trie-nodes")


def _id(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names]).alias("_id")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves (childless nodes in its subtree), saved_tokens
    (over its subtree, (members - 1) x code points of the last text), ends_sha256
    (of the ids of the conversations that end there)."""
    spark = turns.sparkSession
    small_batches(spark)
    convs, rebuilt = rebuilt_turns(turns)
    rows = written(_keyed(rebuilt), "trie-keys")
    nodes = _nodes(convs, rows)
    root = convs.agg(F.count(F.lit(1)).alias("members"), F.min("conv").alias("conv"), F.count_if(F.col("n") == 0).alias("n_ends"),
                     F.min(F.when(F.col("n") == 0, F.col("conv"))).alias("first_end")).first()  # one row
    if not root["members"]:
        return spark.createDataFrame([], SCHEMA)

    # Parents: children are counted by parent, and each child gets its parent's members.
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).alias("_id")
    children = nodes.filter("depth > 1").groupBy(up).agg(F.count(F.lit(1)).alias("n_children")).select("_id.*", "n_children")
    nodes = written(nodes.join(children, _KEY, "left").fillna(0, ["n_children"]), "trie-family")
    parents = nodes.filter("n_children > 0").select(_id(*_KEY), F.col("members").alias("p_members"), F.col("conv").alias("p_conv"), F.col("n_children").alias("_count"))
    below = by_class(nodes.filter("depth > 1").select("*", up), written(parents, "trie-parents"), "_id", "_count").drop("_id")
    top = nodes.filter("depth = 1").select("*", F.lit(root["members"]).alias("p_members"), F.lit(root["conv"]).alias("p_conv"))
    nodes = written(below.unionByName(top).withColumn("is_head", (F.col("members") < F.col("p_members")) | (F.col("depth") == 1)), "trie-linked")

    # Chains: members and smallest member are the same from head to bottom.
    start = F.col("path_chars") - F.col("chars")
    chains = nodes.groupBy("conv", "members").agg(F.max("path_chars").alias("end_chars"), F.min(start).alias("start_chars"), F.min("depth").alias("head_depth"),
                                                  F.count(F.lit(1)).alias("_count"), F.min("n_children").alias("_least"))
    chains = chains.withColumn("saved", (F.col("members") - 1) * (F.col("end_chars") - F.col("start_chars")))
    chains = written(chains, "trie-chains")

    # Paths: the chains that the smallest member of each childless chain passes.  A chain under the root may
    # hold all conversations and is a head all the same.
    leaves = chains.filter("_least = 0").select("conv")
    heads = nodes.filter("is_head").select(_id(*_KEY), F.col("conv").alias("c"), F.col("members").alias("m"), F.col("members").alias("_count"))
    passed = by_class(rows.select("conv", _id(*_KEY)), written(heads, "trie-heads"), "_id", "_count")
    passed = passed.join(leaves.distinct(), "conv", "left_semi").select("conv", F.col("_id.depth").alias("d"), "c", "m")
    passed = passed.select("conv", "d", "m", _id("c", "m"))
    costs = written(chains.select(F.struct(F.col("conv").alias("c"), F.col("members").alias("m")).alias("_id"), "saved", "members"), "trie-costs")
    passed = by_class(passed, costs.withColumnRenamed("members", "_count"), "_id", "_count")
    paths = passed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("d", "_id.c", "_id.m", F.col("saved").alias("s")))).alias("p"))
    paths = paths.select(F.transform("p", lambda x: F.struct(x["c"].alias("c"), x["m"].alias("m"), x["s"].alias("s"))).alias("path"))
    counted = _subtrees(paths)

    # Nodes of a chain: what lies below its bottom, plus the chain from the node on.
    facts = chains.select(_id("conv", "members"), "end_chars", "start_chars", "_count").join(
        counted.select(F.struct(F.col("chain").alias("conv"), F.col("members")).alias("_id"), "leaves", "below"), "_id")
    full = by_class(nodes.select("*", _id("conv", "members")), written(facts, "trie-facts"), "_id", "_count")
    saved = F.col("below") - (F.col("members") - 1) * (F.col("path_chars") - F.col("chars") - F.col("start_chars"))
    inner = full.select(*_KEY, F.col("conv").alias("conv_id"), F.col("p_conv").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children",
                        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), "n_ends", "first_end")
    total = written(inner, "trie-rows")
    sums = total.filter("depth = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()  # one row
    at_root = spark.createDataFrame([(0, 0, 0, root["conv"], None, root["members"], sums["n"], sums["leaves"] or 1, sums["saved"] or 0, root["n_ends"], root["first_end"])], total.schema)
    out = total.unionByName(at_root)

    ending = rows.join(convs.select("conv", F.col("n").alias("depth")), ["conv", "depth"], "left_semi").select(*_KEY, "conv")
    zero = F.lit(0).cast("bigint")
    ending = ending.union(convs.filter("n = 0").select(zero, zero, zero, "conv"))
    several = out.filter("n_ends > 1").select(_id(*_KEY), F.col("n_ends").alias("_count"))
    ending = by_class(ending.select(_id(*_KEY), "conv"), written(several, "trie-ends"), "_id", "_count").select("_id.*", "conv")
    out = out.join(_digests(ending), _KEY, "left")
    text = F.when(F.col("n_ends") == 0, F.lit("")).otherwise(F.col("first_end").cast("string"))
    sha = F.when(F.col("n_ends") > 1, F.col("digest")).otherwise(F.sha2(text, 256))
    return out.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      F.col("saved_tokens").cast("bigint").alias("saved_tokens"), sha.alias("ends_sha256"))


def _subtrees(paths: DataFrame) -> DataFrame:
    """chain, members, leaves, below: childless chains and savings in each chain's subtree."""
    schema = "chain bigint, members bigint, leaves bigint, below bigint"
    ranged = paths.repartitionByRange("path").sortWithinPartitions("path")
    ranged = written(ranged.select(F.spark_partition_id().alias("shard"), "path"), "trie-paths")
    # One path for each shard: the last of the shard before.
    last = ranged.groupBy("shard").agg(F.max("path").alias("path"))
    before = last.select("shard", F.lag("path").over(Window.orderBy("shard")).alias("path")).filter("path IS NOT NULL")
    both = ranged.withColumn("own", F.lit(True)).unionByName(before.withColumn("own", F.lit(False)))
    ordered = both.repartition("shard").sortWithinPartitions("shard", "own", "path")
    parts = ordered.mapInArrow(_shards, schema)
    return parts.groupBy("chain", "members").agg(F.sum("leaves").alias("leaves"), F.sum("below").alias("below"))


# ----------------------------------------------------------------------
# digests of many ids
# ----------------------------------------------------------------------
def _digests(ending: DataFrame) -> DataFrame:
    """depth, k1, k2, digest: SHA-256 of the decimal ids, ascending, joined by commas.

    Ids are sorted by range, so a node with very many is spread; each task
    passes pieces of ready text on, and only these run through the digest, in
    order and without being held."""
    key = "depth bigint, k1 bigint, k2 bigint"
    ranged = ending.select(F.col("depth").cast("bigint").alias("depth"), "k1", "k2", "conv").repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    pieces = ranged.mapInArrow(_joined, f"{key}, first bigint, ids string")
    ordered = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return ordered.mapInArrow(_hashed, f"{key}, digest string")


def _joined(batches):
    at, first, ids, size = None, None, [], 0

    def piece():
        return pa.RecordBatch.from_pylist([{"depth": at[0], "k1": at[1], "k2": at[2], "first": first, "ids": ",".join(ids)}], _PIECES)

    for b in batches:
        for *key, conv in zip(*[b.column(c).to_pylist() for c in (*_KEY, "conv")], strict=True):
            if key != at or size > _PIECE:
                if ids:
                    yield piece()
                at, first, ids, size = key, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield piece()


_PIECES = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def _hashed(batches):
    at, digest, done = None, None, []

    def flush():
        return pa.RecordBatch.from_pylist(done, pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.string())]))

    def row():
        return {"depth": at[0], "k1": at[1], "k2": at[2], "digest": digest.hexdigest()}

    for b in batches:
        for *key, ids in zip(*[b.column(c).to_pylist() for c in (*_KEY, "ids")], strict=True):
            if key != at:
                if at is not None:
                    done.append(row())
                at, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if len(done) > 1000:
            yield flush()
            done = []
    if at is not None:
        done.append(row())
        yield flush()
