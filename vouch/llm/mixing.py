"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets: sources in code-point order (null last) weigh by a repeating
   pattern and share ``share`` times all words; no target passes
   ``max_epochs`` times its source, and what is cut off goes to the others by
   weight.
2. Blocks: a source's documents are put in a hashed order and cut in blocks of
   ``block_words`` words (the last block of a source may be shorter).
3. Schedule: slot k has the golden-ratio point frac((k + 1/2) * phi), made in
   whole numbers of 53 bits, so it is as exact for the last slot as for the
   first.  The point falls in one source's stretch of the cumulative weights;
   the slot's rank among the slots of that source says which block it takes,
   round after round.  A source's last slot is cut so that it ends at the
   target.  After any number n of slots, a source has had its share of them but
   for at most 3 + 3 log2(n) (tested; the points' discrepancy grows so).
4. A document takes the words that its stretch of the blocks shares with the
   slots.

Built-in functions only.  Ranks and running sums are made over bounded chunks,
so no task sees a whole source.  The table of sources (one row each) is the
only thing that one task orders; it is never collected.

Defined results: a null text has no words and takes none; a null source is a
source of its own; equal rows share their stretch in any order; no documents
give no rows; with no word at all every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vouch.llm.common import WORD_PATTERN, join_on, running_total, text_or_empty, written

#: floor(phi * 2^53) for phi = (sqrt(5) - 1) / 2, from whole numbers.
_BITS = 53
GOLDEN = (math.isqrt(5 << 2 * _BITS) - (1 << _BITS)) // 2
WEIGHTS = (3, 1, 2)
#: Cells of the grid that finds the source of a point, and chunks for ranks.
_CELLS = 4096


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("bigint")


def golden_point(position: Column) -> Column:
    """frac((position + 1/2) * phi) as position * GOLDEN + GOLDEN / 2 modulo 2^53.

    GOLDEN is multiplied in pieces of 18 bits, so nothing passes a bigint for
    positions below 2^45."""
    k, total = position.cast("bigint"), F.lit(GOLDEN // 2).cast("bigint")
    for at in range(0, _BITS, 18):
        piece = GOLDEN >> at & (1 << min(18, _BITS - at)) - 1
        total = total + F.shiftleft((k * F.lit(piece)).bitwiseAND(F.lit((1 << (_BITS - at)) - 1)), at)
    return total.bitwiseAND(F.lit((1 << _BITS) - 1)) / F.lit(2.0 ** _BITS)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """source, source_size, weight, target from (source, size) rows.

    With the sources ordered by cap / weight, (rest of the words) / (rest of
    the weights) rises while caps bind and falls after, so its maximum is the
    words per weight of the sources below their caps.
    """
    s = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("_rank", rank - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size").cast("double") * max_epochs)
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything).cast("double") * share
    s = s.withColumn("_level", (total - before) / rest)
    s = s.withColumn("target", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("weight")))
    return s.select("source", "source_size", "weight", "target")


def schedule(plan: DataFrame, block_words: int) -> DataFrame:
    """Slots (position, source, block, epoch, limit) in the order of the mix.

    ``plan`` has source, source_size and target.  ``limit`` is the number of
    words of its block that a slot takes from the block's start.
    """
    spark = plan.sparkSession
    b = F.lit(block_words).cast("bigint")
    p = plan.filter("source_size > 0").withColumn("_take", F.floor("target").cast("bigint"))
    p = p.withColumn("_full", F.expr("_take div source_size")).withColumn("_rem", F.col("_take") % F.col("source_size"))
    p = p.withColumn("_blocks", F.ceil(F.col("source_size") / b).cast("bigint"))
    p = p.withColumn("_quota", F.col("_full") * F.col("_blocks") + F.ceil(F.col("_rem") / b).cast("bigint"))
    w = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    p = written(p.withColumn("_lo", F.coalesce(F.sum("_quota").over(w), F.lit(0)).cast("bigint")), "mix-plan")
    n = p.agg(F.coalesce(F.sum("_quota"), F.lit(0)).alias("n")).first()["n"]
    own = ["source", "_full", "_rem", "_blocks", "_quota"]
    # The stretches [lo, lo + quota) / n of the sources, cut where they cross a cell of the grid.
    cells = p.filter("_quota > 0").select(
        *own, (F.col("_lo") / F.lit(float(max(n, 1)))).alias("_from"), ((F.col("_lo") + F.col("_quota")) / F.lit(float(max(n, 1)))).alias("_to"))
    cells = cells.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("_from") * _CELLS), F.least(F.floor(F.col("_to") * _CELLS), F.lit(_CELLS - 1).cast("bigint")))))
    slots = spark.range(n).withColumnRenamed("id", "position").withColumn("_x", golden_point(F.col("position")))
    slots = slots.withColumn("_cell", F.floor(F.col("_x") * _CELLS))
    per_chunk = max(256, -(-n // _CELLS))
    slots = slots.join(cells, "_cell").filter("_x >= _from AND _x < _to")
    slots = written(slots.select("position", F.expr(f"position div {per_chunk}").alias("_chunk"), *own), "mix-slots")
    slots = running_total(slots, ["source"], "_chunk", ["position"], F.lit(1).cast("bigint"), "_turn")
    # Points that fall short of a source's quota (a few per source, by the low discrepancy) close the mix.
    got = slots.groupBy("source").agg(F.count(F.lit(1)).alias("_got"))
    q = p.filter("_quota > 0").select(*own)
    short = join_on(q, got, ["source"], "left").select(*own, F.coalesce("_got", F.lit(0)).cast("bigint").alias("_got"))
    short = short.filter("_got < _quota").select(*own, F.explode(F.sequence("_got", F.col("_quota") - 1)).alias("_turn"))
    short = short.select((F.lit(n) + F.col("_turn")).alias("position"), *own, "_turn")
    slots = slots.filter("_turn < _quota").select("position", *own, "_turn").union(short)
    slots = slots.withColumn("epoch", F.expr("_turn div _blocks")).withColumn("block", F.col("_turn") % F.col("_blocks"))
    limit = F.when(F.col("epoch") < F.col("_full"), b).otherwise(F.least(b, F.col("_rem") - F.col("block") * b))
    return slots.select("position", "source", "block", "epoch", limit.alias("limit"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, block_words: int = 1024, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_slots (slots that take
    words of the document) and first_position (of the first of these; null
    where there is none)."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), count_words(text_or_empty()).alias("size"), h.alias("_h"))
    sized = written(sized.withColumn("_chunk", F.substring("_h", 1, 3)), "mix-sizes")
    plan = written(source_targets(sized, weights, share, max_epochs), "mix-targets")
    placed = running_total(sized.filter("size > 0"), ["source"], "_chunk", ["_h", "doc_id", "size"], F.col("size"), "_start")
    b = F.lit(block_words).cast("bigint")
    pieces = placed.select(
        "doc_id", "source", "size", "_start",
        F.explode(F.sequence(F.expr(f"_start div {block_words}"), F.expr(f"(_start + size - 1) div {block_words}"))).alias("block"))
    pieces = pieces.withColumn("_from", F.greatest(F.col("_start") - F.col("block") * b, F.lit(0)))
    pieces = pieces.withColumn("_to", F.least(F.col("_start") + F.col("size") - F.col("block") * b, b))
    slots = schedule(plan, block_words)
    part = F.greatest(F.least(F.col("_to"), F.coalesce("limit", F.lit(0))) - F.col("_from"), F.lit(0))
    hit = join_on(pieces, slots, ["source", "block"], "left").select(
        "doc_id", "source", "size", "_start", part.alias("_part"), "position")
    taken = hit.groupBy("source", "_start", "doc_id", "size").agg(
        F.sum("_part").cast("bigint").alias("taken"), F.count_if(F.col("_part") > 0).alias("n_slots"), F.min(F.when(F.col("_part") > 0, F.col("position"))).alias("first_position"))
    taken = taken.select("doc_id", "source", "size", "taken", "n_slots", "first_position").union(
        sized.filter("size = 0").select("doc_id", "source", "size", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("bigint")))
    return join_on(taken, plan, ["source"]).select("doc_id", "source", "size", "source_size", "target", "taken", "n_slots", "first_position")


def mixed_documents(docs: DataFrame, **mix) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes
    them: taken words over words, rounded half up.

    Rows equal in doc_id, source and size share their taken words evenly.
    """
    key = ["doc_id", "source", "size"]
    taken = mix_documents(docs, **mix).groupBy(*key).agg(F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    copies = F.floor(F.col("_taken") / (F.col("size") * F.col("_rows")) + F.lit(0.5)).cast("int")
    taken = taken.filter("size > 0").withColumn("_copies", copies).filter("_copies > 0").select(*key, "_copies")
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.col("source").cast("string").alias("source"), count_words(text_or_empty()).alias("size"))
    both = join_on(rows, taken, key)
    return both.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("_row.*")
