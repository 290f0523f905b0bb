"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchyard.llm.base import running_before, small, stash

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5, 2, 1)
#: How often a document may be repeated in the mix.
REPEATS = 3
#: Words of a packet, the unit that is queued; the last packet of a document may be shorter.
PACKET = 128
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source (`source_ix`, `source`, `source_size`, `target`): shares of all sizes by weight, none above
    `repeats` times its source's size.

    With the sources sorted by cap / weight, a source is capped when its cap is at most what the excess so far would
    give it, and the capped ones come first; so two running sums replace any loop. The one window without a partition
    runs over sources, which were aggregated before."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = by_source.withColumn("source_ix", F.row_number().over(rank) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_ix") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("ratio", "source_ix").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    s = s.withColumns({"used": F.coalesce(F.sum("cap").over(earlier), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(earlier), F.lit(0))})
    level = (F.col("total") - F.col("used")).cast("double") / (F.col("all_weight") - F.col("gone"))
    s = s.withColumn("capped", F.col("ratio") <= level)
    s = s.withColumns({"capped_size": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything), "capped_weight": F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything)})
    level = (F.col("total") - F.col("capped_size")).cast("double") / F.nullif(F.col("all_weight") - F.col("capped_weight"), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return s.select("source_ix", "source", "source_size", target.alias("target"), "total")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, packet: int = PACKET, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text, source, and the columns named in `keep`. One row per row of docs: doc_id, size, source_size,
    target, taken, and `keep`.

    Each source's documents are shuffled by a hash of their id and queued `repeats` times over, in packets of at most
    `packet` words. A packet that begins after s words of its queue and has k finishes at virtual time (s + k) / target.
    All packets of all sources are range-sorted by that time, and taken from the front until the total budget, the words
    of all documents, is used up; the packet on the edge is cut there. At time 1 every source has been served its target
    but for the packet in service, so a source ends near its target: what is open then goes to the packets that finish
    next. A document longer than a packet may be taken in part.

    Packets that finish after time 1 + 2d, d = sources * packet / spare, are left out of the sort: spare is what all
    sources together can serve beyond their targets by time 2, so by time 1 + d the budget is used up. Where that proves
    nothing (d > 1) all packets are sorted.

    Null or empty text has size 0 and is never taken; a null source is a source; a null doc_id is shuffled as an empty
    one; rows that repeat count each; an empty table gives none."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}")))
    sizes = stash(docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("key"), *keep), "sizes")
    goals = targets(sizes, weights, repeats)
    spare = goals.agg(F.sum(F.greatest(F.lit(0.0), F.least("target", F.col("source_size") * repeats - F.col("target")))).alias("spare"), F.count(F.lit(1)).alias("sources"))
    d = F.col("sources") * packet / F.col("spare")
    horizon = F.when((F.col("spare") > 0) & (d <= 1), 1 + 2 * d)
    goals = stash(goals.join(F.broadcast(spare.select(horizon.alias("horizon")))), "targets")
    rows = sizes.alias("a").join(small(goals).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).drop("source")
    rows = rows.withColumn("at", F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32))
    queued = stash(running_before(rows, ["source_ix"], "at", ["key", "doc_id", "size"], "size").withColumn("row", F.monotonically_increasing_id()), "queue")
    copies = queued.where("size > 0").withColumn("copy", F.explode(F.expr(f"sequence(0, {repeats - 1})")))
    packets = copies.withColumn("packet", F.explode(F.expr(f"sequence(0, (size - 1) div {packet})")))
    packets = packets.withColumn("starts", F.col("copy") * F.col("source_size") + F.col("before") + F.col("packet") * packet)
    packets = packets.withColumn("length", F.least(F.lit(packet), F.col("size") - F.col("packet") * packet))
    packets = packets.withColumn("finish", (F.col("starts") + F.col("length")) / F.col("target")).where("horizon is null or finish <= horizon")
    # Virtual time runs evenly in served words: equal slices of it are the ranges of the global sort.
    last = F.coalesce(F.col("horizon"), F.lit(2.0))
    packets = packets.select("row", "source_ix", "starts", "total", "length", "finish", F.lit(0).alias("all"), F.least(F.col("finish") / last * 0.999, F.lit(0.9999)).alias("at"))
    placed = running_before(stash(packets, "packets"), ["all"], "at", ["finish", "source_ix", "starts"], "length")
    taken = placed.where("before < total").groupBy("row").agg(F.sum(F.least("length", F.col("total") - F.col("before"))).alias("taken"))
    out = queued.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *keep)
