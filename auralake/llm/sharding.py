"""Sharding by longest-processing-time scheduling (operator 1).

Rows with equal texts form a group that stays together. Groups are scheduled
largest first, each to the least loaded shard, through a heap.

The schedule is made from the histogram of group sizes: groups of one size are
alike, so the heap deals them out in whole turns over the shards that are in
reach of the least loaded one, and its work and what the driver sees go with
the number of distinct sizes (at most the square root of twice the bytes of
all groups, and mostly far fewer) and not with the number of groups. The result is what
scheduling group by group gives. Groups then take the shards of their size by
their rank among the groups of that size.

Defined cases: a null text counts no bytes and groups with other null texts
(not with empty ones), its crc32 is that of no bytes; repeated rows keep a slot
each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, ranked_within, staged, table

ROW_BYTES = 16
PLAN = "bytes long, rank_from long, rank_to long, turn array<int>"


def schedule(histogram: dict[int, int], shards: int) -> list[tuple[int, int, int, list[int]]]:
    """Longest first to the least loaded shard, ties by shard.

    ``histogram``: how many groups there are of each size. Returns ``(size,
    rank_from, rank_to, turn)``: of the groups of a size, those with ranks in
    ``[rank_from, rank_to)`` go to the shards of ``turn``, one after the other
    and round again.
    """
    heap = [(0, s) for s in range(shards)]
    runs = []
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            # while none has had a second group, these are the least loaded, in this order
            turn = [heapq.heappop(heap)]
            while heap and heap[0][0] < turn[0][0] + size and len(turn) < left:
                turn.append(heapq.heappop(heap))
            whole = max(1, left // len(turn))
            if heap:  # turns go on until the last of them would reach the next shard
                whole = min(whole, max(1, -((turn[-1][0] - heap[0][0]) // size)))
            n = whole * len(turn)
            runs.append((size, rank, rank + n, [s for _, s in turn]))
            rank, left = rank + n, left - n
            for load, s in turn:
                heapq.heappush(heap, (load + whole * size, s))
    return runs


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary"))).alias("grp"),
        ),
        "rows",
    )
    groups = staged(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "groups")
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"))
    plan = spark.createDataFrame(schedule({r["bytes"]: r["n"] for r in sizes.collect()}, shards), PLAN)
    # the runs of a size as one row: of a size there are at most as many as there are shards, and one more
    plan = plan.groupBy("bytes").agg(F.array_sort(F.collect_list(F.struct("rank_from", "rank_to", "turn"))).alias("runs"))
    ranked = ranked_within(groups.select("grp", "bytes"), ["bytes"], ["grp"], "rank", sizes).join(plan, "bytes")
    run = F.expr("filter(runs, r -> rank >= r.rank_from AND rank < r.rank_to)[0]")
    placed = ranked.select("grp", "rank", run.alias("r")).select("grp", F.expr("r.turn[(rank - r.rank_from) % size(r.turn)]").alias("shard"))

    dealt = staged(rows.join(placed, "grp").select("doc_id", "size", "text_crc32", "shard"), "dealt")
    dropped(groups, rows)
    counts = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))  # a row a shard
    at = dealt.withColumn("_at", F.monotonically_increasing_id())  # tells repeated rows of the written table apart
    order = ["doc_id", "text_crc32", "size", "_at"]
    return ranked_within(at, ["shard"], order, "slot", counts, small_counts=True).drop("_at")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


QUERIES = {"op1_sharding": op1_sharding}
