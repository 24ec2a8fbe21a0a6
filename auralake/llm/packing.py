"""Best-fit packing of documents into sequences (operator 6).

Planning looks only at the histogram of piece lengths: best-fit decreasing over
counts gives, for each length, runs of slots (sequence and offset). Pieces then
take the slots of their length by their rank among the pieces of that length.
The histogram has at most ``capacity`` rows, and so has what the driver plans
from, whatever the number of documents.

A document's ids end with ``end_id``. A document of more than ``capacity`` ids
is cut; its first piece takes what is over, the others are full.

Defined cases: a null or empty text is one piece with the end id alone;
repeated rows are packed one by one; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_groups, ranked_within, staged, table
from .tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized_pieces(docs: DataFrame, capacity: int, end_id: int, path: str, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``PIECES``, and ``ids array<int>`` if asked for."""

    def run(batches):
        encode, end = encoder(path).encode, np.array([end_id], np.uint32)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in (g for b in batches for g in in_groups(b, 1, 2000, 8 << 20)):
            cols: list[list] = [[], [], [], [], []]
            kept = []
            texts = (x.as_py() for x in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                n = len(ids) + 1
                for k, (s, m) in enumerate(cut(n, capacity)):
                    crc = zlib.crc32(ids[s : s + m])  # the last piece has the end id as well
                    for c, v in zip(cols, (doc_id, k, s, m, zlib.crc32(end, crc) if s + m == n else crc)):
                        c.append(v)
                if keep_ids:
                    kept += [ids, end]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            if keep_ids:
                offsets = np.cumsum([0, *cols[3]], dtype=np.int32)
                flat = np.concatenate(kept).view(np.int32) if kept else np.zeros(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(offsets, flat))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * keep_ids)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs ``(length, rank_from, rank_to, sequence, each, offset)``: the
    pieces of ``length`` with ranks in ``[rank_from, rank_to)`` go, ``each`` at
    a time, to sequences ``sequence, sequence + 1, …`` from ``offset`` on.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # ids free -> runs of sequences (first, how many)
    frees: list[int] = []
    runs, opened = [], 0

    def give(free: int, first: int, n: int) -> None:
        if n and free:
            if free not in room:
                room[free] = []
                insort(frees, free)
            room[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(frees, length)
            if at < len(frees):
                free = frees[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], frees[at]
            else:
                free = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            each = free // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, rank + whole * each, first, each, capacity - free))
                give(free - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n:
                if left and left < each:
                    runs.append((length, rank, rank + left, first + whole, left, capacity - free))
                    give(free - left * length, first + whole, 1)
                    whole, rank, left = whole + 1, rank + left, 0
                give(free, first + whole, n - whole)
    return runs


def pack_documents(
    docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """``PIECES`` with ``sequence_id, offset`` (and ``ids``) for all documents."""
    spark = docs.sparkSession
    pieces = staged(tokenized_pieces(docs, capacity, end_id, path or default_path(), keep_ids), "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    schema = "length long, rank_from long, rank_to long, sequence long, each long, first_offset long"
    # a run empties or splits a set of equally free sequences: at most a few for each of `capacity` lengths
    plan = spark.createDataFrame(best_fit(histogram, capacity), schema)
    run = F.struct("rank_from", "rank_to", "sequence", "each", "first_offset")
    plan = plan.groupBy("length").agg(F.collect_list(run).alias("runs"))
    bounded = spark.createDataFrame(sorted(histogram.items()), "length long, n long")
    # the written table's row numbers tell repeated rows apart
    numbered = pieces.withColumn("_at", F.monotonically_increasing_id())
    ranked = ranked_within(numbered, ["length"], ["doc_id", "piece", "ids_crc32", "_at"], "rank", bounded, small_counts=True)
    own = F.expr("filter(runs, r -> rank >= r.rank_from AND rank < r.rank_to)[0]").alias("r")
    return ranked.join(F.broadcast(plan), "length").select(*pieces.columns, "rank", own).select(
        *pieces.columns,
        F.expr("r.sequence + (rank - r.rank_from) div r.each").alias("sequence_id"),
        F.expr("r.first_offset + (rank - r.rank_from) % r.each * length").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (needs ``keep_ids``).
    A sequence has at most ``capacity`` ids, so a group is small."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
