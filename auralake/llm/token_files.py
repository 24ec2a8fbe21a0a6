"""Token-id files of directly addressable codes (operator 8).

A block holds the ids of some documents, least significant chunk first. Level 0
has one chunk (8 bits) of every id; a bitmap says which ids continue on the
next level, which has a chunk of those alone, and so on. A rank directory (set
bits before each 512-bit block) finds the place on the next level, so any id is
read by a few lookups, without decoding what stands before it.

Block layout, little-endian: ``DAC1``, ids (u64), levels (u8); then for each
level: chunks (u64), bitmap, directory (u32 each), chunks. The last level has
neither bitmap nor directory.

Blocks are rows of Parquet files in the shared folder, written in ascending order
of doc_id by tasks that each own a range of ids; Spark's committer makes the files
appear whole or not at all, on any file system that Spark writes to. The files
are neither compressed nor dictionary-coded, so a block in them is the codes
themselves, and :func:`tokens_at` reads single ids from it in place. It finds
the block of a position by an index of one row a block.

Defined cases: a null or empty text has the end id alone; repeated rows keep a
place each, ties in doc_id stand in order of text; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_groups, maybe_in, staged, table
from .tokens import default_path, encoder

MAGIC, RANK_BITS = b"DAC1", 512
BLOCKS = "part int, block int, part_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, codes binary"


def write_codes(ids: np.ndarray) -> bytes:
    rest, levels = ids.astype(np.uint64), []
    while True:
        more = rest >= 256
        last = not more.any()
        body = [struct.pack("<Q", len(rest))]
        if not last:
            bits = np.packbits(more, bitorder="little")
            bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
            ones = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(1)
            body += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
        levels.append(b"".join([*body, (rest & 255).astype(np.uint8).tobytes()]))
        if last:
            return MAGIC + struct.pack("<QB", len(ids), len(levels)) + b"".join(levels)
        rest = rest[more] >> 8


@dataclass
class Codes:
    """A block of codes that is read in place."""

    data: bytes

    def __post_init__(self):
        if self.data[:4] != MAGIC:
            raise ValueError("not a block of codes")
        self.n, levels = struct.unpack_from("<QB", self.data, 4)
        self.levels, at = [], 13
        for k in range(levels):
            (n,) = struct.unpack_from("<Q", self.data, at)
            at, bits, ranks = at + 8, None, None
            if k + 1 < levels:
                blocks = -(-n // RANK_BITS)
                bits = np.frombuffer(self.data, np.uint8, blocks * RANK_BITS // 8, at)
                at += len(bits)
                ranks = np.frombuffer(self.data, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((bits, ranks, np.frombuffer(self.data, np.uint8, n, at)))
            at += n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (bits, ranks, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(bits, ranks, i)
        return value

    @staticmethod
    def _rank(bits, ranks, i: int) -> int:
        block = i // RANK_BITS
        whole = bits[block * (RANK_BITS // 8) : i >> 3]
        part = int(bits[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(ranks[block]) + int(np.bitwise_count(whole).sum(dtype=np.int64)) + part.bit_count()

    def read(self, lo: int, hi: int) -> np.ndarray:
        """The ids in [lo, hi), each level as one slice."""
        out = np.zeros(hi - lo, np.uint32)
        where = np.arange(hi - lo)
        for k, (bits, ranks, chunks) in enumerate(self.levels):
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * k)
            if bits is None or lo == hi:
                break
            on = np.unpackbits(bits[lo >> 3 : -(-hi // 8)], bitorder="little")[lo & 7 :][: hi - lo].astype(bool)
            where = where[on]
            lo = self._rank(bits, ranks, lo)
            hi = lo + len(where)
        return out


def write_token_files(
    docs: DataFrame, end_id: int = 0, path: str | None = None, block_tokens: int = 1 << 14
) -> DataFrame:
    """Write the ids of all documents; returns the table of blocks as written
    (``BLOCKS``). ``part_start``: ids before the block in its part."""
    path = path or default_path()

    def run(batches):
        encode, end = encoder(path).encode, np.array([end_id], np.uint32)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held, doc_ids, sizes, n = [], [], [], 0

        def flush():
            nonlocal block, start, held, doc_ids, sizes, n
            row = [[part], [block], [start], [n], [doc_ids], [sizes], [write_codes(np.concatenate(held))]]
            block, start = block + 1, start + n
            held, doc_ids, sizes, n = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, fields)], schema=fields)

        longs = pa.list_(pa.int64())
        fields = pa.schema(
            [("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64())]
            + [("doc_ids", longs), ("doc_tokens", longs), ("codes", pa.binary())]
        )
        for batch in (g for b in batches for g in in_groups(b, 1, 2000, 8 << 20)):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(x.as_py() for x in batch.column(1)), strict=True):
                held += [ids, end]
                doc_ids.append(doc_id)
                sizes.append(len(ids) + 1)
                n += len(ids) + 1
                if n >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # pages of a few blocks, so that neither a writer nor a reader holds much of a file
    check = {f"parquet.{x}.row.check.{y}": "16" for x in ("page.size", "block.size") for y in ("min", "max")}
    as_they_are = {"parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)} | check
    return staged(ordered.mapInArrow(run, BLOCKS), "token_files", "none", **as_they_are)


def _placed(blocks: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of every block with ``start``, the ids before it in all files."""
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a written part: as many as tasks wrote, never as many as documents
    starts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    start = (F.col("before") + F.col("part_start")).alias("start")
    return blocks.join(F.broadcast(starts), "part").select(start, *columns)


def tokens_at(blocks: DataFrame, positions: DataFrame, span: int = 1 << 17) -> DataFrame:
    """``position, id`` for the rows of ``positions`` (a long ``position``: the
    number of the id in all files). Positions beyond the files give no row.

    Positions meet their block through spans of ``span`` ids; then each block
    that is asked for comes once, and its ids are looked up one by one in the
    codes, without decoding others.
    """
    index = _placed(blocks, "part", "block", "n_tokens")
    first, last = F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("n_tokens") - 1) / span)
    spans = index.select("part", "block", "start", "n_tokens", F.explode(F.sequence(first, last)).alias("span"))
    asked = positions.select("position", F.floor(F.col("position") / span).alias("span"))
    placed = asked.join(spans, "span").filter("position >= start AND position < start + n_tokens")
    # of one block: at most as many distinct positions as it has ids
    wanted = placed.groupBy("part", "block", "start").agg(F.collect_set("position").alias("positions"))

    def run(batches):
        for batch in batches:
            at, ids = [], []
            for start, some, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block = Codes(memoryview(codes.as_buffer()))
                at += some
                ids += [block[p - start] for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.int64())], ["position", "id"])

    key = F.xxhash64("part", "block")
    some = maybe_in(blocks.select("part", "block", "codes", key.alias("_key")), "_key", wanted.select(key)).drop("_key")
    found = wanted.join(some, ["part", "block"]).select("start", "positions", "codes")
    return found.mapInArrow(run, "position long, id long")


def read_token_files(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for start, ids, sizes, codes in zip(*(batch.column(k) for k in range(4))):
                at, codes, start = 0, Codes(codes.as_py()), start.as_py()
                for doc_id, n in zip(ids.as_py(), sizes.as_py()):
                    crc = zlib.crc32(codes.read(at, at + n).astype("<u4").tobytes())
                    for c, v in zip(rows, (doc_id, start + at, n, crc)):
                        c.append(v)
                    at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    found = _placed(blocks, "doc_ids", "doc_tokens", "codes")
    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), end_id=0))


QUERIES = {"op8_token_files": op8_token_files}
