"""Shared pieces: tables, scratch space on the shared folder, ranks without
one big window, and connected components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master
    (tests, a laptop) falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master or "").startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
    root = "file://" + tempfile.mkdtemp(prefix="auralake-")
    spark.conf.set("spark.checkpoint.dir", root)
    sc.setCheckpointDir(root)
    return root


def staged(df: DataFrame, tag: str, compression: str = "zstd", **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation.
    Shuffle files behind tables written before go as soon as the driver no
    longer knows them, for which its garbage is collected here where the
    session has a JVM in reach. :func:`dropped` deletes a table.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_root(spark)}/auralake/{uuid.uuid4().hex}/{tag}"
    df.write.options(compression=compression, **options).parquet(path)
    del df
    gc.collect()
    if jvm := getattr(getattr(spark, "_sc", None), "_jvm", None):
        jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`staged` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict = {}


def kept_by_worker(kind: str, key, make):
    """What a worker process keeps from task to task: the last thing made, and
    nothing else, so that caches of several operators never add up."""
    if (kind, key) not in _kept:
        _kept.clear()
        _kept[kind, key] = make()
    return _kept[kind, key]


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables inside an iteration."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def in_groups(batch: pa.RecordBatch, column: int, rows: int, size: int):
    """Slices of a batch of at most ``rows`` rows and, if of several, ``size`` bytes of a column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = min(max(int(np.searchsorted(ends, before + size, "right")), at + 1), at + rows)
        yield batch.slice(at, upto - at)
        at = upto


def ranked_within(
    df: DataFrame, keys: list[str], order: list[str], rank: str, counts: DataFrame, rows_per_part: int = 500, small_counts: bool = False
) -> DataFrame:
    """Number the rows of each key 0, 1, 2, … without one window per key.

    ``counts`` has ``keys`` and ``n`` (rows of the key); it is small next to
    ``df``. A key of more than ``rows_per_part`` rows is dealt over several
    parts by the hash of ``order``, so a key with a third of all rows is
    numbered by many tasks. Parts are numbered one after the other. A key of
    n rows has parts of about sqrt(n) rows, and so about as many parts, from
    the square of ``rows_per_part`` on. ``order`` should tell the rows of a key
    apart: equal ones fall in one part.
    ``small_counts``: the caller has a bound on the rows of ``counts``, so it
    is broadcast.
    """
    each = F.greatest(F.lit(float(rows_per_part)), F.sqrt(F.col("n").cast("double")))
    parts = counts.select(*keys, F.ceil(F.col("n") / each).cast("long").alias("_parts"))
    dealt = df.join(F.broadcast(parts) if small_counts else parts, keys).withColumn(
        "_part", F.pmod(F.xxhash64(*order), F.greatest(F.col("_parts"), F.lit(1)))
    )
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_part"])
        .withColumn(rank, F.col("_offset") + F.col("_row"))
        .drop("_parts", "_part", "_row", "_offset")
    )


def neighbours(ids: DataFrame, key: str, target_rows: int = 50_000) -> tuple[DataFrame, int]:
    """For each distinct ``key`` the next smaller one; the smallest gets the largest.

    Ranges of keys are dealt to partitions, and the table of ids is written
    so that the ranges stay fixed; only one row a range meets in one place.
    Returns a table of ``key`` and ``next_key``, and the number of keys.
    """
    parts = max(1, math.ceil(ids.count() / target_rows))
    placed = staged(
        ids.select(key).distinct().repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    edges = placed.groupBy("_range").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    w, whole = Window.orderBy("_range"), Window.partitionBy()
    before = F.coalesce(F.lag("_hi").over(w), F.max("_hi").over(whole)).alias("_before")
    inside = Window.partitionBy("_range").orderBy(key)
    out = (
        placed.withColumn("_prev", F.lag(key).over(inside))
        .join(edges.select("_range", before), "_range")
        .select(key, F.coalesce("_prev", "_before").alias("next_key"))
    )
    return out, placed.count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: ``node``, ``component`` (the
    smallest node of its component).

    ``edges`` has long columns ``a`` and ``b``. Alternates large-star and
    small-star steps until the edges no longer change; each step is two
    shuffles, and its edges are checkpointed.
    """
    cur = checkpointed(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        # large star: neighbours larger than u go to the smallest of u and its neighbours
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        cur = checkpointed(small)
        seen = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")).head()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def maybe_in(df: DataFrame, key: str, ids: DataFrame, bits: int = 24) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``ids`` (one column): all that
    are, few that are not. A cheap filter before an exact join.

    The filter is one hash bit an id, in ``2 ** (bits - 6)`` words at most; so
    what is broadcast has a fixed bound (4 MB of words for 24 bits). With very
    many ids it fills up and lets all rows pass, to the exact join.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    at = ids.select(spot(F.col(ids.columns[0])).alias("_spot"))
    words = at.groupBy(F.shiftright("_spot", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(_spot & 63))")).alias("_bits")
    )
    return (
        df.withColumn("_spot", spot(F.col(key)))
        .withColumn("_word", F.shiftright("_spot", 6))
        .join(F.broadcast(words), "_word")
        .filter(F.expr("getbit(_bits, int(_spot & 63)) = 1"))
        .drop("_word", "_spot", "_bits")
    )
