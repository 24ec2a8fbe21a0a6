import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import metering
from auralake.streaming import monitor


def drained(df, tmp_path, mode):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table("out").collect()


def test_filter_does_not_depend_on_batches(spark, tmp_path):
    c = metering.k_weighting(48000)[0]
    x = np.random.default_rng(1).normal(size=(2, 400))
    rows = [(ch, n, x[ch, 50 * n : 50 * n + 50].tolist()) for n in range(8) for ch in range(2)]
    schema = "ch int, n long, samples array<double>"
    for k in range(4):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(monitor.filtered_stream(stream, ["ch"], "n", "samples", c.tolist()), tmp_path, "append")
    for ch in range(2):
        y = np.concatenate([r["samples"] for r in sorted((r for r in got if r["ch"] == ch), key=lambda r: r["n"])])
        assert y == pytest.approx(metering.biquad(x[ch], c)[0])


def test_latest_override_and_levels(spark, tmp_path):
    schema = "id string, revision long, gain double, ts timestamp"
    t = lambda s: F.lit(f"2024-01-01 00:00:{s:02d}").cast("timestamp")
    for k, (i, rev, gain) in enumerate([("a", 1, 0.5), ("b", 9, 3.0), ("a", 3, -4.0), ("a", 2, 2.0)]):
        spark.range(1).select(F.lit(i).alias("id"), F.lit(rev).cast("long").alias("revision"), F.lit(gain).alias("gain"), t(k).alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {r["id"]: r["gain"] for r in drained(monitor.latest_overrides(stream.drop("ts"), ["id"]), tmp_path, "complete")}
    assert got == {"a": -4.0, "b": 3.0}
    (tmp_path / "two").mkdir()
    levels = monitor.sliding_levels(stream, ["id"], "ts", F.col("gain"), "4 seconds", "2 seconds", "1 minute")
    rows = drained(levels, tmp_path / "two", "update")
    assert max(r["peak"] for r in rows if r["id"] == "a") == 4.0
    one = spark.range(1).select(monitor.looped(F.lit(25), F.lit(10), F.lit(6)).alias("l"), monitor.crossfaded(F.lit(0.25), F.lit(0.75), F.lit(1024), F.lit(0)).alias("c")).head()
    assert one["l"] == 13 and one["c"] == 0.5
