"""Operators on timelines, beds and meters against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.functions import geometry
from auralake.operators import lookups, metering, timeline


def test_active_block_with_open_ends_gaps_and_any_bucket(spark):
    r = random.Random(2)
    blocks, frames = [], [(c, f) for c in "abc" for f in range(-3, 120, 2)]
    for c in "ab":
        at = 5
        for k in range(12):
            length = r.randrange(1, 14)
            blocks.append((c, k, at, None if k == 11 else at + length - r.randrange(0, 3)))
            at += length
    want = {(c, f): k for c, f in frames for b, k, s, e in blocks if b == c and s <= f and (e is None or f < e)}
    df = spark.createDataFrame(blocks, "ch string, k int, s long, e long")
    asked = spark.createDataFrame(frames, "ch string, f long")
    for bucket in (1, 7, 1000):
        got = {(x["ch"], x["f"]): x["k"] for x in timeline.active_at(df, asked, ["ch"], "f", "s", "e", bucket).collect()}
        assert got == want


def brute_groups(rows):
    used, out = set(), set()
    for i, (o, a, e) in enumerate(rows):
        if o in used:
            continue
        used.add(o)
        partner = None
        if a is not None and abs(a) > 1:
            for p, b, f in rows[i + 1 :]:
                if p not in used and b is not None and abs(a + b) < 1 and abs(e - f) < 1:
                    partner = p
                    break
        if partner is None:
            out.add((o, None))
        else:
            used.add(partner)
            out.add((o, partner) if a >= 0 else (partner, o))
    return out


def test_mirrored_beds_are_paired_greedily_within_a_tolerance(spark):
    r = random.Random(4)
    beds = {"five": [(0, 30.0, 0.0), (1, -29.6, 0.2), (2, 0.0, 0.0), (3, 110.0, 0.0), (4, -110.0, 30.0)], "none": [(0, None, None)]}
    for k in range(20):
        beds[f"b{k}"] = [(j, r.choice([0.5, 30.0, 30.4, -30.0, -30.8, 90.0, -90.0, None]), 0.0) for j in range(r.randrange(1, 9))]
        beds[f"b{k}"] = [(j, a, r.choice([0.0, 0.9, 30.0]) if a is not None else None) for j, a, _ in beds[f"b{k}"]]
    df = spark.createDataFrame([(b, *x) for b, rows in beds.items() for x in rows], "bed string, ord int, az double, el double")
    got = {}
    for x in lookups.mirror_groups(df, ["bed"], "ord", "az", "el").collect():
        got.setdefault(x["bed"], set()).add((x["left_ord"], x["right_ord"]))
    assert got == {b: brute_groups(rows) for b, rows in beds.items()}


def test_true_peak_does_not_depend_on_the_blocks(spark):
    x = np.random.default_rng(5).normal(size=400)
    want = metering.true_peak(x)
    for cuts in ([400], [1, 2, 3, 50, 400], [200, 210, 215, 400]):
        rows = [("a", k, x[lo:hi].tolist()) for k, (lo, hi) in enumerate(zip([0, *cuts], cuts))]
        out = metering.true_peaks(spark.createDataFrame(rows, "ch string, n int, s array<double>"), ["ch"], "n", "s")
        assert out.head()["peak"] == pytest.approx(want)
    assert want >= np.abs(x).max() * 0.999


def test_trims_smoothing_and_keyframes(spark):
    rows = [(0.0, None, 100), (-1.0, None, 100), (0.5, 0.5, 100), (0.0145, 0.0155, 100), (0.01, 0.0101, 100), (0.2, None, 100), (0.05, 9.0, 100)]
    df = spark.createDataFrame(rows, "a double, z double, n long")
    got = [r["x"] and tuple(r["x"]) for r in df.select(timeline.trimmed(F.col("a"), F.col("z"), F.lit(1000), F.col("n")).alias("x")).collect()]
    assert got == [(0, 100), None, None, (15, 16), None, None, (50, 100)]
    df = spark.createDataFrame([(1.0, 3.0, 0, 5), (1.0, 3.0, 2, 5), (1.0, 3.0, 4, 5), (None, 3.0, 2, 5), (1.0, 3.0, 0, 1)], "a double, z double, f int, n int")
    got = [r["x"] for r in df.select(timeline.smoothed(F.col("a"), F.col("z"), F.col("f"), F.col("n"), F.lit(-1.0)).alias("x")).collect()]
    assert got == [1.0, 2.0, 3.0, -1.0, 1.0]
    df = spark.createDataFrame([(5.0, 4.0, 2.0, 0.0, 8.0), (7.0, 4.0, 2.0, 0.0, 8.0), (1.0, 4.0, 2.0, 0.0, 8.0), (5.0, 4.0, 2.0, None, 8.0), (5.0, 4.0, 0.0, 0.0, 8.0)], "t double, at double, len double, b double, v double")
    got = [r["x"] for r in df.select(timeline.keyframed(*(F.col(c) for c in ("t", "at", "len", "b", "v"))).alias("x")).collect()]
    assert got == [4.0, 8.0, 0.0, 8.0, 8.0]


def test_an_extent_of_nothing_has_one_direction(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 0.0)], "w double, h double")
    radii = geometry.extent_radii(F.col("w"), F.col("h"), F.lit(0.0), F.lit(1.0))
    got = [r["n"] for r in df.select(F.size(geometry.extent_places(radii)).alias("n")).collect()]
    assert got == [1, 16]


def test_k_weighting_by_blocks_is_that_of_the_whole_signal(spark):
    x = np.random.default_rng(7).normal(size=1000)
    y = x
    for c in metering.k_weighting(8000.0):
        y, _ = metering.biquad(y, c)
    want = np.add.reduceat(y * y, range(0, 1000, 30))
    rows = [(ch, 10 * k, float(v)) for ch in "ab" for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ch string, t long, x double").repartition(4)
    for bucket in (20, 770, 10_000_000):
        got = metering.k_weighted_energy(df, ["ch"], "t", "x", 8000.0, 30, bucket).orderBy("ch", "hop").collect()
        assert [r["e"] for r in got] == pytest.approx([*want, *want], rel=1e-9)
        assert [r["n"] for r in got] == [*[30] * 33, 10] * 2


def test_overlap_add_with_empty_and_short_blocks(spark):
    x, kernel = np.random.default_rng(1).normal(size=90), np.random.default_rng(2).normal(size=12).tolist()
    want = np.convolve(x, kernel)[:90]
    cuts = [0, 1, 1, 3, 40, 41, 90]
    rows = [("a", k, x[lo:hi].tolist()) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    out = metering.overlap_add(spark.createDataFrame(rows, "ch string, n int, s array<double>"), ["ch"], "n", "s", kernel)
    assert np.concatenate([r["s"] for r in out.orderBy("n").collect()]) == pytest.approx(want, abs=1e-9)


def test_many_small_beds_are_paired_without_a_python_call_each(spark):
    n = 150_000
    places = F.expr("inline(arrays_zip(array(0, 1, 2, 3), array(30D, -30D, 0D, 110D), array(0D, 0D, 0D, 0D))) AS (ord, az, el)")
    out = lookups.mirror_groups(spark.range(n).select(F.col("id").alias("bed"), places), ["bed"], "ord", "az", "el")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan
    got = {(r["left_ord"], r["right_ord"]): r["count"] for r in out.groupBy("left_ord", "right_ord").count().collect()}
    assert got == {(0, 1): n, (2, None): n, (3, None): n}


def test_a_held_peak_is_null_before_the_first_value_over_zero(spark):
    rows = [("a", 0, 0.0), ("a", 1, 0.0), ("a", 2, 8.0), ("a", 3, 0.0), ("b", 0, None), ("b", 1, 2.0)]
    out = metering.held_peak(spark.createDataFrame(rows, "ch string, k int, x double"), ["ch"], ["k"], "x", 0.5)
    got = [r["held"] for r in out.orderBy("ch", "k").collect()]
    assert got[:2] == [None, None] and got[4] is None and got[2:4] + got[5:] == pytest.approx([8.0, 4.0, 2.0])


def test_true_peaks_of_many_signals_in_one_batch(spark):
    r = np.random.default_rng(3)
    x = {c: r.normal(size=r.integers(1, 30)).tolist() for c in range(200)}
    x[7] = [1.0, None, -2.0, 0.5]
    cut = lambda c: (c * 7) % (len(x[c]) + 1)
    rows = [(c, k, v) for c in x for k, v in enumerate((x[c][: cut(c)], [], x[c][cut(c) :]))]
    out = metering.true_peaks(spark.createDataFrame(rows, "ch int, n int, s array<double>").coalesce(1), ["ch"], "n", "s", 4, 3)
    want = {c: metering.true_peak(np.array([e or 0.0 for e in v]), 4, 3) for c, v in x.items()}
    assert {p["ch"]: p["peak"] for p in out.collect()} == pytest.approx(want)


def test_starts_through_a_nest_that_is_reached_again_later(spark):
    edges = [(1, 2, 10), (2, 3, 10), (1, 4, 1), (4, 5, 1), (5, 2, 1), (3, 1, 5), (9, 3, 0), (None, 3, 0)]
    df = spark.createDataFrame(edges, "parent long, child long, offset long")
    read = spark.sparkContext.accumulator(0)
    seen = df.select(F.udf(lambda p: read.add(1) or p, "long")("parent").alias("parent"), "child", "offset")
    got = lookups.least_start(seen, spark.createDataFrame([(1, 0), (1, 7), (9, 40)], "node long, start long"))
    assert {r["node"]: r["start"] for r in got.collect()} == {1: 0, 2: 3, 3: 13, 4: 1, 5: 2, 9: 40}
    assert read.value <= 2 * len(edges)  # not made anew in each round; a checkpoint may read twice
