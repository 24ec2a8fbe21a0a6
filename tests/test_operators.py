import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.functions import geometry, harmonics, labels, levels
from auralake.operators import lookups, metering, mixing, prefixes, rules, timeline


def one(spark, **columns):
    """Values of expressions over a single row."""
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).head().asDict()


def blocks(seed, n=60):
    r = random.Random(seed)
    return [(r.randrange(3), s := r.randrange(100), None if r.random() < 0.1 else s + r.randrange(30), k) for k in range(n)]


def test_overlap_rules_against_a_cursor(spark):
    rows = blocks(1)
    df = spark.createDataFrame(rows, "ch int, s long, e long, ord int")
    last = timeline.last_start_wins(df, ["ch"], "s", "e", ["ord"])
    first = timeline.first_not_ended_wins(df, ["ch"], "s", "e", ["ord"])
    frames = spark.createDataFrame([(c, f) for c in range(3) for f in range(140)], "ch int, f long")
    lately = timeline.active_at(last.withColumn("eff_end", F.least("eff_end", F.lit(140))), frames, ["ch"], "f", "s", "eff_end", 7)
    got = {(r["ch"], r["f"]): r["ord"] for r in lately.collect()}
    early = timeline.active_at(first.withColumn("e", F.least(timeline.open_end(F.col("e")), F.lit(140))), frames, ["ch"], "f", "eff_start", "e", 7)
    got2 = {(r["ch"], r["f"]): r["ord"] for r in early.collect()}
    for c in range(3):
        own = sorted((s, k, math.inf if e is None else e) for ch, s, e, k in rows if ch == c)
        for f in range(140):
            started = [b for b in own if b[0] <= f]
            want = started[-1][1] if started and f < started[-1][2] else None
            assert got.get((c, f)) == want
            open_ = next((b for b in own if b[2] > f), None)
            assert got2.get((c, f)) == (open_[1] if open_ and open_[0] <= f else None)


def test_ramps_and_windows(spark):
    df = spark.createDataFrame([(0, 0, 480, 0, 1.0, False), (0, 480, 1000, 1, 3.0, False), (0, 1000, None, 2, 5.0, True)], "ch int, s long, e long, ord int, g double, j boolean")
    eff = timeline.last_start_wins(df, ["ch"], "s", "e", ["ord"])
    out = timeline.ramped(eff, ["ch"], "s", ["ord"], "g", timeline.default_ramp(F.lit(48000)), F.col("j")).orderBy("s").collect()
    assert [(r["ramp"], r["prev_gain"]) for r in out] == [(0, 1.0), (240, 1.0), (0, 3.0)]
    value = lambda f: timeline.ramp_value(F.lit(f), F.lit(480), F.lit(240), F.lit(1.0), F.lit(3.0))
    assert one(spark, a=value(480), b=value(600), c=value(720), d=value(900)) == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 3.0}
    got = one(
        spark, clip=timeline.clipped(F.lit(5), F.lit(20), F.lit(10), F.lit(15)), none=timeline.clipped(F.lit(5), F.lit(8), F.lit(10), F.lit(15)),
        sat=timeline.saturating_add(F.lit(2**63 - 2), F.lit(9)), t=timeline.nanos_to_samples(F.lit(1_500_000_000), F.lit(3)), neg=timeline.nanos_to_samples(F.lit(-5), F.lit(48000)),
    )
    assert tuple(got["clip"]) == (10, 15) and got["none"] is None and got["sat"] == 2**63 - 1 and (got["t"], got["neg"]) == (5, 0)
    steady = timeline.steady(df, ["ch"], "s", "e", F.lit(10), F.lit(400)).head()
    assert steady["steady"] and not timeline.steady(df, ["ch"], "s", "e", F.lit(10), F.lit(500)).head()["steady"]


def test_geometry(spark):
    for az, want in ((0, 0), (180, 180), (-180, 180), (190, -170), (540, 180), (-541, 179), (359.5, -0.5)):
        assert one(spark, a=geometry.wrap_azimuth(F.lit(float(az))))["a"] == pytest.approx(want)
    p = one(spark, p=geometry.to_polar(F.lit(-1.0), F.lit(0.0), F.lit(0.0)), q=geometry.to_polar(F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    assert tuple(p["p"]) == pytest.approx((90, 0, 1)) and tuple(p["q"])[1:] == pytest.approx((90, 2))
    d = one(spark, d=geometry.diverged(F.lit(0.5), F.lit(200.0)), n=geometry.diverged(F.lit(0.0), F.lit(30.0)))
    assert [tuple(x) for x in d["d"]] == [(-120.0, pytest.approx(1 / 3)), (0.0, pytest.approx(1 / 3)), (120.0, pytest.approx(1 / 3))]
    assert [tuple(x) for x in d["n"]] == [(0.0, 1.0)]
    assert sum(w for *_, w in geometry.extent_disk()) == pytest.approx(1) and len(geometry.extent_disk()) == 16
    up = geometry.extent_direction(F.lit(0.0), F.lit(0.0), F.struct(F.lit(30.0).alias("width"), F.lit(20.0).alias("height")), F.lit(0.0), F.lit(1.0))
    side = geometry.extent_direction(F.lit(0.0), F.lit(0.0), F.struct(F.lit(30.0).alias("width"), F.lit(20.0).alias("height")), F.lit(1.0), F.lit(0.0))
    got = one(spark, up=up, side=side)
    assert tuple(got["up"]) == pytest.approx((0, 20)) and tuple(got["side"]) == pytest.approx((30, 0))
    m = geometry.head_rotation(90, 0, 0)
    turned = one(spark, v=geometry.rotated(geometry.unit_vector(F.lit(90.0), F.lit(0.0)), m))["v"]
    assert tuple(turned) == pytest.approx((0, 1, 0), abs=1e-12)
    cells = one(spark, a=geometry.grid_cell(F.lit(-179.6), F.lit(-90.0)), b=geometry.grid_cell(F.lit(0.5), F.lit(0.0)))
    assert cells["a"] == 0 and cells["b"] == 90 * 361 + 181


def test_harmonics_are_orthogonal_in_energy(spark):
    r = random.Random(0)
    rows = [(r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(4000)]
    got = np.array([x[0] for x in spark.createDataFrame(rows, "a double, e double").select(harmonics.harmonics(F.col("a"), F.col("e"))).collect()])
    n3d = got * np.array(harmonics.degree_scale())
    assert np.abs(n3d.T @ n3d / len(n3d) - np.eye(16)).max() < 0.15
    assert got[:, 0] == pytest.approx(1) and one(spark, h=harmonics.harmonics(F.lit(0.0), F.lit(0.0), 1))["h"] == pytest.approx([1, 0, 0, 1])


def test_labels_and_globs(spark):
    yes = [("*Stem", "Kick stem"), ("k?ck*", "KICK"), ("a.b", "A.B"), ("[x]*", "[x]y"), ("*", "line\nend")]
    no = [("", "x"), ("k?ck", "kck"), ("a.b", "aXb"), ("[xy]", "x"), ("É*", "éa")]
    for want, cases in ((True, yes), (False, no)):
        for glob, name in cases:
            got = one(spark, a=labels.matches_glob(F.lit(name), glob), b=rules.glob_matches(F.lit(name), F.lit(glob)))
            assert got == {"a": want, "b": want}, (glob, name)
    got = one(
        spark, d=labels.label_direction(F.lit("U-045")), x=labels.label_direction(F.lit("M+030foo")), y=labels.label_direction(F.lit("M+9")),
        s=labels.stem_and_side(F.lit("Piano_r")), p=labels.stem_and_side(F.lit("PEARL")), k=labels.label_key(F.lit("m+0 30")), c=labels.canonical_label(F.lit(" m+0 30")),
        l=labels.is_low_frequency(F.array(F.lit("rc-lfe")), F.lit(None).cast("double")), n=labels.is_low_frequency(F.array(F.lit("L")), F.lit(None).cast("double")),
        u=labels.track_uid(F.lit("atu_01  \0")), v=labels.listed(F.lit(" a,, b ,")),
    )
    assert tuple(got["d"]) == (-45.0, 30.0) and got["x"] is None and got["y"] is None and tuple(got["s"]) == ("Piano", "R") and got["p"] is None
    assert got["k"] == "M030" and got["c"] == "M+030" and got["l"] and not got["n"] and got["u"] == "ATU_01" and got["v"] == ["a", "b"]


def test_rule_changes(spark):
    """The worked case of two objects, by rule."""
    f = lambda v: F.lit(float(v))
    got = one(
        spark, off=rules.limited(f(1), F.lit(False), f(1), f(1)), half=rules.limited(f(0.5), F.lit(True), f(0.5), F.lit(None).cast("double")), cap=rules.limited(f(0.5), F.lit(None).cast("boolean"), f(1), f(0.2)),
        gain=rules.scaled_gain(f(1), f(0.5), f(20), F.lit(None).cast("boolean")), mute=rules.scaled_gain(f(1), f(1), f(0), F.lit(True)),
        a=rules.moved(f(0), f(0), f(1), {"azimuth": f(30), "d_azimuth": f(10)}), b=rules.moved(f(0), f(0), f(1), {"azimuth": f(30), "lock_azimuth": f(90)}),
        c=rules.moved(f(200), f(100), f(-1), {}), i=rules.interpolation(F.lit(True), F.lit(9600), F.lit(False), F.lit(48000), F.lit(50)), z=rules.interpolation(F.lit(True), F.lit(9600), F.lit(None).cast("boolean"), F.lit(48000), F.lit(0)),
    )
    assert (got["off"], got["half"], got["cap"], got["mute"]) == (0.0, 0.25, 0.2, 0.0) and got["gain"] == pytest.approx(5)
    assert got["a"]["azimuth"] == 40 and got["b"]["azimuth"] == 90 and tuple(got["c"]) == (-160.0, 90.0, 0.0)
    assert tuple(got["i"]) == (False, 2400) and tuple(got["z"]) == (True, 9600)
    hits = spark.createDataFrame([(1, -1, 1.0, None), (1, 0, 2.0, "x"), (1, 3, None, None), (2, 0, None, None)], "id int, rule_ord int, a double, b string")
    assert {r["id"]: (r["a"], r["b"]) for r in rules.folded(hits, ["id"], ["a", "b"]).collect()} == {1: (2.0, "x"), 2: (None, None)}


def test_lookups(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("a", "c", 1), ("c", "b", 2), ("b", "d", 1)], "parent string, child string, offset long")
    roots = spark.createDataFrame([("a", 10)], "node string, start long")
    assert {r["node"]: r["start"] for r in lookups.least_start(edges, roots).collect()} == {"a": 10, "b": 13, "c": 11, "d": 14}
    loop = edges.union(spark.createDataFrame([("d", "a", -9)], edges.schema))
    with pytest.raises(ValueError):
        lookups.least_start(loop, roots, most_rounds=5)
    names = spark.createDataFrame([(0, "x", "L"), (1, "x", "R"), (2, "x", "R"), (3, "x", "L"), (4, "y", "L")], "o int, stem string, side string")
    assert sorted(map(tuple, lookups.kth_pairs(names, "stem", "side", "o").collect())) == [("x", 0, 1), ("x", 3, 2)]


def test_mixing(spark):
    assert one(spark, p=mixing.permuted(F.array(*map(F.lit, range(8))), mixing.SWAP_REAR_SIDE))["p"] == [0, 1, 2, 3, 6, 7, 4, 5]
    frames = spark.createDataFrame([("s", 0, 0, 2, 4, 48000, [1.0, 2.0, 3.0, 4.0] * 2)], "scene_id string, block_no long, start_frame long, frames int, channels int, sample_rate int, samples array<float>")
    out = mixing.mixed_blocks(frames, [[1, 0], [0, 1], [1, 0], [0, 1]]).head()
    assert out["samples"] == [4.0, 6.0, 4.0, 6.0] and out["channels"] == 2
    ring = [30.0, -30.0, 110.0, -110.0]
    for az in range(-180, 181, 7):
        g = mixing.pair_gains(ring, az)
        assert math.hypot(*g) == pytest.approx(1) and sum(x > 1e-9 for x in g) <= 2
        x, y = (sum(v * f(math.radians(a)) for v, a in zip(g, ring)) for f in (math.cos, math.sin))
        assert math.degrees(math.atan2(y, x)) == pytest.approx(az, abs=1e-6) or abs(az) == 180
    left, right = mixing.stereo_fold([(90, False), (0, False), (0, True)])[0], mixing.stereo_fold([(0, False)])[0]
    assert left == pytest.approx([1, 0]) and right == pytest.approx([math.sqrt(0.5)] * 2)
    assert one(spark, g=mixing.strongest_three(F.array(*map(F.lit, [0.0, 0.2, 0.2, 0.4, 0.9]))))["g"] == pytest.approx([0.25, 0.25, 0.5])


def test_meters(spark):
    rate = 48000
    t = np.arange(rate * 5) / rate
    x = 0.5 * np.sin(2 * math.pi * 997 * t)
    y, _ = metering.biquad(x, metering.k_weighting(rate)[0])
    y, _ = metering.biquad(y, metering.k_weighting(rate)[1])
    assert -0.691 + 10 * math.log10(np.mean(y[rate:] ** 2)) == pytest.approx(20 * math.log10(0.5) - 3.01, abs=0.1)
    assert metering.true_peak(x) == pytest.approx(0.5, rel=5e-3)
    half = np.tile([1, 1, -1, -1], 200) * 0.5 ** 0.5  # a tone between the samples
    assert metering.true_peak(half[100:700] * 1.0) > 0.9
    wins = spark.createDataFrame([(1, 10.0), (1, 8.0), (1, 0.5), (1, 1e-9)], "id int, energy double")
    assert metering.gated(wins, ["id"], 1e-3, 0.1).head()["energy"] == pytest.approx(9.0)
    assert metering.integrated_loudness(wins.withColumn("energy", F.lit(0.0)), ["id"]).count() == 0
    got = one(spark, z=levels.meter_scale(F.lit(0.0)), h=levels.meter_scale(F.lit(1.0)), m=levels.meter_scale(F.lit(10 ** -1.5)), q=levels.quantised(F.lit(-2.0), 16), b=levels.hundredths(F.lit(-23.005)), n=levels.hundredths(F.lit(None).cast("double")))
    assert (got["z"], got["h"], got["q"], got["n"]) == (0.0, 1.0, -32767, 0x7FFF) and got["m"] == pytest.approx(0.5) and got["b"] in (-2301, -2300)
    g = one(spark, g=levels.stage_gain(F.lit(-20.0), F.lit(-23.0), F.lit(1.0), F.lit(-1.0), F.lit(False), F.lit(True), F.lit(0.0)), u=levels.stage_gain(F.lit(-23.05), F.lit(-23.0), F.lit(-9.0), F.lit(-1.0), F.lit(True), F.lit(True), F.lit(1.0)))
    assert g["g"] == pytest.approx(-3) and g["u"] == pytest.approx(9)


def test_overlap_add_does_not_depend_on_the_blocks(spark):
    r = np.random.default_rng(0)
    x, kernel = r.normal(size=300), r.normal(size=20).tolist()
    want = np.convolve(x, kernel)[:300]
    for cuts in ([300], [100, 200, 300], [5, 9, 40, 41, 300]):
        rows = [("a", k, x[lo:hi].tolist()) for k, (lo, hi) in enumerate(zip([0, *cuts], cuts))]
        out = metering.overlap_add(spark.createDataFrame(rows, "ch string, n int, s array<double>"), ["ch"], "n", "s", kernel)
        got = np.concatenate([r["s"] for r in out.orderBy("n").collect()])
        assert got == pytest.approx(want, abs=1e-9)


def test_prefixes(spark):
    names = ["RC_kick", "RC_snare", "RC_hat", "other", "RC_x_y"]
    df = spark.createDataFrame([(1, n) for n in names] + [(2, "M+030"), (2, "M-030"), (3, "Mix/a-1"), (3, "Mix/a-2"), (4, "solo_1")], "g int, n string")
    assert {r["g"]: r["prefix"] for r in prefixes.common_prefix(df, ["g"], "n").collect()} == {1: "", 2: "", 3: "Mix/a-", 4: ""}
    assert {r["g"]: r["prefix"] for r in prefixes.dominant_prefix(df, ["g"], "n", least=3).collect()} == {1: "RC_", 3: "Mix/a-"}
