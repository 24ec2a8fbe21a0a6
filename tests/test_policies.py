"""Rules on scene tables: the worked case, positions, and a template that changes nothing."""

import json

import pytest
from pyspark.sql import functions as F

from auralake.operators import policies
from auralake.sources import policy

BLOCK = (
    "object_id string, name string, diffuse double, width double, height double, depth double, divergence double, divergence_range double, channel_lock boolean,"
    " lock_distance double, jump boolean, interp_length long, sample_rate int, cartesian boolean, azimuth double, elevation double, distance double, x double, y double, z double"
)


def rules(spark, *objects, **whole):
    return policy.rules_table(spark, json.dumps({"schema": f"x.{policy.SCHEMA}", "objects": list(objects), **whole}))


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [
        ("AO_1001", "Kick Stem", 1.0, 0.4, 0.2, 0.1, 0.5, 90.0, True, 0.5, True, 9600, 48000, False, 30.0, 0.0, 1.0, None, None, None),
        ("AO_1002", "Cymbal Stem", 0.5, 0.5, 0.5, 0.5, 0.0, 45.0, False, None, False, None, 48000, True, None, None, None, 0.0, 1.0, 0.0),
    ]
    return spark.createDataFrame(rows, BLOCK)


def applied(spark, blocks, table):
    objects = blocks.select("object_id", "name").withColumns({
        "uids": F.array().cast("array<string>"), "contents": F.array().cast("array<string>"), "programmes": F.array().cast("array<string>"),
        "importance": F.lit(None).cast("int"), "dialogue_id": F.lit(None).cast("int"),
    })
    settings = policies.effective(objects, table, ["object_id"])
    return [r.asDict() for r in policies.on_blocks(blocks, settings, ["object_id"]).orderBy("object_id").collect()]


def test_worked_case(spark, blocks):
    table = rules(
        spark,
        {"name": "kick stem", "diffuse": {"enabled": False}, "extent": {"enabled": False}, "channel_lock": {"enabled": False},
         "divergence": {"scale": 0.5, "max_range": 30}, "interpolation": {"honor_jump_position": False, "max_ms": 50}},
        {"name_glob": "cymbal*", "diffuse": {"max": 0.25}, "extent": {"scale": 0.5, "height_scale": 0.25, "max": 0.2}},
    )
    kick, cymbal = applied(spark, blocks, table)
    assert [kick[c] for c in ("diffuse", "width", "height", "depth", "divergence", "divergence_range")] == [0, 0, 0, 0, 0.25, 30]
    assert (kick["channel_lock"], kick["lock_distance"], kick["jump"], kick["interp_length"]) == (False, None, False, 2400)
    assert [cymbal[c] for c in ("diffuse", "width", "height", "depth")] == [0.25, 0.2, 0.0625, 0.2] and cymbal["cartesian"]


@pytest.mark.parametrize("setting,kick", [
    ({"azimuth": 30, "offset": {"azimuth": 10}}, (40, 0, 1)), ({"azimuth": 30, "lock_azimuth": 90}, (90, 0, 1)),
    ({"azimuth": 200, "elevation": 200}, (-160, 90, 1)), ({"offset": {"azimuth": 0, "distance": 0}}, (30, 0, 1)),
    ({"offset": {"distance": -5}}, (30, 0, 0)),
])
def test_positions(spark, blocks, setting, kick):
    a, b = applied(spark, blocks, rules(spark, {"all": True, "position": setting}))
    assert (a["azimuth"], a["elevation"], a["distance"]) == kick
    assert b["cartesian"] == ("offset" in setting and not any(setting["offset"].values()))


def test_cartesian_front_becomes_polar(spark, blocks):
    _, b = applied(spark, blocks, rules(spark, {"all": True, "position": {"offset": {"azimuth": 10}}}))
    assert (b["azimuth"], b["elevation"], b["distance"], b["cartesian"]) == (pytest.approx(10), 0, 1, False)


def test_the_template_changes_nothing(spark, blocks):
    table = policy.rules_table(spark, json.dumps(policy.template()))
    assert applied(spark, blocks, table) == [r.asDict() for r in blocks.orderBy("object_id").collect()]


def test_lock_off_clears_its_distance(spark):
    rows = [(True, 0.5, False, 0.1), (False, None, True, 0.2), (True, 0.5, None, None), (False, None, None, 0.3)]
    df = spark.createDataFrame(rows, "l boolean, d double, e boolean, m double")
    got = df.select(policies.locked(F.col("l"), F.col("d"), F.col("e"), F.col("m")).alias("x")).collect()
    assert [tuple(r["x"]) for r in got] == [(False, None), (True, 0.2), (True, 0.5), (False, None)]


def test_speaker_rules_are_not_merged(spark):
    objects = spark.createDataFrame([("O", "Bed")], "object_id string, name string").withColumns({
        "uids": F.array().cast("array<string>"), "contents": F.array().cast("array<string>"), "programmes": F.array().cast("array<string>"),
        "importance": F.lit(3), "dialogue_id": F.lit(1),
    })
    own = [
        {"all": True, "direct_speakers": {"speaker_label": "M+000", "gain": {"scale": 0.5}}},
        {"id": "o", "direct_speakers": {"lfe": True, "gain": {"mute": True}}}, {"name": "bed", "gain": {"scale": 3}},
    ]
    table = policies.speaker_policies(objects, rules(spark, *own), ["object_id"])
    blocks = [("O", ["M+000"], None), ("O", ["LFE1"], 120.0), ("O", ["m+000"], 120.0), ("P", ["M+000"], None)]
    df = spark.createDataFrame(blocks, "object_id string, speaker_labels array<string>, low_pass_hz double").withColumns(
        {"gain": F.lit(1.0), "azimuth": F.lit(0.0), "elevation": F.lit(0.0), "distance": F.lit(1.0), "has_position": F.lit(False)}
    )
    got = policies.on_speaker_blocks(df, table, ["object_id"]).select("object_id", "speaker_labels", "low_pass_hz", "gain").collect()
    assert {(r[0], r[1][0], r[2]): r[3] for r in got} == {("O", "M+000", None): 0.5, ("O", "LFE1", 120.0): 0.0, ("O", "m+000", 120.0): 0.0, ("P", "M+000", None): 1.0}
