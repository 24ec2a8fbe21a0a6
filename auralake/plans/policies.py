"""A rule document put to work: on objects, their blocks, speaker blocks and ambisonic packs.

Customers stand for objects, orders for their blocks, parts for speaker blocks,
suppliers for packs.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import policies
from ..sources import policy
from .base import query, table
from .scenes import wrap_sql

DOC = {
    "schema": f"auralake.{policy.SCHEMA}",
    "global": {"gain": {"gain_db": -1.0}, "diffuse": {"scale": 0.5}},
    "objects": [
        {"name_glob": "b?ilding*", "gain": {"scale": 0.5}, "extent": {"scale": 0.5, "width_scale": 0.5, "max": 0.2}},
        {"importance_min": 8, "gain": {"gain_db": -6.0}, "position": {"offset": {"azimuth": 200.0}}},
        {"id": "customer#000000007", "gain": {"mute": True}},
        {"track_uid": "atu_11", "gain": {"scale": 2.0}, "divergence": {"scale": 0.5, "range_scale": 2.0}},
        {"content": "nation_3", "channel_lock": {"enabled": False}, "interpolation": {"honor_jump_position": False, "max_ms": 50}},
        {"programme": "REGION_2", "channel_lock": {"max_distance": 0.25}},
        {"dialogue_id": 2, "importance_max": 1, "gain": {"mute": False}, "position": {"azimuth": 30.0, "lock_elevation": 10.0}},
        {"pack_format": "pack_4", "gain": {"scale": 0.1}},
        {"all": True, "direct_speakers": {"speaker_label": "m+030", "gain": {"gain_db": -6.0}}},
        {"importance_max": 4, "direct_speakers": {"lfe": True, "gain": {"mute": True}, "position": {"elevation": -30.0}}},
    ],
}


def _rules(spark):
    return policy.rules_table(spark, json.dumps(DOC))


def _objects(spark, sf_dir):
    one = lambda c: F.array(F.expr(c))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("object_id"), F.col("c_mktsegment").alias("name"), one("'ATU_' || c_custkey % 50").alias("uids"),
        one("'Nation_' || c_nationkey").alias("contents"), one("'region_' || c_nationkey % 5").alias("programmes"),
        F.expr("if(c_custkey % 7 = 0, null, cast(c_custkey % 11 AS INT))").alias("importance"), F.expr("cast(c_custkey % 3 AS INT)").alias("dialogue_id"),
        (F.col("c_custkey") % 20 / 10.0).alias("gain"), (F.col("c_custkey") % 13 == 0).alias("mute"),
    )


#: the objects, and which of them each rule meets
HIT = """o AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 11 END AS importance,
  (c_custkey % 20) / 10.0 AS gain, c_custkey % 13 = 0 AS mute FROM customer),
hit AS (SELECT c_custkey, -1 AS ord FROM o UNION ALL SELECT c_custkey, 0 FROM o WHERE regexp_matches(lower(c_mktsegment), '^b.ilding.*$')
  UNION ALL SELECT c_custkey, 1 FROM o WHERE importance >= 8 UNION ALL SELECT c_custkey, 2 FROM o WHERE lower(c_name) = 'customer#000000007'
  UNION ALL SELECT c_custkey, 3 FROM o WHERE c_custkey % 50 = 11 UNION ALL SELECT c_custkey, 4 FROM o WHERE c_nationkey = 3
  UNION ALL SELECT c_custkey, 5 FROM o WHERE c_nationkey % 5 = 2 UNION ALL SELECT c_custkey, 6 FROM o WHERE c_custkey % 3 = 2 OR importance <= 1
  UNION ALL SELECT c_custkey, 8 FROM o UNION ALL SELECT c_custkey, 9 FROM o WHERE importance <= 4),
v(ord, scale, db, muted) AS (VALUES (-1, NULL, -1.0, NULL), (0, 0.5, NULL, NULL), (1, NULL, -6.0, NULL), (2, NULL, NULL, true), (3, 2.0, NULL, NULL),
  (6, NULL, NULL, false), (7, 0.1, NULL, NULL)),
g AS (SELECT c_custkey, max_by(scale, ord) FILTER (scale IS NOT NULL) AS scale, max_by(db, ord) FILTER (db IS NOT NULL) AS db,
  max_by(muted, ord) FILTER (muted IS NOT NULL) AS muted FROM hit JOIN v USING (ord) GROUP BY c_custkey),
applied AS (SELECT o.*, CAST(gain AS DOUBLE) * coalesce(CAST(scale AS DOUBLE), 1) * pow(10.0, coalesce(CAST(db AS DOUBLE), 0.0) / 20) AS new_gain,
  coalesce(muted, mute) AS new_mute FROM o JOIN g USING (c_custkey)),
flags AS (SELECT c_custkey, bool_or(ord = 0) AS h0, bool_or(ord = 1) AS h1, bool_or(ord = 3) AS h3, bool_or(ord = 4) AS h4, bool_or(ord = 5) AS h5,
  bool_or(ord = 6) AS h6, bool_or(ord = 9) AS h9 FROM hit GROUP BY c_custkey)"""


@query(f"WITH {HIT} SELECT c_custkey, round(new_gain, 6) AS gain, new_mute AS mute FROM applied")
def policy_apply(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    out = policies.on_objects(objects, policies.effective(objects, _rules(spark), ["c_custkey"]), ["c_custkey"])
    return out.select("c_custkey", F.round("gain", 6).alias("gain"), "mute")


_BLOCKS = {
    "diffuse": "o_orderkey % 11 / 10.0", "width": "o_orderkey % 7 / 10.0", "height": "o_orderkey % 3 / 10.0", "divergence": "o_orderkey % 5 / 5.0",
    "divergence_range": "o_orderkey % 90 * 1.0", "az": "o_orderkey % 360 - 179.5", "el": "o_orderkey % 180 - 89.5",
}


@query(f"""WITH {HIT}, b AS (SELECT o_orderkey, o_custkey AS c_custkey, {", ".join(f"{v} AS {k}" for k, v in _BLOCKS.items())}, o_orderkey % 4 = 0 AS cart,
  o_orderkey % 2 = 0 AS lock, o_orderkey % 3 = 0 AS jump, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 5000 END AS len FROM orders),
p AS (SELECT b.*, h0, h1, h3, h4, h5, h6, CASE WHEN cart THEN degrees(atan2(-(el / 90), az / 180)) ELSE az END AS az0,
  CASE WHEN cart THEN degrees(atan2(0.5, sqrt(pow(el / 90, 2) + pow(az / 180, 2)))) ELSE el END AS el0 FROM b JOIN flags USING (c_custkey))
SELECT o_orderkey, round(diffuse * 0.5, 6) AS diffuse, round(CASE WHEN h0 THEN least(width * 0.25, 0.2) ELSE width END, 6) AS width,
  round(CASE WHEN h0 THEN least(height * 0.5, 0.2) ELSE height END, 6) AS height, round(CASE WHEN h3 THEN divergence * 0.5 ELSE divergence END, 6) AS divergence,
  round(CASE WHEN h3 THEN least(divergence_range * 2, 120) ELSE divergence_range END, 6) AS divergence_range, lock AND NOT h4 AS channel_lock,
  CASE WHEN h4 THEN NULL WHEN h5 AND lock THEN 0.25 WHEN lock THEN 0.5 END AS lock_distance, jump AND NOT h4 AS jump,
  CASE WHEN h4 AND len > 2400 THEN 2400 ELSE len END AS interp_length, cart AND NOT (h1 OR h6) AS cartesian,
  round(CASE WHEN h1 OR h6 THEN {wrap_sql("CASE WHEN h6 THEN 30 ELSE az0 END + CASE WHEN h1 THEN 200 ELSE 0 END")} WHEN NOT cart THEN az END, 4) AS azimuth,
  round(CASE WHEN h6 THEN 10 WHEN h1 THEN el0 WHEN NOT cart THEN el END, 4) AS elevation FROM p""")
def policy_blocks(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    made = {k: F.expr(v).cast("double") for k, v in _BLOCKS.items()}
    cart = F.col("o_orderkey") % 4 == 0
    blocks = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), *(v.alias(k) for k, v in made.items()), F.lit(0.0).alias("depth"), cart.alias("cartesian"),
        (F.col("o_orderkey") % 2 == 0).alias("channel_lock"), F.expr("if(o_orderkey % 2 = 0, 0.5D, null)").alias("lock_distance"), F.lit(48000).alias("sample_rate"),
        (F.col("o_orderkey") % 3 == 0).alias("jump"), F.expr("if(o_orderkey % 6 <> 0, o_orderkey % 5000, null)").alias("interp_length"),
    ).join(objects.select("c_custkey"), "c_custkey", "left_semi")
    polar = {"azimuth": F.when(~F.col("cartesian"), F.col("az")), "elevation": F.when(~F.col("cartesian"), F.col("el")), "distance": F.when(~F.col("cartesian"), F.lit(1.0))}
    blocks = blocks.withColumns(polar | {"x": F.col("el") / 90, "y": F.col("az") / 180, "z": F.lit(0.5)})
    out = policies.on_blocks(blocks, policies.effective(objects, _rules(spark), ["c_custkey"]), ["c_custkey"])
    sixth = [F.round(c, 6).alias(c) for c in ("diffuse", "width", "height", "divergence", "divergence_range")]
    rest = ["channel_lock", "lock_distance", "jump", "interp_length", "cartesian"]
    return out.select("o_orderkey", *sixth, *rest, F.round("azimuth", 4).alias("azimuth"), F.round("elevation", 4).alias("elevation"))


@query(f"""WITH {HIT}, b AS (SELECT p_partkey, p_partkey % (SELECT max(c_custkey) FROM customer) + 1 AS c_custkey, p_partkey % 3 AS kind, 1 + p_size / 50.0 AS gain FROM part)
SELECT p_partkey, round(CASE WHEN kind = 2 AND h9 THEN 0 WHEN kind = 0 THEN gain * pow(10.0, -6.0 / 20) ELSE gain END, 6) AS gain,
  CAST(CASE WHEN kind = 2 AND h9 THEN -30 ELSE 0 END AS DOUBLE) AS elevation, kind = 2 AND h9 AS has_position FROM b JOIN flags USING (c_custkey)""")
def direct_speaker_policy(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    most = objects.agg(F.max("c_custkey").alias("most"))
    label = F.expr("element_at(array('M+030', 'M-030', 'LFE1'), cast(p_partkey % 3 AS INT) + 1)")
    blocks = table(spark, sf_dir, "part").join(F.broadcast(most)).select(
        "p_partkey", (F.col("p_partkey") % F.col("most") + 1).alias("c_custkey"), F.array(label).alias("speaker_labels"),
        F.expr("if(p_partkey % 3 = 2, 120.0D, null)").alias("low_pass_hz"), (1 + F.col("p_size") / 50.0).alias("gain"),
        *(F.lit(v).alias(c) for c, v in (("azimuth", 30.0), ("elevation", 0.0), ("distance", 1.0))), F.lit(False).alias("has_position"),
    ).join(objects.select("c_custkey"), "c_custkey", "left_semi")
    out = policies.on_speaker_blocks(blocks, policies.speaker_policies(objects, _rules(spark), ["c_custkey"]), ["c_custkey"])
    return out.select("p_partkey", F.round("gain", 6).alias("gain"), "elevation", "has_position")


@query("""SELECT s_suppkey, round((s_suppkey % 10) / 10.0 * CASE WHEN s_suppkey % 7 = 4 THEN 0.1 ELSE 1 END * pow(10.0, -1.0 / 20), 6) AS gain,
  s_suppkey % 10 = 7 OR s_suppkey % 4 = 0 AS mute FROM supplier""")
def hoa_policy(spark, sf_dir):
    packs = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.expr("'CUSTOMER#00000000' || s_suppkey % 10").alias("object_id"), F.expr("'Pack_' || s_suppkey % 7").alias("pack_format"),
        (F.col("s_suppkey") % 10 / 10.0).alias("gain"), (F.col("s_suppkey") % 4 == 0).alias("mute"),
    )
    return policies.on_packs(packs, _rules(spark), ["s_suppkey"]).select("s_suppkey", F.round("gain", 6).alias("gain"), "mute")


@query(f"""WITH {HIT}, names AS (SELECT c_custkey, string_agg(CASE WHEN ord < 0 THEN 'global' ELSE 'objects[' || ord || ']' END, ',' ORDER BY ord) AS rules FROM hit GROUP BY c_custkey)
SELECT c_custkey, rules, concat_ws(',', CASE WHEN gain <> 0 THEN 'gain' END, CASE WHEN mute <> new_mute THEN 'mute' END) AS fields FROM applied JOIN names USING (c_custkey)""")
def policy_report(spark, sf_dir):
    objects, rules, keys = _objects(spark, sf_dir), _rules(spark), ["c_custkey"]
    after = policies.on_objects(objects, policies.effective(objects, rules, keys), keys)
    met = policies.matched(objects, rules, policies.object_rule(), keys, [])
    out = policies.report(objects, after, keys, ["gain", "mute"], met)
    return out.select("c_custkey", F.array_join("rules", ",").alias("rules"), F.array_join(F.transform("changes", lambda d: d["field"]), ",").alias("fields"))
