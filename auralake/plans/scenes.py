"""Rule, lookup, geometry and mixing queries over the business tables.

The tables are not scenes; the queries run the library's operators on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, harmonics, labels, levels
from ..operators import lookups, mixing, prefixes, rules
from ..sources import registry
from .base import parts_of, query, table

RULES = """(0, '*1?', NULL, NULL, 0.5, 1.0), (1, NULL, 'BUILDING', NULL, 0.8, NULL), (2, 'customer#*77', NULL, NULL, NULL, -6.0),
(3, NULL, NULL, 5000, 1.25, NULL), (4, '', NULL, NULL, 9.0, 9.0), (5, 'nobody*', NULL, NULL, 2.0, NULL), (6, NULL, 'HOUSEHOLD', 9000, NULL, 3.0)"""


def _rules(spark):
    kinds = "rule_ord, name_glob, segment, importance_min, scale, gain_db"
    return spark.sql(f"SELECT * FROM VALUES {RULES} AS t({kinds})").select(
        "rule_ord", "name_glob", "segment", F.col("importance_min").cast("double").alias("importance_min"),
        F.col("scale").cast("double").alias("scale"), F.col("gain_db").cast("double").alias("gain_db"),
    )


def _hits():
    return rules.any_of(
        rules.glob_matches(F.col("c_name"), F.col("name_glob")),
        labels.same_name(F.col("c_mktsegment"), F.col("segment")),
        rules.between_open(F.col("c_acctbal"), F.col("importance_min"), F.lit(None).cast("double")),
    )


_GLOB = """('^' || replace(replace(regexp_replace(lower(name_glob), '([\\\\.\\[\\]{}()+^$|])', '\\\\\\1', 'g'), '*', '.*'), '?', '.') || '$')"""
RULE_SQL = f"""rules(rule_ord, name_glob, segment, importance_min, scale, gain_db) AS (VALUES {RULES}),
hit AS (SELECT c_custkey, rule_ord, scale, gain_db FROM customer, rules WHERE (name_glob <> '' AND regexp_matches(lower(c_name), {_GLOB}))
  OR lower(c_mktsegment) = lower(segment) OR c_acctbal >= importance_min)"""


@query(f"WITH {RULE_SQL} SELECT c_custkey, rule_ord FROM hit")
def glob_match(spark, sf_dir):
    out = rules.matched(table(spark, sf_dir, "customer"), _rules(spark), _hits())
    return out.select("c_custkey", "rule_ord")


@query(f"""WITH {RULE_SQL}, f AS (SELECT c_custkey, max_by(scale, rule_ord) FILTER (scale IS NOT NULL) AS scale,
  max_by(gain_db, rule_ord) FILTER (gain_db IS NOT NULL) AS gain_db FROM hit GROUP BY c_custkey)
SELECT c_custkey, CAST(scale AS DOUBLE) AS scale, CAST(gain_db AS DOUBLE) AS gain_db,
  round(coalesce(scale, 1.0) * pow(10.0, coalesce(gain_db, 0.0) / 20), 6) AS gain FROM f""")
def rule_fold(spark, sf_dir):
    hit = rules.matched(table(spark, sf_dir, "customer"), _rules(spark), _hits())
    out = rules.folded(hit, ["c_custkey"], ["scale", "gain_db"])
    gain = rules.scaled_gain(F.lit(1.0), F.col("scale"), F.col("gain_db"), F.lit(False))
    return out.withColumn("gain", F.round(gain, 6))


@query(f"WITH {RULE_SQL} SELECT rule_ord FROM rules WHERE rule_ord NOT IN (SELECT rule_ord FROM hit)")
def unmatched_rules(spark, sf_dir):
    return rules.unmatched(_rules(spark), table(spark, sf_dir, "customer"), _hits()).select("rule_ord")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0.0
  ELSE round(least(greatest(l_quantity * (1 - l_discount), 0.0), CASE WHEN l_linestatus = 'O' THEN 20.0 ELSE 1e18 END), 4) END AS gain FROM lineitem""")
def gain_apply(spark, sf_dir):
    most = F.when(F.col("l_linestatus") == "O", F.lit(20.0))
    gain = rules.limited(F.col("l_quantity"), F.col("l_returnflag") != "R", 1 - F.col("l_discount"), most)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(gain, 4).alias("gain"))


@query("""WITH r AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, round(sum(q * pow(0.5, n - k)), 6) AS gain FROM r GROUP BY l_orderkey""")
def ordered_fold(spark, sf_dir):
    """Steps applied in order: each halves the gain so far and adds its quantity."""
    steps = F.collect_list(F.struct(F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey", "l_quantity"))
    out = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(steps.alias("steps"))
    gain = rules.applied_in_order(F.lit(0.0), F.col("steps"), lambda g, s: g * 0.5 + s["l_quantity"])
    return out.select("l_orderkey", F.round(gain, 6).alias("gain"))


@query("""SELECT r_name, count(DISTINCT n_nationkey) AS contents, count(c_custkey) AS objects FROM region
  LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def membership_two_hop(spark, sf_dir):
    """Objects below each programme; customers are counted by nation before they meet a region."""
    objects = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    up = lookups.chained(
        table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"),
        [(table(spark, sf_dir, "nation"), "n_regionkey"), (objects, "n_nationkey")],
    )
    return up.groupBy("r_name").agg(F.count("n_nationkey").alias("contents"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS parent, o_custkey * 2 + o_orderkey % 3 AS child, min(o_orderkey % 97 + 1) AS off
  FROM orders WHERE o_custkey > 0 GROUP BY ALL),
reach(node, start) AS (SELECT c_custkey, c_custkey * 10 FROM customer WHERE c_custkey NOT IN (SELECT child FROM e)
  UNION SELECT child, start + off FROM reach JOIN e ON node = parent), best AS (SELECT node, min(start) AS start FROM reach GROUP BY node)
SELECT c_custkey, coalesce(start, c_custkey * 10) AS start, start IS NOT NULL AS reached FROM customer LEFT JOIN best ON node = c_custkey""")
def min_start_propagation(spark, sf_dir):
    """Customers as objects that orders nest in each other; those that no other one holds are at the top."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey"), (F.col("c_custkey") * 10).alias("own"))
    edges = table(spark, sf_dir, "orders").filter("o_custkey > 0").select(
        F.col("o_custkey").alias("parent"), (F.col("o_custkey") * 2 + F.col("o_orderkey") % 3).alias("child"), (F.col("o_orderkey") % 97 + 1).alias("offset")
    ).groupBy("parent", "child").agg(F.min("offset").alias("offset"))
    top = customer.join(edges.select(F.col("child").alias("c_custkey")), "c_custkey", "left_anti")
    best = lookups.least_start(edges, top.select(F.col("c_custkey").alias("node"), F.col("own").alias("start")))
    out = customer.join(best.withColumnRenamed("node", "c_custkey"), "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("start", "own").alias("start"), F.col("start").isNotNull().alias("reached"))


@query("""WITH chain AS (SELECT o_orderkey, 'customer' AS via, n_name FROM orders JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'
  JOIN nation ON n_nationkey = c_nationkey), alt AS (SELECT DISTINCT l_orderkey, 'supplier' AS via, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey) SELECT * FROM chain UNION ALL SELECT * FROM alt WHERE l_orderkey NOT IN (SELECT o_orderkey FROM chain)""")
def fallback_chain(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    parts = parts_of(lines)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    chain = (
        table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.lit("customer").alias("via"), "n_name").repartition(parts, "o_orderkey")
    )
    alt = (
        lines.repartition(parts, "o_orderkey").join(chain, "o_orderkey", "left_anti").join(table(spark, sf_dir, "supplier"), "s_suppkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", F.lit("supplier").alias("via"), "n_name").distinct()
    )
    return lookups.with_fallback(chain, ["o_orderkey"], alt)


@query("""WITH seg AS (SELECT DISTINCT c_mktsegment FROM customer), own AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
SELECT n_name, r_name, s.c_mktsegment AS segment, CASE WHEN n_regionkey <> r_regionkey THEN 'region' WHEN n IS NULL THEN 'segment' END AS reason
FROM nation, region, seg s LEFT JOIN own ON own.c_nationkey = n_nationkey AND own.c_mktsegment = s.c_mktsegment""")
def support_matrix(spark, sf_dir):
    """Every nation, region and segment with the first reason why they do not go together."""
    customer = table(spark, sf_dir, "customer")
    own = customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    every = table(spark, sf_dir, "nation").crossJoin(F.broadcast(table(spark, sf_dir, "region")))
    every = every.crossJoin(F.broadcast(customer.select(F.col("c_mktsegment").alias("segment")).distinct()))
    reason = F.when(F.col("n_regionkey") != F.col("r_regionkey"), "region").when(F.col("n").isNull(), "segment")
    return every.join(own, ["n_nationkey", "segment"], "left").select("n_name", "r_name", "segment", reason.alias("reason"))


@query("""SELECT * FROM (VALUES ('0+2+0', 2, 0, false), ('0+5+0', 6, 1, false), ('2+5+0', 8, 1, true), ('4+5+0', 10, 1, true), ('wav71', 8, 1, false),
  ('4+7+0', 12, 1, true), ('4+5+4', 14, 1, true), ('9.1.6', 16, 1, true), ('9+10+3', 24, 2, true)) t(layout_id, channels, lfe, is_3d)""")
def speaker_layouts(spark, sf_dir):
    return registry.layout_summary(registry.Registry().speakers(spark)).withColumns({"channels": F.col("channels").cast("int"), "lfe": F.col("lfe").cast("int")})


_RENDERERS = {"panner": ["0+5+0", "2+5+0", "wav71", "4+5+0", "4+7+0", "4+5+4", "9.1.6", "9+10+3"], "ambisonic": ["hoa3"], "binaural": ["binaural"]}
_FORMATS = {"wav": (True, 0, True), "caf": (True, 0, True), "flac": (True, 8, False), "opus_mka": (True, 255, True),
            "apac": (False, 0, True), "iamf": (False, 0, True), "iamf_mp4": (False, 0, True)}
_values = lambda rows: ", ".join(f"({', '.join(map(repr, r))})" for r in rows)


@query(f"""WITH own(renderer, layout_id) AS (VALUES {_values((r, i) for r, ids in _RENDERERS.items() for i in ids)}),
kinds(format, available, most, height) AS (VALUES {_values((f, *v) for f, v in _FORMATS.items())}),
rows(ord, format, layout, channels) AS (VALUES {_values((k, *r) for k, r in enumerate(registry.OUTPUT_LAYOUTS))}),
names(name, layout_id) AS (VALUES {_values((n, i) for i, names in registry.LAYOUT_NAMES.items() for n in names)}),
targets(target, format, container, encoding, layouts_of) AS (VALUES {_values(registry.TARGETS)}),
l AS (SELECT layout, arg_min(coalesce(layout_id, layout), ord) AS layout_id, arg_min(channels, ord) AS channels,
  regexp_matches(layout, '^[0-9]+\\.[0-9]+\\.[0-9]+$|^22\\.2$|^hoa') AS is_3d FROM rows LEFT JOIN names ON name = lower(layout) GROUP BY layout),
e AS (SELECT r.renderer, l.*, t.target, t.format, CASE WHEN own.layout_id IS NULL THEN 'renderer' WHEN NOT available THEN 'format'
  WHEN layouts_of <> '-' AND d.layout IS NULL THEN 'target' WHEN most > 0 AND l.channels > most THEN 'channels' WHEN NOT height AND is_3d THEN 'height' END AS reason
  FROM (SELECT DISTINCT renderer FROM own) r CROSS JOIN l CROSS JOIN targets t JOIN kinds USING (format)
  LEFT JOIN own ON own.renderer = r.renderer AND own.layout_id = l.layout_id LEFT JOIN rows d ON d.format = layouts_of AND d.layout = l.layout)
SELECT renderer, layout, layout_id, channels, is_3d, target, format, reason IS NULL AS supported, reason FROM e""")
def output_support(spark, sf_dir):
    """Renderers, layouts and targets of the registry."""
    return registry.support_matrix(spark, _RENDERERS, _FORMATS)


@query(f"""WITH own(k, renderer, layout_id) AS (VALUES {_values((k, r, i) for k, (r, ids) in enumerate(_RENDERERS.items()) for i in ids)}),
rows(ord, format, layout, channels) AS (VALUES {_values((k, *r) for k, r in enumerate(registry.OUTPUT_LAYOUTS))}),
names(name, layout_id) AS (VALUES {_values((n, i) for i, names in registry.LAYOUT_NAMES.items() for n in names)}),
l AS (SELECT rows.*, coalesce(layout_id, layout) AS layout_id FROM rows LEFT JOIN names ON name = lower(layout)),
s AS (SELECT l.ord, format, layout, channels, coalesce(string_agg(renderer, ',' ORDER BY k), '') AS supported_by FROM l LEFT JOIN own USING (layout_id) GROUP BY ALL)
SELECT format, layout, channels, supported_by FROM s WHERE (format = 'wav' AND supported_by LIKE '%panner%') OR (format = 'apac' AND layout = 'hoa3') OR format = 'flac'""")
def layout_query(spark, sf_dir):
    """What can be asked of the registry: a format, a layout by any name, a renderer."""
    rows = registry.layout_rows(spark, _RENDERERS)
    found = registry.layouts_of(rows, "wav", renderer="panner").unionByName(registry.layouts_of(rows, "apac", "HOA3")).unionByName(registry.layouts_of(rows, "flac"))
    return found.select("format", "layout", "channels", F.array_join("supported_by", ",").alias("supported_by"))


_ALIAS = {"small": "M+030", "red": "M-030", "blue": "M+000", "large": "U+045", "ring": "U+045", "bolt": "LFE1"}


@query("WITH alias(word, speaker, ord) AS (VALUES " + ", ".join(f"('{w}', '{s}', {k})" for k, (w, s) in enumerate(_ALIAS.items())) + """),
w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part),
c AS (SELECT p_partkey, ord, pos, speaker FROM w JOIN alias USING (word)) SELECT p_partkey, arg_min(speaker, ord * 100 + pos) AS speaker FROM c GROUP BY p_partkey""")
def prioritised_lookup(spark, sf_dir):
    alias = spark.createDataFrame([(w, s, k) for k, (w, s) in enumerate(_ALIAS.items())], "word string, speaker string, ord int")
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    return lookups.first_hit(words.join(F.broadcast(alias), "word"), ["p_partkey"], ["ord", "pos"], ["speaker"])


def _directions(spark, sf_dir):
    """Customers as directions."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") * 7 % 360 - 179.5).alias("az"), (F.col("c_acctbal") % 90).alias("el"), F.col("c_acctbal").alias("bal")
    )


DIRECTIONS = "d AS (SELECT c_custkey, c_custkey * 7 % 360 - 179.5 AS az, c_acctbal % 90 AS el, c_acctbal AS bal FROM customer)"
SPEAKERS = "spk(k, label, saz, sel) AS (VALUES " + ", ".join(
    f"({k}, '{s[0]}', CAST({s[1]} AS DOUBLE), CAST({s[2]} AS DOUBLE))"
    for k, s in enumerate(registry.LAYOUTS[("4+5+0", "5.1.4")]) if not s[0].startswith("LFE")
) + ")"
_WRAP = "(180.0 - (({x}) - floor(({x}) / 360.0) * 360.0))"


def wrap_sql(x: str) -> str:
    return _WRAP.format(x=f"180.0 - ({x})")


def _speakers(spark):
    spk = registry.Registry().speakers(spark).filter("layout_id = '4+5+0' AND NOT is_lfe")
    return spk.select("spk_ord", "label", "azimuth", "elevation")


@query(f"""WITH {DIRECTIONS}, {SPEAKERS}, g AS (SELECT c_custkey, k, label, round(pow({wrap_sql('az - saz')}, 2) + pow(el - sel, 2), 6) AS gap FROM d, spk)
SELECT c_custkey, arg_min(label, struct_pack(gap := gap, k := k)) AS label FROM g GROUP BY c_custkey""")
def nearest_planar(spark, sf_dir):
    gap = lambda p: geometry.planar_gap(F.col("az"), F.col("el"), p["azimuth"], p["elevation"])
    return lookups.nearest(_directions(spark, sf_dir), _speakers(spark), gap, "label", "spk_ord", 6).select("c_custkey", "label")


def _xyz(a: str, e: str) -> list[str]:
    return [f"(-sin(radians({a})) * cos(radians({e})))", f"(cos(radians({a})) * cos(radians({e})))", f"sin(radians({e}))"]


_CHORD = "sqrt(" + " + ".join(f"pow({p} - {q}, 2)" for p, q in zip(_xyz("az", "el"), _xyz("saz", "sel"))) + ")"


@query(f"""WITH {DIRECTIONS}, {SPEAKERS}, g AS (SELECT c_custkey, k, label, round({_CHORD}, 6) AS gap FROM d, spk)
SELECT c_custkey, arg_min(label, struct_pack(gap := gap, k := k)) AS label, min(gap) AS gap FROM g GROUP BY c_custkey""")
def nearest_chord(spark, sf_dir):
    gap = lambda p: geometry.chord(geometry.unit_vector(F.col("az"), F.col("el")), geometry.unit_vector(p["azimuth"], p["elevation"]))
    return lookups.nearest(_directions(spark, sf_dir), _speakers(spark), gap, "label", "spk_ord", 6).select("c_custkey", "label", "gap")


@query("""WITH p AS (SELECT p_partkey, p_brand || '_' || CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'r' END AS name FROM part),
s AS (SELECT p_partkey, left(name, length(name) - 2) AS stem, upper(right(name, 1)) AS side FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY stem, side ORDER BY p_partkey) AS k FROM s)
SELECT a.stem, a.p_partkey AS left_ord, b.p_partkey AS right_ord FROM r a JOIN r b ON a.stem = b.stem AND a.k = b.k AND a.side = 'L' AND b.side = 'R'""")
def stem_pairs(spark, sf_dir):
    name = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "_L").otherwise("_r"))
    parts = table(spark, sf_dir, "part").select("p_partkey", labels.stem_and_side(name).alias("x")).select("p_partkey", "x.*")
    return lookups.kth_pairs(parts, "stem", "side", "p_partkey")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, (c_custkey * 37) % 361 - 180 AS az FROM customer),
b AS (SELECT c_nationkey, abs(az) AS mag, az > 0 AS is_left, c_custkey, row_number() OVER (PARTITION BY c_nationkey, abs(az), az > 0 ORDER BY c_custkey) AS k
  FROM c WHERE abs(az) > 1) SELECT x.c_nationkey, x.c_custkey AS left_ord, y.c_custkey AS right_ord FROM b x
JOIN b y ON x.c_nationkey = y.c_nationkey AND x.mag = y.mag AND x.k = y.k AND x.is_left AND NOT y.is_left""")
def mirror_pairs(spark, sf_dir):
    """Channels of one bed at opposite whole-degree azimuths, first with first."""
    az = F.col("c_custkey") * 37 % 361 - 180
    beds = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", az.alias("az")).filter(F.abs("az") > 1)
    beds = beds.select(F.struct("c_nationkey", F.abs("az").alias("mag")).alias("stem"), F.when(F.col("az") > 0, "L").otherwise("R").alias("side"), "c_custkey")
    return lookups.kth_pairs(beds, "stem", "side", "c_custkey").select("stem.c_nationkey", "left_ord", "right_ord")


@query("""SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey
  WHERE n_regionkey = r_regionkey AND c_mktsegment = 'MACHINERY' AND c_acctbal > 9000)""")
def codec_semi(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY' AND c_acctbal > 9000")
    nations = table(spark, sf_dir, "nation").join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    return table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left_semi").select("r_name")


_HOST = r"regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"""WITH u AS (SELECT {_HOST} AS host, url FROM pages WHERE url IS NOT NULL), p AS (SELECT host, url, unnest(range(1, length(url) + 1)) AS i FROM u),
q AS (SELECT host, left(url, CAST(i AS INT)) AS prefix, count(*) AS c FROM p WHERE substr(url, CAST(i AS INT), 1) IN ('_', '-', ' ', '/') GROUP BY ALL),
n AS (SELECT host, count(*) AS n FROM u GROUP BY host)
SELECT host, CASE WHEN max(n.n) >= 2 THEN coalesce(arg_max(prefix, length(prefix)) FILTER (c = n.n), '') ELSE '' END AS prefix FROM n LEFT JOIN q USING (host) GROUP BY host""")
def common_prefix(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return prefixes.common_prefix(pages, ["host"], "url")


@query("""WITH u AS (SELECT regexp_extract(url, '([a-z]+)[/?#]?[^/]*$', 1) AS k, url FROM pages WHERE url IS NOT NULL), p AS (SELECT k, url, unnest(range(1, length(url) + 1)) AS i FROM u),
q AS (SELECT k, left(url, CAST(i AS INT)) AS prefix, count(*) AS c FROM p WHERE substr(url, CAST(i AS INT), 1) IN ('_', '-', ' ', '/') AND i >= 4 GROUP BY ALL),
n AS (SELECT k, count(*) AS n FROM u GROUP BY k)
SELECT k, arg_max(prefix, struct_pack(l := length(prefix), p := prefix)) AS prefix FROM q JOIN n USING (k) WHERE c >= greatest(2, ceil(n * 0.4)) GROUP BY k""")
def dominant_prefix(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("url", F.regexp_extract("url", "([a-z]+)[/?#]?[^/]*$", 1).alias("k"))
    return prefixes.dominant_prefix(pages, ["k"], "url")


@query(f"SELECT c_custkey, round({wrap_sql('c_acctbal * 3')}, 4) AS az FROM customer")
def wrap_azimuth(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(geometry.wrap_azimuth(F.col("c_acctbal") * 3), 4).alias("az"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT vec_id, round(degrees(atan2(-x, y)), 4) AS azimuth, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS elevation, round(sqrt(x * x + y * y + z * z), 6) AS distance FROM p""")
def cart_polar(spark, sf_dir):
    x, y, z = (F.get("embedding", F.lit(k)).cast("double") for k in range(3))
    p = table(spark, sf_dir, "embeddings").select("vec_id", geometry.to_polar(x, y, z).alias("p"))
    return p.select("vec_id", F.round("p.azimuth", 4).alias("azimuth"), F.round("p.elevation", 4).alias("elevation"), F.round("p.distance", 6).alias("distance"))


_DIV = "CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE (c_custkey % 10) / 10.0 END"


@query(f"""WITH {DIRECTIONS}, v AS (SELECT *, {_DIV} AS dv, least(abs(bal) / 50, 120.0) AS a FROM d),
s AS (SELECT c_custkey, az, 0.0 AS turn, CASE WHEN dv > 1e-4 THEN (1 - dv) / (1 + dv) ELSE 1.0 END AS w FROM v
  UNION ALL SELECT c_custkey, az, t * a, dv / (1 + dv) FROM v, (VALUES (-1), (1)) x(t) WHERE dv > 1e-4)
SELECT c_custkey, round({wrap_sql('az + turn')}, 4) AS azimuth, round(w, 6) AS weight FROM s""")
def divergence_expand(spark, sf_dir):
    amount = F.when(F.col("c_custkey") % 4 == 0, 0.0).otherwise(F.col("c_custkey") % 10 / 10.0)
    out = _directions(spark, sf_dir).withColumn("s", F.explode(geometry.diverged(amount, F.abs("bal") / 50)))
    az = geometry.wrap_azimuth(F.col("az") + F.col("s.turn"))
    return out.select("c_custkey", F.round(az, 4).alias("azimuth"), F.round("s.weight", 6).alias("weight"))


_DISK = "disk(k, dx, dy, w) AS (VALUES " + ", ".join(f"({k}, {x!r}, {y!r}, {w!r})" for k, (x, y, w) in enumerate(geometry.extent_disk())) + ")"
_C = dict(zip("xyz", _xyz("az", "el")))


@query(f"""WITH {DIRECTIONS}, {_DISK}, r AS (SELECT c_custkey, {_C['x']} AS cx, {_C['y']} AS cy, {_C['z']} AS cz, (c_custkey % 5 + 1) / 10.0 AS wd, (c_custkey % 3 + 1) / 10.0 AS ht,
  least(greatest(1 / greatest(abs(bal) / 2000, 0.4), 0.5), 2.5) AS near FROM d),
q AS (SELECT *, sqrt(cx * cx + cy * cy) AS f FROM r),
b AS (SELECT c_custkey, k, w, cx, cy, cz, -cy / f AS hx, cx / f AS hy, tan(radians(dx * wd * 60 * near)) AS h, tan(radians(dy * ht * 45 * near)) AS v FROM q, disk),
o AS (SELECT c_custkey, k, w, cx + hx * h - cz * hy * v AS x, cy + hy * h + cz * hx * v AS y, cz + (cx * hy - cy * hx) * v AS z FROM b)
SELECT c_custkey, k, round(w, 6) AS weight, round(degrees(atan2(-x, y)), 3) AS azimuth, round(degrees(atan2(z, sqrt(x * x + y * y))), 3) AS elevation FROM o""")
def extent_cloud(spark, sf_dir):
    radii = geometry.extent_radii((F.col("c_custkey") % 5 + 1) / 10.0, (F.col("c_custkey") % 3 + 1) / 10.0, F.lit(0.0), F.abs("bal") / 2000)
    out = _directions(spark, sf_dir).withColumn("r", radii).withColumn("p", F.explode(geometry.extent_places(F.col("r"))))
    out = out.withColumn("d", geometry.extent_direction(F.col("az"), F.col("el"), F.col("r"), F.col("p.x"), F.col("p.y")))
    return out.select("c_custkey", "p.k", F.round("p.w", 6).alias("weight"), F.round("d.azimuth", 3).alias("azimuth"), F.round("d.elevation", 3).alias("elevation"))


@query(f"""WITH {DIRECTIONS}, a AS (SELECT c_custkey, cos(radians(az)) * cos(radians(el)) AS x, sin(radians(az)) * cos(radians(el)) AS y, sin(radians(el)) AS z FROM d),
s AS (SELECT c_custkey, [1.0, y, z, x, sqrt(3) * x * y, sqrt(3) * y * z, (3 * z * z - 1) / 2, sqrt(3) * x * z, sqrt(3) / 2 * (x * x - y * y)] AS g FROM a)
SELECT c_custkey, unnest(range(9)) AS acn, round(unnest(g), 6) AS gain FROM s""")
def sh_encode(spark, sf_dir):
    out = _directions(spark, sf_dir).select("c_custkey", F.posexplode(harmonics.harmonics(F.col("az"), F.col("el"), 2)).alias("acn", "gain"))
    return out.select("c_custkey", F.col("acn").cast("long").alias("acn"), F.round("gain", 6).alias("gain"))


_MATRIX = [(i, o, round(math.cos(i * 3 + o), 3) if (i + o) % 3 else 0.0) for i in range(5) for o in range(2)]


@query("WITH m(in_ch, out_ch, gain) AS (VALUES " + ", ".join(map(str, _MATRIX)) + """),
s AS (SELECT o_custkey, CAST(left(o_orderpriority, 1) AS INT) - 1 AS in_ch, o_totalprice AS v FROM orders)
SELECT o_custkey, out_ch, round(sum(v * gain), 5) AS mix FROM s JOIN m USING (in_ch) WHERE gain <> 0 GROUP BY ALL""")
def mixdown(spark, sf_dir):
    matrix = spark.createDataFrame(_MATRIX, "in_ch int, out_ch int, gain double")
    samples = table(spark, sf_dir, "orders").select("o_custkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("in_ch"), F.col("o_totalprice").alias("value"))
    return mixing.mixed(samples, matrix, ["o_custkey"]).withColumn("mix", F.round("mix", 5))


@query("SELECT vec_id, round(CAST(embedding[7] AS DOUBLE), 6) AS c4, round(CAST(embedding[5] AS DOUBLE), 6) AS c6 FROM embeddings")
def channel_permute(spark, sf_dir):
    out = table(spark, sf_dir, "embeddings").withColumn("p", mixing.permuted(F.col("embedding"), mixing.SWAP_REAR_SIDE))
    return out.select("vec_id", *(F.round(F.get("p", F.lit(k)).cast("double"), 6).alias(f"c{k}") for k in (4, 6)))


@query("""WITH e AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: x > 1e-7)[1:3] AS g FROM embeddings),
s AS (SELECT vec_id, g, list_sum(g) AS t FROM e) SELECT vec_id, unnest(range(len(g))) AS k, round(unnest(g) / t, 6) AS gain FROM s""")
def top3_renorm(spark, sf_dir):
    gains = mixing.strongest_three(F.transform("embedding", lambda x: x.cast("double")))
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(gains).alias("k", "gain"))
    return out.select("vec_id", F.col("k").cast("long").alias("k"), F.round("gain", 6).alias("gain"))


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, 10 * log10(avg(l_quantity * l_quantity)) - 50 AS lufs, 20 * log10(max(l_quantity)) - 40 AS peak FROM lineitem GROUP BY ALL),
a AS (SELECT *, CASE WHEN abs(-23 - lufs) >= 0.1 THEN -23 - lufs ELSE 0 END AS g FROM m),
b AS (SELECT *, CASE WHEN l_linestatus = 'F' AND -1 - (peak + g) > 0.1 THEN -1 - (peak + g) ELSE 0 END AS up FROM a),
c AS (SELECT *, CASE WHEN -1 - (peak + g + up) < -0.1 THEN -1 - (peak + g + up) ELSE 0 END AS down FROM b)
SELECT l_returnflag, l_linestatus, round(g + up + down + 1.5, 6) AS gain_db FROM c""")
def gain_staging(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        (10 * F.log10(F.avg(F.col("l_quantity") * F.col("l_quantity"))) - 50).alias("lufs"), (20 * F.log10(F.max("l_quantity")) - 40).alias("peak")
    )
    gain = levels.stage_gain(F.col("lufs"), F.lit(-23.0), F.col("peak"), F.lit(-1.0), F.col("l_linestatus") == "F", F.lit(True), F.lit(1.5))
    return m.select("l_returnflag", "l_linestatus", F.round(gain, 6).alias("gain_db"))


@query("""WITH a AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS bal2, c_acctbal, c_mktsegment,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg2 FROM customer)
SELECT c_custkey, 'c_acctbal' AS field FROM a WHERE c_acctbal <> bal2 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM a WHERE seg2 IS NULL AND c_mktsegment IS NOT NULL""")
def field_diff(spark, sf_dir):
    before = table(spark, sf_dir, "customer")
    after = before.withColumns({
        "c_acctbal": F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") * 2).otherwise(F.col("c_acctbal")),
        "c_mktsegment": F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")),
    })
    return lookups.changed_fields(before, after, ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"]).select("c_custkey", "field")


_LABEL = "substr('MUTBX', CAST(p_partkey % 5 AS INT) + 1, 1) || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || lpad(CAST(p_size * 3 AS VARCHAR), 3, '0') || CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE '' END"


@query(f"""WITH l AS (SELECT p_partkey, {_LABEL} AS label FROM part) SELECT p_partkey, CAST(regexp_extract(label, '^[MUTB]([+-][0-9]+)$', 1) AS DOUBLE) AS azimuth,
  CASE left(label, 1) WHEN 'M' THEN 0.0 WHEN 'U' THEN 30.0 WHEN 'T' THEN 90.0 WHEN 'B' THEN -30.0 END AS elevation
FROM l WHERE regexp_matches(label, '^[MUTB][+-][0-9]+$')""")
def label_parse(spark, sf_dir):
    label = F.expr(_LABEL.replace("VARCHAR", "STRING"))
    out = table(spark, sf_dir, "part").select("p_partkey", labels.label_direction(label).alias("d")).filter("d IS NOT NULL")
    return out.select("p_partkey", "d.azimuth", "d.elevation")


@query("SELECT n_nationkey, upper(regexp_replace(n_name || '+' || r_name, '[^0-9A-Za-z+-]', '', 'g')) AS label, upper(regexp_replace(n_name || '+' || r_name, '[^0-9A-Za-z]', '', 'g')) AS key FROM nation JOIN region ON r_regionkey = n_regionkey")
def label_canon(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    name = F.concat_ws("+", "n_name", "r_name")
    return both.select("n_nationkey", labels.canonical_label(name).alias("label"), labels.label_key(name).alias("key"))


@query("SELECT l_suppkey, min(l_discount) AS low, max(l_discount) AS high, max(l_discount) - min(l_discount) > 1e-4 AS moves FROM lineitem GROUP BY l_suppkey")
def minmax_range(spark, sf_dir):
    return prefixes.ranges(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount")


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders")
def json_roundtrip(spark, sf_dir):
    """Through JSON that leaves out what is absent, and back."""
    orders = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), price.alias("price")))
    back = orders.select("o_orderkey", F.from_json(text, "status string, price double").alias("j"))
    return back.select("o_orderkey", "j.status", "j.price")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def first_per_key(spark, sf_dir):
    return lookups.first_hit(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_totalprice"])
