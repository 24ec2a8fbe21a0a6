"""Filters, groupings, lookups and meters of scenes, on the business tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, harmonics, labels
from ..operators import lookups, metering, mixing, timeline
from ..sources import registry
from .base import EFF, EV, HOUR, block_events, parts_of, query, table
from .scenes import _CHORD, DIRECTIONS, SPEAKERS, _directions, _values
from .timelines import _effective


@query("""SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 13 <> 0 AND o_orderkey % 9 <> 0""")
def audible_tracks(spark, sf_dir):
    """Tracks with a channel, of objects that are not muted."""
    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 13 == 0).alias("mute"))
    tracks = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("if(o_orderkey % 9 = 0, null, o_orderkey % 64)").alias("channel"))
    return tracks.filter("channel IS NOT NULL").join(objects.filter("NOT mute"), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT c_nationkey, bool_or(c_custkey % 13 <> 0 AND abs(CASE WHEN c_custkey % 40 = 1 THEN c_acctbal ELSE 0.0005 END) > 1e-3) AS elevated
  FROM customer GROUP BY c_nationkey""")
def elevated_scenes(spark, sf_dir):
    """Whether any object of a scene that is not muted is off the horizontal plane."""
    el = F.when(F.col("c_custkey") % 40 == 1, F.col("c_acctbal")).otherwise(0.0005)
    heard = (F.col("c_custkey") % 13 != 0) & (F.abs(el) > 1e-3)
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.bool_or(heard).alias("elevated"))


@query("""WITH ch AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49))
SELECT c_custkey, (SELECT count(*) FROM ch WHERE o_custkey = c_custkey) AS channels FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ch)""")
def filled_packs(spark, sf_dir):
    """Channels without blocks go, then packs without channels."""
    blocks = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    channels = table(spark, sf_dir, "orders").join(blocks, "o_orderkey", "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("channels"))
    return table(spark, sf_dir, "customer").join(channels, "c_custkey").select("c_custkey", "channels")


@query("""SELECT min(url) AS url, lower(url) AS key FROM pages WHERE regexp_matches(lower(url), '\\.(html|xml|wav)$') GROUP BY lower(url)""")
def queued_paths(spark, sf_dir):
    """Each path once, case aside, of those with an extension that can be read."""
    paths = table(spark, sf_dir, "pages").filter(F.lower("url").rlike(r"\.(html|xml|wav)$"))
    return paths.groupBy(F.lower("url").alias("key")).agg(F.min("url").alias("url")).select("url", "key")


@query("SELECT l_orderkey, round(sum(l_discount * l_quantity), 4) AS gain FROM lineitem GROUP BY l_orderkey")
def gain_sums(spark, sf_dir):
    """The gains of a block's virtual sources, added up."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")), 4).alias("gain"))


@query("""SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS skipped FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey""")
def skipped_types(spark, sf_dir):
    """Names of the types that an import leaves out, each once and in order."""
    out = table(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("t"))
    return out.select("c_nationkey", F.array_join("t", ",").alias("skipped"))


@query("""SELECT c_nationkey, count(*) AS tracks, count(*) FILTER (c_mktsegment IN ('BUILDING', 'FURNITURE')) AS lfe FROM customer GROUP BY c_nationkey""")
def track_counts(spark, sf_dir):
    low = F.col("c_mktsegment").isin("BUILDING", "FURNITURE")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("tracks"), F.count_if(low).alias("lfe"))


@query("""WITH e AS (SELECT o_custkey, o_orderkey, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS slot
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey), m AS (SELECT o_custkey, max(slot) AS most FROM e GROUP BY o_custkey),
a AS (SELECT DISTINCT o_custkey, o_orderkey FROM e), f AS (SELECT a.*, unnest(range(most + 1)) AS slot FROM a JOIN m USING (o_custkey))
SELECT o_custkey, o_orderkey, slot, l_quantity AS gain, l_quantity IS NULL AS silent FROM f LEFT JOIN e USING (o_custkey, o_orderkey, slot)""")
def slot_padding(spark, sf_dir):
    """All blocks of a track with as many slots as the fullest one."""
    w = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    parts = parts_of(lines)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    lines = lines.repartition(parts, "o_orderkey").join(orders, "o_orderkey")
    events = lines.select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("slot"), F.col("l_quantity").alias("gain"))
    return lookups.padded_slots(events, ["o_custkey"], ["o_orderkey"], "slot", parts).select("o_custkey", "o_orderkey", F.col("slot").cast("long").alias("slot"), "gain", "silent")


@query("""SELECT n_nationkey, coalesce(string_agg(r, ',' ORDER BY k), '') AS supported_by FROM nation LEFT JOIN
  (SELECT DISTINCT c_nationkey, c_mktsegment AS r, length(c_mktsegment) * 100 + ascii(c_mktsegment) AS k FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def supported_by(spark, sf_dir):
    """The renderers of each layout, in the renderers' order."""
    name = F.col("c_mktsegment")
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), (F.length(name) * 100 + F.ascii(name)).alias("k"), name.alias("r")).distinct()
    own = rich.groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("l"))
    out = table(spark, sf_dir, "nation").select("n_nationkey").join(own, "n_nationkey", "left")
    return out.select("n_nationkey", F.coalesce(F.array_join(F.transform("l", lambda x: x["r"]), ","), F.lit("")).alias("supported_by"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'M+030' END AS label FROM orders)
SELECT o_custkey, coalesce(arg_max(o_totalprice, o_orderkey) FILTER (label IS NOT NULL), arg_max(o_totalprice, o_orderkey) FILTER (label IS NULL)) AS gain,
  bool_or(label IS NOT NULL) AS of_channel FROM o GROUP BY o_custkey""")
def live_overrides(spark, sf_dir):
    """The override of one channel, else of the whole object; the last of a kind."""
    label = F.when(F.col("o_orderkey") % 3 == 0, "M+030")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("gain"), label.alias("label")).withColumn("of_channel", F.col("label").isNotNull())
    return lookups.overriding(orders, ["o_custkey"], "label", "o_orderkey", ["gain", "of_channel"])


@query("""SELECT o_custkey, o_orderpriority AS pack, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS uids FROM orders GROUP BY ALL""")
def pack_groups(spark, sf_dir):
    """The tracks of an object by their pack, in order."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("pack")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("u"))
    return own.select("o_custkey", "pack", F.array_join(F.transform("u", lambda x: x.cast("string")), ",").alias("uids"))


@query()
def mirror_groups(spark, sf_dir):
    """Lines of an order as the channels of a bed, in mirrored pairs and singles."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    az = F.round((F.col("l_quantity") - 25.5) * F.col("l_linenumber") % 30 + F.col("l_discount"), 2)
    beds = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("ord"), az.alias("az"), (F.col("l_tax") * 10).alias("el"))
    return lookups.mirror_groups(beds, ["l_orderkey"], "ord", "az", "el")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS bed, o_orderkey % 2 AS lfe, o_totalprice > 200000 AS height,
  lag(o_orderkey % 5) OVER w AS pb, lag(o_orderkey % 2) OVER w AS pl, lag(o_totalprice > 200000) OVER w AS ph, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, count(*) <= 7 AND bool_and(k = 1 OR (bed >= pb AND lfe >= pl AND height >= ph)) AS valid FROM o GROUP BY o_custkey""")
def layer_order(spark, sf_dir):
    """At most seven layers, none with fewer channels of any kind than the one before it."""
    sizes = {"bed": F.col("o_orderkey") % 5, "lfe": F.col("o_orderkey") % 2, "height": (F.col("o_totalprice") > 200000).cast("int")}
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", *(v.alias(k) for k, v in sizes.items()))
    grows = [F.coalesce(F.col(c) >= F.lag(c).over(w), F.lit(True)) for c in sizes]
    rows = rows.withColumn("ok", grows[0] & grows[1] & grows[2])
    return rows.groupBy("o_custkey").agg(((F.count(F.lit(1)) <= 7) & F.bool_and("ok")).alias("valid"))


_LABEL = "substr('MUTB', CAST(p_partkey % 4 AS INT) + 1, 1) || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || lpad(CAST(p_size % 10 * 15 AS VARCHAR), 3, '0')"


@query(f"""WITH t(label, azimuth, elevation) AS (VALUES {", ".join(f"('{n}', {a}, {e})" for n, a, e in labels.BINAURAL_DIRECTIONS)})
SELECT p_partkey, azimuth, elevation FROM (SELECT p_partkey, {_LABEL} AS label FROM part) LEFT JOIN t USING (label)""")
def label_table(spark, sf_dir):
    known = spark.createDataFrame(labels.BINAURAL_DIRECTIONS, "label string, azimuth int, elevation int")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_LABEL.replace("VARCHAR", "STRING")).alias("label"))
    return parts.join(F.broadcast(known), "label", "left").select("p_partkey", "azimuth", "elevation")


_GRID = f", g AS (SELECT DISTINCT user_id, s // {6 * HOUR} * {6 * HOUR} AS lo FROM ev)"
_AT = "(SELECT user_id, lo, value FROM g JOIN eff USING (user_id) WHERE {f} >= s AND {f} < eff_end)"


@query(f"""WITH {EFF}{_GRID}, a AS {_AT.format(f="lo")}, z AS {_AT.format(f=f"lo + {6 * HOUR - 1}")}, k AS (SELECT unnest([0, {HOUR}, {6 * HOUR - 1}]) AS f)
SELECT g.user_id, g.lo, f, round(CASE WHEN a.value IS NULL OR z.value IS NULL THEN -1 ELSE a.value * (1 - f / {6.0 * HOUR - 1}) + z.value * (f / {6.0 * HOUR - 1}) END, 4) AS gain
FROM g CROSS JOIN k LEFT JOIN a ON a.user_id = g.user_id AND a.lo = g.lo LEFT JOIN z ON z.user_id = g.user_id AND z.lo = g.lo""")
def block_smoothing(spark, sf_dir):
    """Gains at the first and last frame of a processing block, and in a line between them."""
    size, ev = 6 * HOUR, _effective(spark, sf_dir)
    grid = ev.select("user_id", (F.floor(F.col("s") / size) * size).alias("lo")).distinct()
    ends = grid.select("user_id", "lo", F.explode(F.array(F.lit(0), F.lit(size - 1))).alias("_to")).withColumn("frame", F.col("lo") + F.col("_to"))
    hit = timeline.active_at(ev, ends, ["user_id"], "frame", "s", "eff_end", 12 * HOUR)
    at = hit.groupBy("user_id", "lo").agg(F.max(F.when(F.col("_to") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("_to") > 0, F.col("value"))).alias("z"))
    rows = grid.join(at, ["user_id", "lo"], "left").withColumn("f", F.explode(F.array(F.lit(0), F.lit(HOUR), F.lit(size - 1))))
    gain = timeline.smoothed(F.col("a"), F.col("z"), F.col("f"), F.lit(size), F.lit(-1.0))
    return rows.select("user_id", "lo", "f", F.round(gain, 4).alias("gain"))


@query(f"""WITH {EV}, k AS (SELECT user_id, s, event_id, value, lag(value) OVER w AS before, lead(s) OVER w AS next, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
q AS (SELECT DISTINCT user_id, s // {6 * HOUR} * {6 * HOUR} + {2 * HOUR} AS t FROM ev),
h AS (SELECT q.user_id, t, k.* EXCLUDE (user_id) FROM q JOIN k ON q.user_id = k.user_id AND (n = 1 OR s <= t) AND (next IS NULL OR t < next))
SELECT user_id, t, round(CASE WHEN before IS NULL OR (t - s) / {4.0 * HOUR} >= 1 THEN value ELSE before * (1 - greatest(t - s, 0) / {4.0 * HOUR}) + value * (greatest(t - s, 0) / {4.0 * HOUR}) END, 4) AS value FROM h""")
def keyframe_lerp(spark, sf_dir):
    """The value at a time between keyframes; before the first one it is the first's."""
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    ev = block_events(spark, sf_dir).select("user_id", "s", "event_id", "value", F.lag("value").over(w).alias("before"), F.lead("s").over(w).alias("next"), F.row_number().over(w).alias("n"))
    frames = ev.select("user_id", (F.floor(F.col("s") / (6 * HOUR)) * (6 * HOUR) + 2 * HOUR).alias("t")).distinct()
    keys = ev.withColumn("from", F.when(F.col("n") == 1, F.lit(-(2**62))).otherwise(F.col("s")))
    hit = timeline.active_at(keys, frames, ["user_id"], "t", "from", "next", 12 * HOUR)
    return hit.select("user_id", "t", F.round(timeline.keyframed(F.col("t"), F.col("s"), F.lit(4 * HOUR), F.col("before"), F.col("value")), 4).alias("value"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 50 - 2 AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 70 / 1.7 END AS z, 44100 AS rate, o_orderkey * 137 % 2000000 AS n FROM orders),
f AS (SELECT *, CAST(floor(a * rate + 0.5) AS BIGINT) AS lo, least(coalesce(CAST(floor(z * rate + 0.5) AS BIGINT), n), n) AS hi FROM t)
SELECT o_orderkey, lo AS start_frame, hi AS end_frame FROM f WHERE a >= 0 AND (z IS NULL OR z > a) AND lo < n AND lo < hi""")
def trim_frames(spark, sf_dir):
    """Windows in seconds as frames; what keeps nothing goes."""
    k = F.col("o_orderkey")
    part = timeline.trimmed((k % 50 - 2).cast("double"), F.when(k % 4 > 0, k % 70 / 1.7), F.lit(44100), k * 137 % 2000000)
    out = table(spark, sf_dir, "orders").select("o_orderkey", part.alias("p")).filter("p IS NOT NULL")
    return out.select("o_orderkey", F.col("p.start").alias("start_frame"), F.col("p.end").alias("end_frame"))


@query(f"""WITH {EV}, e AS (SELECT *, sum(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS epoch FROM ev),
w AS (SELECT user_id, epoch, s // {HOUR} AS h, avg(value * value) AS energy FROM e GROUP BY ALL),
l AS (SELECT *, avg(energy) OVER (PARTITION BY user_id, epoch) * 0.5 AS gate FROM w WHERE energy > 100)
SELECT user_id, CAST(epoch AS BIGINT) AS epoch, round(avg(energy) + 1e-7, 4) AS energy, count(*) AS windows FROM l WHERE energy > gate GROUP BY ALL""")
def loudness_since_seek(spark, sf_dir):
    """Gated energy of what was heard since the last seek."""
    ev = metering.since_seek(block_events(spark, sf_dir), ["user_id"], ["s", "event_id"], F.col("event_id") % 20 == 0)
    windows = metering.hopped(ev, ["user_id", "epoch"], "s", F.col("value") * F.col("value"), HOUR, HOUR)
    out = metering.gated(windows, ["user_id", "epoch"], 100.0, 0.5)
    return out.select("user_id", "epoch", F.round(F.col("energy") + 1e-7, 4).alias("energy"), "windows")


_PHASES = metering.oversampler(4, 3).tolist()
_PEAK = ", ".join("abs(" + " + ".join(f"coalesce(lead(value, {k - 2}) OVER w, 0) * ({row[5 - k]!r})" for k in range(6)) + ")" for row in _PHASES)


@query(f"""WITH {EV}, b AS (SELECT user_id, value, s, event_id FROM ev),
wide AS (SELECT user_id, value, s, event_id FROM b UNION ALL SELECT DISTINCT user_id, 0, -x, -x FROM b, range(1, 4) t(x) UNION ALL SELECT DISTINCT user_id, 0, 9000000000000000 + x, x FROM b, range(1, 4) t(x)),
p AS (SELECT user_id, greatest({_PEAK}) AS p FROM wide WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) SELECT user_id, round(max(p), 3) AS peak FROM p GROUP BY user_id""")
def true_peak(spark, sf_dir):
    """The oversampled peak of each user's values, in blocks of a day."""
    ev = block_events(spark, sf_dir).withColumn("day", F.floor(F.col("s") / (24 * HOUR)))
    blocks = ev.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("s", "event_id", "value"))).alias("b"))
    blocks = blocks.select("user_id", "day", F.transform("b", lambda x: x["value"]).alias("samples"))
    return metering.true_peaks(blocks, ["user_id"], "day", "samples", 4, 3).select("user_id", F.round("peak", 3).alias("peak"))


_DECODE = [(k, o, round(((k * 7 + o * 3) % 11 - 5) / 10, 1)) for k in range(4) for o in range(3)]


@query("WITH d(in_ch, out_ch, gain) AS (VALUES " + ", ".join(map(str, _DECODE)) + """),
s AS (SELECT o_custkey, o_orderkey % 4 AS in_ch, o_totalprice * (1 + o_orderkey % 3) / 2.0 * (o_custkey % 5) / 4.0 * sqrt(2 * floor(sqrt(o_orderkey % 4)) + 1) AS v FROM orders)
SELECT o_custkey, out_ch, round(sum(v * gain), 4) AS mix FROM s JOIN d USING (in_ch) WHERE gain <> 0 GROUP BY ALL""")
def hoa_decode(spark, sf_dir):
    """A decoding matrix times block gain and pack gain, in the full normalisation."""
    acn = F.col("o_orderkey") % 4
    value = F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3) / 2.0 * (F.col("o_custkey") % 5) / 4.0
    samples = table(spark, sf_dir, "orders").select("o_custkey", acn.cast("int").alias("in_ch"), harmonics.full_normalised(acn, value).alias("value"))
    matrix = spark.createDataFrame(_DECODE, "in_ch int, out_ch int, gain double")
    return mixing.mixed(samples, matrix, ["o_custkey"]).withColumn("mix", F.round("mix", 4))


_NAMED = "['M+030', 'L', 'U+045', 'LFE', 'ZZ', 'CS', 'U+110', 'LSS'][CAST(p_partkey % 8 AS INT) + 1]"


@query(f"""WITH known(label) AS (VALUES {_values((s[0],) for s in registry.LAYOUTS[("4+5+0", "5.1.4")]).replace(",)", ")")}),
alias(name, label, ord) AS (VALUES {_values((a, b, k) for k, (a, b) in enumerate(registry.LABEL_NAMES))}),
p AS (SELECT p_partkey, {_NAMED} AS name FROM part)
SELECT p_partkey, coalesce(known.label, (SELECT arg_min(a.label, a.ord) FROM alias a WHERE a.name = p.name AND a.label IN (SELECT label FROM known))) AS speaker
FROM p LEFT JOIN known ON known.label = name WHERE speaker IS NOT NULL""")
def label_lookup(spark, sf_dir):
    """A speaker by its own label before any alias."""
    name = F.expr(_NAMED.replace("[CAST", "[CAST").replace("['", "array('").replace("'][", "')[").replace(" + 1]", "]"))
    known = registry.Registry().speakers(spark).filter("layout_id = '4+5+0'")
    return lookups.by_label(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), ["p_partkey"], "name", known, registry.label_names(spark))


@query(f"""WITH {DIRECTIONS}, {SPEAKERS}, g AS (SELECT c_custkey, bal, k, label, {_CHORD} AS gap FROM d, spk),
n AS (SELECT c_custkey, any_value(bal) AS bal, arg_min(label, struct_pack(gap := round(gap, 9), k := k)) AS label, min(gap) AS gap FROM g GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN bal < 0 OR gap <= abs(bal) / 5000 + 1e-4 THEN label END AS label FROM n""")
def nearest_within(spark, sf_dir):
    """The nearest speaker, if it is near enough."""
    spk = registry.Registry().speakers(spark).filter("layout_id = '4+5+0'").select("spk_ord", "label", "azimuth", "elevation", "is_lfe")
    gap = lambda p: geometry.chord(geometry.unit_vector(F.col("az"), F.col("el")), geometry.unit_vector(p["azimuth"], p["elevation"]))
    most = F.when(F.col("bal") >= 0, F.abs("bal") / 5000)
    return lookups.nearest_within(_directions(spark, sf_dir), spk, gap, "label", "spk_ord", most).select("c_custkey", "label")


@query("""SELECT o_custkey, round(coalesce(sum(v) FILTER (NOT low), 0), 4) AS mix, round(greatest(abs(coalesce(sum(v) FILTER (NOT low), 0)), coalesce(max(abs(v)) FILTER (low), 0)), 4) AS peak
  FROM (SELECT o_custkey, o_totalprice * (o_orderkey % 3 - 1) AS v, o_orderkey % 4 = 3 AS low FROM orders) GROUP BY o_custkey""")
def lfe_separation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") * (F.col("o_orderkey") % 3 - 1)).alias("v"), (F.col("o_orderkey") % 4 == 3).alias("low"))
    out = mixing.lfe_apart(orders, ["o_custkey"], F.col("low"), F.col("v"))
    return out.select("o_custkey", F.round("mix", 4).alias("mix"), F.round("peak", 4).alias("peak"))


@query("""WITH p AS (SELECT p_partkey, p_brand || '_' || CASE WHEN p_size % 3 = 0 THEN 'L' ELSE 'r' END AS name FROM part),
s AS (SELECT p_partkey, left(name, length(name) - 2) AS stem, upper(right(name, 1)) AS side FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY stem, side ORDER BY p_partkey) AS k FROM s)
SELECT coalesce(a.stem, b.stem) AS stem, a.p_partkey AS left_ord, b.p_partkey AS right_ord FROM (SELECT * FROM r WHERE side = 'L') a FULL JOIN (SELECT * FROM r WHERE side = 'R') b
  ON a.stem = b.stem AND a.k = b.k""")
def stem_groups(spark, sf_dir):
    """Objects by their stems in pairs, and those that are left over."""
    name = F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, "_L").otherwise("_r"))
    parts = table(spark, sf_dir, "part").select("p_partkey", labels.stem_and_side(name).alias("x")).select("p_partkey", "x.*")
    return lookups.kth_pairs(parts, "stem", "side", "p_partkey", singles=True)
