"""Timeline, metering and filter queries over ``events`` and ``lineitem``.

The tables are not scenes; the queries run the library's operators on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metering, prefixes, timeline
from .base import EFF, EV, HOUR, block_events, query, table


def _effective(spark, sf_dir) -> DataFrame:
    return timeline.last_start_wins(block_events(spark, sf_dir), ["user_id"], "s", "e", ["event_id"])


def _ramped(spark, sf_dir) -> DataFrame:
    return timeline.ramped(
        _effective(spark, sf_dir), ["user_id"], "s", ["event_id"], "value", F.lit(HOUR // 2), F.col("event_id") % 7 == 0
    )


RAMP = (
    ", act AS (SELECT *, greatest(0, eff_end - s) AS active FROM eff), ramp AS (SELECT *,"
    f" CASE WHEN rn = 1 OR event_id % 7 = 0 THEN 0 ELSE least({HOUR // 2}, active) END AS ramp FROM act)"
)


@query(f"WITH {EFF}{RAMP} SELECT event_id, user_id, s, e, eff_end, active, ramp, prev_gain FROM ramp")
def effective_blocks(spark, sf_dir):
    """Last start wins, with active length and ramp."""
    return _ramped(spark, sf_dir).select("event_id", "user_id", "s", "e", "eff_end", "active", "ramp", "prev_gain")


@query(f"""WITH {EV}, w AS (SELECT *, greatest(s, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS eff_start FROM ev)
SELECT event_id, user_id, s, e, eff_start FROM w WHERE eff_start < e""")
def first_not_ended(spark, sf_dir):
    out = timeline.first_not_ended_wins(block_events(spark, sf_dir), ["user_id"], "s", "e", ["event_id"])
    return out.select("event_id", "user_id", "s", "e", "eff_start")


GRID = f", grid AS (SELECT DISTINCT user_id, s // {6 * HOUR} * {6 * HOUR} + {3 * HOUR} AS frame FROM ev)"


def _grid(spark, sf_dir) -> DataFrame:
    step = F.floor(F.col("s") / (6 * HOUR)) * (6 * HOUR) + 3 * HOUR
    return block_events(spark, sf_dir).select("user_id", step.alias("frame")).distinct()


@query(f"""WITH {EFF}{GRID} SELECT g.user_id, g.frame, event_id FROM grid g JOIN eff
  ON g.user_id = eff.user_id AND frame >= s AND frame < eff_end""")
def active_block_at_grid(spark, sf_dir):
    hit = timeline.active_at(_effective(spark, sf_dir), _grid(spark, sf_dir), ["user_id"], "frame", "s", "eff_end", 12 * HOUR)
    return hit.select("user_id", "frame", "event_id")


@query(f"""WITH {EFF}{RAMP}{GRID}, hit AS (SELECT g.user_id, g.frame, value, prev_gain,
  CASE WHEN ramp > 0 THEN least((frame - s) / ramp, 1.0) ELSE 1.0 END AS a FROM grid g JOIN ramp r
  ON g.user_id = r.user_id AND frame >= s AND frame < eff_end)
SELECT user_id, frame, round(prev_gain * (1 - a) + value * a, 4) AS gain FROM hit""")
def ramp_values(spark, sf_dir):
    hit = timeline.active_at(_ramped(spark, sf_dir), _grid(spark, sf_dir), ["user_id"], "frame", "s", "eff_end", 12 * HOUR)
    gain = timeline.ramp_value(F.col("frame"), F.col("s"), F.col("ramp"), F.col("prev_gain"), F.col("value"))
    return hit.select("user_id", "frame", F.round(gain, 4).alias("gain"))


@query(f"""WITH {EV}, c AS (SELECT event_id, greatest(s, s // {24 * HOUR} * {24 * HOUR} + {6 * HOUR}) AS s,
  least(e, s // {24 * HOUR} * {24 * HOUR} + {18 * HOUR}) AS e FROM ev) SELECT event_id, s, e FROM c WHERE s < e""")
def window_clip(spark, sf_dir):
    day = F.floor(F.col("s") / (24 * HOUR)) * (24 * HOUR)
    part = timeline.clipped(F.col("s"), F.col("e"), day + 6 * HOUR, day + 18 * HOUR)
    out = block_events(spark, sf_dir).select("event_id", part.alias("p")).filter("p IS NOT NULL")
    return out.select("event_id", F.col("p.start").alias("s"), F.col("p.end").alias("e"))


@query(f"""WITH {EV}, n AS (SELECT event_id, s * 1000003 - 1700000000000000000 AS ns FROM ev)
SELECT event_id, CAST(CASE WHEN ns < 0 THEN 0 ELSE ns // 1000000000 * 48000
  + ((ns % 1000000000) * 48000 + 500000000) // 1000000000 END AS BIGINT) AS sample FROM n""")
def time_to_sample(spark, sf_dir):
    ns = F.col("s") * F.lit(1000003) - F.lit(1700000000000000000)
    return block_events(spark, sf_dir).select("event_id", timeline.nanos_to_samples(ns, F.lit(48000)).alias("sample"))


def _hop(length: int, hop: int) -> str:
    return f"""hops AS (SELECT user_id, s // {hop} * {hop} AS h, sum(value * value) AS e, count(*) AS n FROM ev GROUP BY ALL),
wide AS (SELECT user_id, h - k * {hop} AS w, e, n FROM hops, range({length // hop}) t(k)),
win AS (SELECT user_id, w, sum(e) / sum(n) AS energy, sum(n) AS n FROM wide GROUP BY ALL)"""


def _windows(spark, sf_dir, length: int, hop: int) -> DataFrame:
    return metering.hopped(block_events(spark, sf_dir), ["user_id"], "s", F.col("value") * F.col("value"), length, hop)


def _sliding(length: int, hop: int):
    sql = f"WITH {EV}, {_hop(length, hop)} SELECT user_id, w, round(sqrt(energy), 4) AS level, CAST(n AS BIGINT) AS n FROM win"
    run = lambda spark, sf_dir: _windows(spark, sf_dir, length, hop).select(
        "user_id", "w", F.round(F.sqrt("energy"), 4).alias("level"), "n"
    )
    return sql, run


@query(_sliding(4 * HOUR, HOUR)[0])
def momentary(spark, sf_dir):
    return _sliding(4 * HOUR, HOUR)[1](spark, sf_dir)


@query(_sliding(24 * HOUR, 3 * HOUR)[0])
def shortterm(spark, sf_dir):
    return _sliding(24 * HOUR, 3 * HOUR)[1](spark, sf_dir)


@query(f"""WITH {EV}, {_hop(4 * HOUR, HOUR)}, loud AS (SELECT *, avg(energy) OVER (PARTITION BY user_id) * 0.5 AS gate
  FROM win WHERE energy > 100)
SELECT user_id, round(avg(energy), 2) AS energy, count(*) AS windows FROM loud WHERE energy > gate GROUP BY user_id""")
def gated_energy(spark, sf_dir):
    out = metering.gated(_windows(spark, sf_dir, 4 * HOUR, HOUR), ["user_id"], 100.0, 0.5)
    return out.select("user_id", F.round("energy", 2).alias("energy"), "windows")


@query("""SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS key, max(abs(value)) AS peak, round(sqrt(avg(value * value)), 4) AS rms
  FROM events GROUP BY user_id UNION ALL SELECT 'flag', l_returnflag, max(abs(l_quantity)), round(sqrt(avg(l_quantity * l_quantity)), 4)
  FROM lineitem GROUP BY l_returnflag""")
def peak_rms(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("value").alias("x"))
    li = table(spark, sf_dir, "lineitem").select(F.lit("flag").alias("kind"), F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("x"))
    out = metering.peak_and_rms(ev.unionByName(li), ["kind", "key"], F.col("x"))
    return out.withColumn("rms", F.round("rms", 4))


@query(f"""WITH {EV}, r AS (SELECT event_id, user_id, abs(value) AS raw, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM ev)
SELECT event_id, round(exp(max(CASE WHEN raw > 0 THEN ln(raw) - k * ln(0.85) END) OVER (PARTITION BY user_id ORDER BY k) + k * ln(0.85)) + 1e-7, 4) AS held FROM r""")
def peak_hold_decay(spark, sf_dir):
    ev = block_events(spark, sf_dir).withColumn("raw", F.abs("value"))
    return metering.held_peak(ev, ["user_id"], ["s", "event_id"], "raw").select("event_id", F.round(F.col("held") + 1e-7, 4).alias("held"))


_TAPS = metering.decorrelator([0, 1, 3, 4, 7, 11, 13, 17])
_FIR = " + ".join(f"coalesce(lag(value, {lag}) OVER w, 0) * ({g!r})" for lag, g in _TAPS)


@query(f"WITH {EV} SELECT event_id, round({_FIR}, 4) AS filtered FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)")
def fir_taps(spark, sf_dir):
    out = metering.fir(block_events(spark, sf_dir), ["user_id"], ["s", "event_id"], "value", _TAPS)
    return out.select("event_id", F.round("filtered", 4).alias("filtered"))


@query(f"WITH {EV} SELECT event_id, coalesce(lag(value, 5) OVER (PARTITION BY user_id ORDER BY s, event_id), 0) AS delayed FROM ev")
def delay_line(spark, sf_dir):
    return metering.delayed(block_events(spark, sf_dir), ["user_id"], ["s", "event_id"], "value", 5).select("event_id", "delayed")


@query(f"""WITH {EV}, last AS (SELECT user_id, max(s) AS m FROM ev GROUP BY user_id),
r AS (SELECT event_id, ev.user_id, row_number() OVER w - 1 AS k, greatest(1, ceil(count(*) OVER (PARTITION BY ev.user_id) / 10.0)) AS stride
  FROM ev JOIN last USING (user_id) WHERE s >= m - {240 * HOUR} WINDOW w AS (PARTITION BY ev.user_id ORDER BY s, event_id))
SELECT event_id, user_id, CAST(stride AS BIGINT) AS stride FROM r WHERE k % CAST(stride AS BIGINT) = 0""")
def stride_decimate(spark, sf_dir):
    ev = block_events(spark, sf_dir).withColumn("m", F.max("s").over(Window.partitionBy("user_id")))
    out = prefixes.thinned(ev, ["user_id"], ["s", "event_id"], 10, F.col("m"), F.lit(240 * HOUR), "s")
    return out.select("event_id", "user_id", F.col("stride").cast("long").alias("stride"))


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS gain FROM orders
UNION ALL SELECT 'event', event_id, value FROM events UNION ALL SELECT 'event_type', count(*), NULL FROM events GROUP BY event_type""")
def union_blocks(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    a = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("gain"))
    b = ev.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("gain"))
    c = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("id")).select(F.lit("event_type").alias("kind"), "id")
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


def _k_weighted_sql(rate: float) -> str:
    """Sample by sample: the two filters' states as columns of a recursion."""
    (b0, b1, b2, a1, a2), (c0, c1, c2, d1, d2) = (x.tolist() for x in metering.k_weighting(rate))
    y1 = f"({b0!r} * x + s1)"
    y2 = f"({c0!r} * {y1} + t1)"
    return f"""o AS (SELECT user_id, value / 1000 AS x, row_number() OVER (PARTITION BY user_id ORDER BY s, value) AS k FROM ev),
f(user_id, k, s1, s2, t1, t2, y) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM o
  UNION ALL SELECT o.user_id, o.k, {b1!r} * x - ({a1!r}) * {y1} + s2, {b2!r} * x - ({a2!r}) * {y1}, ({c1!r}) * {y1} - ({d1!r}) * {y2} + t2, {c2!r} * {y1} - ({d2!r}) * {y2}, {y2}
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)"""


@query(f"""WITH RECURSIVE {EV}, {_k_weighted_sql(4000.0)},
h AS (SELECT user_id, (k - 1) // 20 AS hop, sum(y * y) / count(*) AS e FROM f WHERE k > 0 GROUP BY ALL),
w AS (SELECT user_id, hop - j AS w, avg(e) AS energy FROM h, range(4) t(j) GROUP BY ALL),
l AS (SELECT *, avg(energy) OVER (PARTITION BY user_id) * 0.1 AS gate FROM w WHERE energy > pow(10, (-70 + 0.691) / 10))
SELECT user_id, round(-0.691 + 10 * log10(avg(energy)), 3) AS lufs, count(*) AS windows FROM l WHERE energy > gate GROUP BY user_id""")
def kweight_loudness(spark, sf_dir):
    """Gated loudness of each user's values as a signal of 50 samples a second, 20 in a hop."""
    signal = block_events(spark, sf_dir).select("user_id", "s", (F.col("value") / 1000).alias("x"))
    hops = metering.k_weighted_energy(signal, ["user_id"], "s", "x", 4000.0, 20, 24 * HOUR)
    windows = metering.hopped(hops, ["user_id"], "hop", F.col("e") / F.col("n"), 4, 1)
    return metering.integrated_loudness(windows, ["user_id"]).select("user_id", F.round("lufs", 3).alias("lufs"), "windows")


_LAGS = " + ".join(f"coalesce(lag(value, {k}) OVER w, 0)" for k in range(16))


@query(f"""WITH {EV}, f AS (SELECT user_id, s, event_id, s // {24 * HOUR} AS day, ({_LAGS}) / 16 AS y FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT user_id, day, list(round(y, 6) ORDER BY s, event_id) AS samples FROM f GROUP BY ALL""")
def ola_fir(spark, sf_dir):
    """Each user's values, in blocks of a day, through a 16-tap kernel."""
    ev = block_events(spark, sf_dir).withColumn("day", F.floor(F.col("s") / (24 * HOUR)))
    blocks = ev.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("s", "event_id", "value"))).alias("b"))
    blocks = blocks.select("user_id", "day", F.transform("b", lambda x: x["value"]).alias("samples"))
    out = metering.overlap_add(blocks, ["user_id"], "day", "samples", [1 / 16] * 16)
    return out.select("user_id", "day", F.transform("samples", lambda x: F.round(x, 6) + F.lit(0.0)).alias("samples"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS revision, arg_max(value, event_id) AS gain FROM events GROUP BY user_id""")
def stream_overrides(spark, sf_dir):
    """The latest override of each user; the same expression runs on a stream."""
    from ..streaming.monitor import latest_overrides

    ev = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("revision"), F.col("value").alias("gain"))
    return latest_overrides(ev, ["user_id"])
