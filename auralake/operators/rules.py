"""Rules over objects: which match, how their settings fold, what they change.

A rule table has ``rule_ord`` (-1 is the global rule) and nullable match and
setting columns; null means "not set".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import wrap_azimuth
from ..functions.labels import ascii_lower


def glob_expression(glob: Column) -> Column:
    """A regular expression, per row, for the ``*`` and ``?`` of a column of globs."""
    escaped = F.regexp_replace(ascii_lower(glob), r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def glob_matches(value: Column, glob: Column) -> Column:
    return (glob != "") & F.regexp_like(ascii_lower(value), glob_expression(glob))


def between_open(value: Column, low: Column, high: Column) -> Column:
    """Inclusive; an open side has no limit; a missing value never matches."""
    asked = low.isNotNull() | high.isNotNull()
    return asked & value.isNotNull() & (value >= F.coalesce(low, value)) & (value <= F.coalesce(high, value))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def matched(objects: DataFrame, rules: DataFrame, condition: Column) -> DataFrame:
    """Objects with each rule that matches. ``rules`` come from one policy
    document that the driver has parsed, so they are few and are broadcast."""
    return objects.join(F.broadcast(rules), condition)


def unmatched(rules: DataFrame, objects: DataFrame, condition: Column) -> DataFrame:
    """Rules that match no object."""
    hit = matched(objects, rules.select("*"), condition).select("rule_ord").distinct()
    return rules.join(F.broadcast(hit), "rule_ord", "left_anti")


def folded(matches: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """For each field the value of the last rule that sets it."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("rule_ord"))).alias(f) for f in fields]
    return matches.groupBy(*keys).agg(*last)


def scaled_gain(gain: Column, scale: Column, db: Column, mute: Column) -> Column:
    """Factor and decibels both apply; a muted object is silent."""
    return F.when(F.coalesce(mute, F.lit(False)), F.lit(0.0)).otherwise(
        gain * F.coalesce(scale, F.lit(1.0)) * F.pow(F.lit(10.0), F.coalesce(db, F.lit(0.0)) / 20)
    )


def limited(value: Column, enabled: Column, scale: Column, most: Column) -> Column:
    """Off is 0; else scaled and kept in [0, most]."""
    scaled = F.greatest(value * F.coalesce(scale, F.lit(1.0)), F.lit(0.0))
    return F.when(~F.coalesce(enabled, F.lit(True)), F.lit(0.0)).otherwise(F.least(scaled, F.coalesce(most, scaled)))


def moved(az: Column, el: Column, dist: Column, rule: dict[str, Column]) -> Column:
    """Absolute position, then offset, then lock; wrapped and clamped.

    ``rule`` may have ``azimuth, elevation, distance, d_azimuth, d_elevation,
    d_distance, lock_azimuth, lock_elevation``.
    """
    get = lambda n: rule.get(n, F.lit(None).cast("double"))
    zero = F.lit(0.0)
    a = F.coalesce(get("lock_azimuth"), F.coalesce(get("azimuth"), az) + F.coalesce(get("d_azimuth"), zero))
    e = F.coalesce(get("lock_elevation"), F.coalesce(get("elevation"), el) + F.coalesce(get("d_elevation"), zero))
    d = F.coalesce(get("distance"), dist) + F.coalesce(get("d_distance"), zero)
    return F.struct(
        wrap_azimuth(a).alias("azimuth"),
        F.least(F.greatest(e, F.lit(-90.0)), F.lit(90.0)).alias("elevation"),
        F.greatest(d, zero).alias("distance"),
    )


def interpolation(jump: Column, length: Column, honor: Column, rate: Column, max_ms: Column) -> Column:
    """``jump, length`` after a rule: jumps dropped, length capped (0 ms caps nothing)."""
    cap = F.when(max_ms > 0, F.floor(rate * max_ms / 1000).cast("long"))
    return F.struct(
        (jump & F.coalesce(honor, F.lit(True))).alias("jump"), F.coalesce(F.least(length, cap), length).alias("length")
    )


def applied_in_order(value: Column, steps: Column, step) -> Column:
    """Fold an array of ``struct<ord, …>`` over a value in order of ``ord``."""
    return F.aggregate(F.array_sort(steps), value, step)
