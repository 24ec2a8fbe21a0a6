"""Blocks on a timeline: which one is active at a frame, for how long, and how
its gain ramps in.

Two rules exist for blocks that overlap. *Last start wins*: a block ends where
the next one of its key starts, and nothing sounds after its own end. *First not
ended wins*: a block plays to its own end, and the next one waits. An open end
is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = 2**63 - 1


def open_end(end: Column) -> Column:
    return F.coalesce(end, F.lit(OPEN))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit(OPEN))


def last_start_wins(blocks: DataFrame, key: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """Adds ``eff_end`` and ``active`` (length, at least 0)."""
    w = Window.partitionBy(*key).orderBy(start, *ties)
    eff = F.least(open_end(F.col(end)), F.coalesce(F.lead(start).over(w), F.lit(OPEN)))
    return blocks.withColumn("eff_end", eff).withColumn("active", F.greatest(F.lit(0), F.col("eff_end") - F.col(start)))


def first_not_ended_wins(blocks: DataFrame, key: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """Adds ``eff_start``; blocks that never get their turn go."""
    w = Window.partitionBy(*key).orderBy(start, *ties).rowsBetween(Window.unboundedPreceding, -1)
    eff = F.greatest(F.col(start), F.max(open_end(F.col(end))).over(w))
    return blocks.withColumn("eff_start", eff).filter(F.col("eff_start") < open_end(F.col(end)))


def ramped(blocks: DataFrame, key: list[str], start: str, ties: list[str], gain: str, length: Column, jump: Column) -> DataFrame:
    """Adds ``prev_gain`` and ``ramp`` (frames): none for a first or jumping
    block, else ``length`` but not beyond the block's active length."""
    w = Window.partitionBy(*key).orderBy(start, *ties)
    first = F.row_number().over(w) == 1
    return blocks.withColumn("prev_gain", F.coalesce(F.lag(gain).over(w), F.col(gain))).withColumn(
        "ramp", F.when(first | jump, F.lit(0)).otherwise(F.least(length, F.col("active")))
    )


def ramp_value(frame: Column, start: Column, ramp: Column, before: Column, after: Column) -> Column:
    """Linear from the gain before, at ``start``, to the gain after."""
    alpha = F.when(ramp > 0, F.least((frame - start) / ramp, F.lit(1.0))).otherwise(F.lit(1.0))
    return before * (1 - alpha) + after * alpha


def active_at(blocks: DataFrame, frames: DataFrame, key: list[str], frame: str, start: str, end: str, bucket: int) -> DataFrame:
    """The block that is active at each frame; ``blocks`` of a key do not overlap
    (``last_start_wins``), their ends may be open.

    The last block that starts at or before a frame is found among the blocks
    that start in the frame's bucket of ``bucket`` frames; the one that started
    last before a bucket is carried into it. So a row is never copied, and what
    is ordered together is one bucket of a key and its row a bucket.
    """
    columns = [c for c in blocks.columns if c not in key]
    block = F.struct(*(F.col(c) for c in columns))
    own = blocks.filter(F.col(start) < open_end(F.col(end))).select(*key, F.col(start).alias("_at"), block.alias("_b"))
    asked = frames.select(*key, F.col(frame).alias("_at"), F.struct(*(F.col(c) for c in frames.columns if c not in key)).alias("_f"))
    both = own.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / bucket))
    # one row for each bucket of a key that has any: its last block, then the last one before it
    last = both.groupBy(*key, "_bucket").agg(F.max_by("_b", F.when(F.col("_b").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*key, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy(*key, "_bucket").orderBy("_at", F.col("_f").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_b", ignorenulls=True).over(within)).filter("_f IS NOT NULL")
    hit = found.join(carried, [*key, "_bucket"]).withColumn("_hit", F.coalesce("_own", "_carried"))
    return hit.filter(F.col("_hit").isNotNull() & (F.col("_at") < open_end(F.col(f"_hit.{end}")))).select(*key, "_f.*", *(F.col(f"_hit.{c}").alias(c) for c in columns))


def clipped(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """The part of a block inside a window: ``start, end``; null if there is none."""
    s, e = F.greatest(start, lo), F.least(end, hi)
    return F.when(s < e, F.struct(s.alias("start"), e.alias("end")))


def steady(blocks: DataFrame, key: list[str], start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    """Whether one block covers all of ``[lo, hi)`` of a key."""
    touching = blocks.filter((F.col(start) < hi) & (open_end(F.col(end)) > lo))
    return touching.groupBy(*key).agg(
        ((F.count(F.lit(1)) == 1) & (F.min(start) <= F.min(lo)) & (F.max(open_end(F.col(end))) >= F.min(hi))).alias("steady")
    )


def nanos_to_samples(nanos: Column, rate: Column) -> Column:
    """Nearest sample, half up; times before 0 are 0."""
    whole, rest = F.floor(nanos / 1_000_000_000).cast("long"), F.pmod(nanos, F.lit(1_000_000_000))
    return F.when(nanos < 0, F.lit(0)).otherwise(
        whole * rate + F.floor((rest * rate + 500_000_000) / 1_000_000_000).cast("long")
    )


def default_ramp(rate: Column, ms: int = 5) -> Column:
    return F.floor(rate * ms / 1000).cast("long")


def trimmed(start_s: Column, end_s: Column, rate: Column, frames: Column) -> Column:
    """``start, end`` in frames of a window in seconds; an open end is the last
    frame. Null where there is nothing to keep: a negative start, an end at or
    before it, a start beyond the signal, or less than one frame."""
    nearest = lambda s: F.floor(s * rate + 0.5).cast("long")  # noqa: E731  half away from 0, as times are not negative
    lo, hi = nearest(start_s), F.least(F.coalesce(nearest(end_s), frames), frames)
    valid = (start_s >= 0) & (end_s.isNull() | (end_s > start_s)) & (lo < frames) & (lo < hi)
    return F.when(valid, F.struct(lo.alias("start"), hi.alias("end")))


def smoothed(first: Column, last: Column, at: Column, frames: Column, plain: Column) -> Column:
    """The gain inside a processing block of ``frames``: linear from its first to
    its last frame where both are known, else ``plain``."""
    alpha = F.when(frames > 1, at / (frames - 1)).otherwise(F.lit(0.0))
    return F.when(first.isNotNull() & last.isNotNull(), first * (1 - alpha) + last * alpha).otherwise(plain)


def keyframed(time: Column, at: Column, length: Column, before: Column, value: Column) -> Column:
    """The value at ``time`` of a keyframe at ``at`` that is reached over ``length``
    from the one ``before`` it (null: the first). A time before the first has its value."""
    part = (time - at) / length
    moving = before.isNotNull() & (length > 0) & (part < 1)
    a = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    return F.when(moving, before * (1 - a) + value * a).otherwise(value)
