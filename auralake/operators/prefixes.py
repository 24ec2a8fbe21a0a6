"""Common prefixes of names, and thinning of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import boundary_prefixes


def dominant_prefix(df: DataFrame, keys: list[str], name: str, share: float = 0.4, least: int = 4) -> DataFrame:
    """The longest prefix (cut after a separator) of at least ``share`` of a
    group's names, two of them and ``least`` characters at least: ``prefix``."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    each = df.select(*keys, F.explode(boundary_prefixes(F.col(name))).alias("prefix"))
    counts = each.filter(F.char_length("prefix") >= least).groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("_c"))
    enough = F.greatest(F.lit(2.0), F.ceil(F.col("_n") * share))
    held = counts.join(sizes, keys).filter(F.col("_c") >= enough)
    return held.groupBy(*keys).agg(F.max(F.struct(F.char_length("prefix").alias("l"), "prefix"))["prefix"].alias("prefix"))


def common_prefix(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The longest prefix of all names of a group, cut after its last separator.

    The least and the greatest name share exactly what all names share, so
    nothing is exploded.
    """
    ends = df.groupBy(*keys).agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.count(F.lit(1)).alias("n"))
    prefixes = F.filter(boundary_prefixes(F.col("lo")), lambda p: F.col("hi").startswith(p))
    return ends.select(*keys, F.when(F.col("n") >= 2, F.coalesce(F.array_max(F.transform(prefixes, lambda p: F.struct(F.char_length(p).alias("l"), p.alias("p"))))["p"], F.lit(""))).otherwise("").alias("prefix"))


def thinned(df: DataFrame, keys: list[str], order: list[str], budget: int, now: Column, span: Column, time: str) -> DataFrame:
    """Every stride-th row of the last ``span``: as many as ``budget`` allows."""
    recent = df.filter((F.col(time) >= now - span) & (F.col(time) <= now))
    w = Window.partitionBy(*keys)
    stride = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) / budget))
    ranked = recent.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("stride", stride)
    return ranked.filter(F.pmod("_k", "stride") == 0).drop("_k")


def ranges(df: DataFrame, keys: list[str], value: str, threshold: float = 1e-4) -> DataFrame:
    """``low, high`` and whether the value moves."""
    out = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return out.withColumn("moves", F.col("high") - F.col("low") > threshold)
