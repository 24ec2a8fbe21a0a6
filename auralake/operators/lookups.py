"""Lookups: chains of keys, prioritised names, nearest neighbours, pairs."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_hit(candidates: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The first candidate of each key in ``order``."""
    best = F.min_by(F.struct(*value), F.struct(*order)).alias("_hit")
    return candidates.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_hit.{v}").alias(v) for v in value))


def nearest(points: DataFrame, places: DataFrame, gap: Column, place: str, ord_: str, digits: int = 9) -> DataFrame:
    """Each point with its nearest place; ties go to the first.

    ``places`` are the speakers of a layout (at most a few dozen rows of a
    registered table). They are gathered into one array, so a point meets them in its own
    row: no pairs are made and nothing is shuffled but the points' own rows.
    """
    table = places.agg(F.array_sort(F.collect_list(F.struct(ord_, *[c for c in places.columns if c != ord_]))).alias("_places"))
    with_gap = points.join(F.broadcast(table)).withColumn(
        "_best", F.array_min(F.transform("_places", lambda p: F.struct(F.round(gap(p), digits).alias("gap"), p[ord_].alias("ord"), p[place].alias("place"))))
    )
    return with_gap.select(*points.columns, F.col("_best.place").alias(place), F.col("_best.gap").alias("gap"))


def nearest_within(points: DataFrame, places: DataFrame, gap: Column, place: str, ord_: str, most: Column) -> DataFrame:
    """As ``nearest``, of places that are no low-frequency ones (``is_lfe``), and
    null where the nearest is farther than ``most`` (null: any distance) and a hair."""
    found = nearest(points, places.filter("NOT is_lfe").drop("is_lfe"), gap, place, ord_)
    return found.withColumn(place, F.when(most.isNull() | (F.col("gap") <= most + 1e-4), F.col(place)))


def by_label(df: DataFrame, keys: list[str], label: str, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """``keys, speaker``: a label's own speaker, else the first of its aliases
    that is there. ``known``: ``label`` of each speaker; ``aliases``: ``name,
    label, ord``. Both are registries of a few dozen rows."""
    own = df.select(*keys, F.col(label).alias("name"))
    exact = own.join(F.broadcast(known.select(F.col("label").alias("name"), F.col("label").alias("speaker"))), "name").withColumn("ord", F.lit(-1))
    there = aliases.join(known.select("label"), "label", "left_semi").withColumnRenamed("label", "speaker")
    other = own.join(F.broadcast(there), "name").select("name", *keys, "speaker", "ord")
    return first_hit(exact.unionByName(other), keys, ["ord"], ["speaker"])


def chained(start: DataFrame, hops: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins one after another; a missing hop leaves null."""
    for df, key in hops:
        start = start.join(df, key, "left")
    return start


def with_fallback(resolved: DataFrame, keys: list[str], fallback: DataFrame) -> DataFrame:
    """Rows of the chain, and the fallback's for keys that it does not have."""
    rest = fallback.join(resolved.select(*keys).distinct(), keys, "left_anti")
    return resolved.unionByName(rest, allowMissingColumns=True)


def least_start(edges: DataFrame, roots: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Smallest accumulated start of every node reached from ``roots``.

    ``edges``: ``parent, child, offset``; ``roots``: ``node, start``. Relaxes
    until nothing gets smaller, in each round only from nodes that got smaller
    in the one before; each round is written out, so a long chain neither grows
    the plan nor recomputes what a lost executor held, and so are the edges.
    """
    spark = roots.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="auralake-"))
    edges = edges.select("parent", "child", "offset").checkpoint()
    found = [roots.groupBy("node").agg(F.min("start").alias("start")).checkpoint()]
    for _ in range(most_rounds):
        near = found[-1].join(edges, F.col("node") == F.col("parent")).groupBy("child").agg(F.min(F.col("start") + F.col("offset")).alias("start"))
        known = reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("start").alias("was"))
        less = near.join(known, F.col("child") == F.col("node"), "left").filter("start IS NOT NULL AND (was IS NULL OR start < was)")
        less = less.select(F.col("child").alias("node"), "start").checkpoint()
        if less.isEmpty():
            return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("start").alias("start"))
        found.append(less)
    raise ValueError("the objects form a cycle, or are nested too deep")


def kth_pairs(df: DataFrame, stem: str, side: str, ord_: str, left="L", right="R", singles: bool = False) -> DataFrame:
    """Pairs the k-th left with the k-th right row of each stem in list order;
    with ``singles`` those without a partner stay, the other side null."""
    w = Window.partitionBy(stem, side).orderBy(ord_)
    ranked = df.withColumn("_k", F.row_number().over(w))
    a = ranked.filter(F.col(side) == left).select(stem, "_k", F.col(ord_).alias("left_ord"))
    b = ranked.filter(F.col(side) == right).select(stem, "_k", F.col(ord_).alias("right_ord"))
    return a.join(b, [stem, "_k"], "full" if singles else "inner").drop("_k")


def changed_fields(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``keys, field, was, is`` for each field that differs (null-safe)."""
    joined = before.alias("b").join(after.alias("a"), keys)
    each = F.array(*(
        F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("was"), F.col(f"a.{f}").cast("string").alias("is"))
        for f in fields
    ))
    rows = joined.select(*keys, F.explode(each).alias("d")).select(*keys, "d.*")
    return rows.filter(~F.col("was").eqNullSafe(F.col("is")))


def mirror_groups(channels: DataFrame, bed: list[str], ord_: str, az: str, el: str, tolerance: float = 1.0) -> DataFrame:
    """Channels of a bed as groups: ``bed, left_ord, right_ord``.

    In list order, a channel off the middle takes the first one after it at the
    opposite azimuth and the same elevation, to less than ``tolerance`` degrees,
    that is still free; what finds no partner, or has no position, is alone
    (``right_ord`` null). A bed is one object's channels, a few dozen at most:
    they are one row, in which a fold keeps those that are still free.
    """
    lists = channels.groupBy(*bed).agg(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), F.col(az).alias("a"), F.col(el).alias("e")))).alias("_c"))

    def paired(state: Column, first: Column) -> Column:
        rest = F.slice(state["free"], 2, F.size("_c"))
        near = lambda y: (F.abs(first["a"] + y["a"]) < tolerance) & (F.abs(first["e"] - y["e"]) < tolerance)
        at = F.array_position(F.transform(rest, lambda y: F.coalesce(near(y), F.lit(False))), True)
        off = F.coalesce(F.abs(first["a"]) > tolerance, F.lit(False))

        def taken(k: Column) -> Column:
            other = F.when(k > 0, F.get(rest, (k - 1).cast("int"))["o"])
            left, right = F.when((k == 0) | (first["a"] >= 0), first["o"]).otherwise(other), F.when((k == 0) | (first["a"] >= 0), other).otherwise(first["o"])
            free = F.filter(rest, lambda _, i: i != k - 1)
            return F.struct(free.alias("free"), F.concat(state["out"], F.array(F.struct(left.alias("left_ord"), right.alias("right_ord")))).alias("out"))

        return F.transform(F.array(F.when(off, at).otherwise(F.lit(0).cast("long"))), taken)[0]

    kind = channels.schema[ord_].dataType.simpleString()
    none = F.array().cast(f"array<struct<left_ord: {kind}, right_ord: {kind}>>")
    step = lambda state, x: F.when(F.get(state["free"], F.lit(0))["o"].eqNullSafe(x["o"]), paired(state, x)).otherwise(state)
    found = F.aggregate("_c", F.struct(F.col("_c").alias("free"), none.alias("out")), step)["out"]
    return lists.select(*bed, F.explode(found).alias("g")).select(*bed, "g.left_ord", "g.right_ord")


def overriding(overrides: DataFrame, keys: list[str], label: str, ord_: str, values: list[str]) -> DataFrame:
    """Of each key the override that counts: one for its channel beats one for
    the whole object (``label`` null); of a kind the last in the list."""
    rank = F.struct(F.col(label).isNotNull(), F.col(ord_))
    best = overrides.groupBy(*keys).agg(F.max_by(F.struct(*values), rank).alias("_o"))
    return best.select(*keys, *(F.col(f"_o.{v}").alias(v) for v in values))


def padded_slots(events: DataFrame, track: list[str], block: list[str], slot: str, parts: int | None = None) -> DataFrame:
    """Every block of a track with as many slots as its fullest block; those that
    it lacks are rows with nulls (``silent``). ``parts``: partitions that the slots
    are dealt over, so that a task sorts a bounded number of them."""
    most = events.groupBy(*track).agg((F.max(slot) + 1).alias("_n"))
    every = events.select(*track, *block).distinct().join(most, track)
    every = every.withColumn(slot, F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")))).drop("_n")
    marked = events.withColumn("_real", F.lit(True))
    if parts:
        every, marked = (df.repartition(parts, *track, *block, slot) for df in (every, marked))
    return every.join(marked, [*track, *block, slot], "left").withColumn("silent", F.col("_real").isNull()).drop("_real")
