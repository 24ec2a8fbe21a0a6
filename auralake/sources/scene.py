"""Scene descriptions (audio definition model XML) as tables.

A description is parsed by Spark's XML functions with a fixed schema; lists keep
their ordinals. Times are samples; an open end is null.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import track_uid
from ..operators.lookups import chained, least_start, with_fallback
from ..operators.timeline import nanos_to_samples, saturating_add
from .pcm import channel_uids, layout, text_chunk

_POSITION = "array<struct<_coordinate: string, _VALUE: double>>"
_BLOCK = (
    "struct<_audioBlockFormatID: string, _rtime: string, _duration: string, gain: double, diffuse: double, width: double,"
    f" height: double, depth: double, cartesian: int, position: {_POSITION}, speakerLabel: array<string>,"
    " jumpPosition: struct<_VALUE: int, _interpolationLength: double>, objectDivergence: struct<_VALUE: double, _azimuthRange: double>,"
    " channelLock: struct<_VALUE: int, _maxDistance: double>, order: int, degree: int>"
)
SCHEMA = (
    "audioProgramme array<struct<_audioProgrammeID: string, _audioProgrammeName: string, audioContentIDRef: array<string>>>,"
    " audioContent array<struct<_audioContentID: string, _audioContentName: string, audioObjectIDRef: array<string>>>,"
    " audioObject array<struct<_audioObjectID: string, _audioObjectName: string, _start: string, _duration: string, _importance: int,"
    " gain: double, mute: int, audioObjectIDRef: array<string>, audioPackFormatIDRef: array<string>, audioTrackUIDRef: array<string>>>,"
    " audioPackFormat array<struct<_audioPackFormatID: string, _typeDefinition: string, audioChannelFormatIDRef: array<string>>>,"
    f" audioChannelFormat array<struct<_audioChannelFormatID: string, _typeDefinition: string, audioBlockFormat: array<{_BLOCK}>>>,"
    " audioStreamFormat array<struct<_audioStreamFormatID: string, audioChannelFormatIDRef: string>>,"
    " audioTrackFormat array<struct<_audioTrackFormatID: string, audioStreamFormatIDRef: string>>,"
    " audioTrackUID array<struct<_UID: string, audioTrackFormatIDRef: string, audioPackFormatIDRef: string>>"
)


def parsed(files: DataFrame) -> DataFrame:
    """``scene_id, sample_rate, doc`` of rows with ``scene_id, sample_rate, axml``.

    Raises on a description without the model's root element.
    """
    root = F.regexp_extract("axml", r"(?s)<audioFormatExtended\b.*</audioFormatExtended>", 0)
    checked = F.when(root == "", F.raise_error(F.concat(F.lit("no scene description in "), "scene_id")).cast("string")).otherwise(root)
    return files.select("scene_id", "sample_rate", F.from_xml(checked, SCHEMA).alias("doc"))


def nanos(time: Column) -> Column:
    """Nanoseconds of ``hh:mm:ss.fraction``; null for anything else."""
    part = lambda k: F.regexp_extract(time, r"^(\d+):(\d+):(\d+)(?:\.(\d{1,9}))?\d*$", k)
    whole = part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long")
    return whole * 1_000_000_000 + F.rpad(part(4), 9, "0").cast("long")


def samples(time: Column, rate: Column = None) -> Column:
    return nanos_to_samples(nanos(time), F.col("sample_rate") if rate is None else rate)


def _each(docs: DataFrame, part: str, ord_: str) -> DataFrame:
    return docs.select("scene_id", "sample_rate", F.posexplode(f"doc.{part}").alias(ord_, "x"))


def objects(docs: DataFrame) -> DataFrame:
    out = _each(docs, "audioObject", "object_ord").select(
        "scene_id", "sample_rate", "object_ord", F.col("x._audioObjectID").alias("object_id"), F.col("x._audioObjectName").alias("name"),
        F.coalesce(samples(F.col("x._start")), F.lit(0)).alias("own_start"), samples(F.col("x._duration")).alias("duration"),
        F.coalesce("x.gain", F.lit(1.0)).alias("gain"), (F.coalesce("x.mute", F.lit(0)) == 1).alias("mute"), F.col("x._importance").alias("importance"),
        F.col("x.audioObjectIDRef").alias("children"), F.col("x.audioPackFormatIDRef").alias("packs"), F.col("x.audioTrackUIDRef").alias("uids"),
    )
    return out


def started(objs: DataFrame) -> DataFrame:
    """``objects`` with ``start``: the least sum of starts over the objects that
    hold it, its own if none does."""
    node = lambda o: F.concat_ws("\x1f", "scene_id", o)
    held = objs.select("scene_id", F.col("object_id").alias("parent_id"), F.explode("children").alias("object_id"))
    edges = held.join(objs.select("scene_id", "object_id", "own_start"), ["scene_id", "object_id"]).select(
        node("parent_id").alias("parent"), node("object_id").alias("child"), F.col("own_start").alias("offset")
    )
    top = objs.join(held.select("scene_id", "object_id").distinct(), ["scene_id", "object_id"], "left_anti")
    best = least_start(edges, top.select(node("object_id").alias("node"), F.col("own_start").alias("start")))
    keyed = objs.withColumn("node", node("object_id")).join(best, "node", "left")
    return keyed.withColumn("start", F.coalesce("start", "own_start")).drop("node")


def membership(docs: DataFrame) -> DataFrame:
    """``scene_id, object_id, content, programme`` by name; contents that a
    programme names but nobody defines are skipped."""
    content = _each(docs, "audioContent", "c").select(
        "scene_id", F.col("x._audioContentID").alias("content_id"), F.col("x._audioContentName").alias("content"), F.explode("x.audioObjectIDRef").alias("object_id")
    )
    programme = _each(docs, "audioProgramme", "p").select(
        "scene_id", F.col("x._audioProgrammeName").alias("programme"), F.explode("x.audioContentIDRef").alias("content_id")
    )
    return content.join(programme, ["scene_id", "content_id"], "left").select("scene_id", "object_id", "content", "programme")


def tracks(docs: DataFrame, objs: DataFrame, chna: DataFrame) -> DataFrame:
    """``scene_id, object_id, track_ord, uid, channel, channel_format``.

    ``chna``: ``scene_id, uid, channel``. The channel format comes by the track
    and stream formats; where a hop is missing, it is each one of the object's packs.
    """
    own = objs.select("scene_id", "object_id", F.posexplode("uids").alias("track_ord", "uid")).withColumn("uid", track_uid(F.col("uid")))
    uid = _each(docs, "audioTrackUID", "k").select("scene_id", track_uid(F.col("x._UID")).alias("uid"), F.col("x.audioTrackFormatIDRef").alias("tf"), F.col("x.audioPackFormatIDRef").alias("pack"))
    hop = lambda part, key, ref, a, b: _each(docs, part, "k").select("scene_id", F.col(f"x.{key}").alias(a), F.col(f"x.{ref}").alias(b))
    track = hop("audioTrackFormat", "_audioTrackFormatID", "audioStreamFormatIDRef", "tf", "sf")
    stream = hop("audioStreamFormat", "_audioStreamFormatID", "audioChannelFormatIDRef", "sf", "channel_format")
    full = chained(own, [(chna, ["scene_id", "uid"]), (uid, ["scene_id", "uid"]), (track, ["scene_id", "tf"]), (stream, ["scene_id", "sf"])])
    cols = ["scene_id", "object_id", "track_ord", "uid", "channel", "channel_format"]
    found = full.filter("channel_format IS NOT NULL").select(cols)
    packs = _each(docs, "audioPackFormat", "k").select("scene_id", F.col("x._audioPackFormatID").alias("pack"), F.explode("x.audioChannelFormatIDRef").alias("channel_format"))
    by_object = objs.select("scene_id", "object_id", F.explode("packs").alias("of_object"))
    rest = full.filter("channel_format IS NULL").drop("channel_format").join(by_object, ["scene_id", "object_id"], "left")
    rest = rest.withColumn("pack", F.coalesce("pack", "of_object")).join(packs, ["scene_id", "pack"]).select(cols).distinct()
    return with_fallback(found, ["scene_id", "object_id", "track_ord"], rest)


def blocks(docs: DataFrame) -> DataFrame:
    """Block formats of every channel format. Blocks without a position or a label go."""
    x = _each(docs, "audioChannelFormat", "k").select(
        "scene_id", "sample_rate", F.col("x._audioChannelFormatID").alias("channel_format"), F.col("x._typeDefinition").alias("type"), F.posexplode("x.audioBlockFormat").alias("block_ord", "b")
    )
    at = lambda c: F.get(F.filter("b.position", lambda p: F.lower(p["_coordinate"]) == c), F.lit(0))["_VALUE"]
    out = x.select(
        "scene_id", "sample_rate", "channel_format", "type", "block_ord", F.coalesce(samples(F.col("b._rtime")), F.lit(0)).alias("rtime"), samples(F.col("b._duration")).alias("duration"),
        *(at(c).alias(c) for c in ("azimuth", "elevation", "distance", "x", "y", "z")), F.col("b.speakerLabel").alias("labels"), F.coalesce("b.gain", F.lit(1.0)).alias("gain"),
        *(F.coalesce(f"b.{c}", F.lit(0.0)).alias(c) for c in ("diffuse", "width", "height", "depth")), (F.coalesce("b.jumpPosition._VALUE", F.lit(0)) == 1).alias("jump"),
        F.coalesce("b.objectDivergence._VALUE", F.lit(0.0)).alias("divergence"), F.coalesce("b.objectDivergence._azimuthRange", F.lit(45.0)).alias("divergence_range"),
        (F.coalesce("b.channelLock._VALUE", F.lit(0)) == 1).alias("channel_lock"), F.col("b.channelLock._maxDistance").alias("lock_distance"), "b.order", "b.degree",
    )
    placed = F.col("azimuth").isNotNull() | F.col("x").isNotNull() | (F.size("labels") > 0) | F.col("order").isNotNull()
    return out.filter(placed)


def object_blocks(docs: DataFrame, chna: DataFrame) -> DataFrame:
    """Blocks on the scene's timeline, by object and track; the object's start
    is added to theirs and its end clamps them."""
    objs = started(objects(docs))
    t = tracks(docs, objs, chna)
    out = t.join(blocks(docs), ["scene_id", "channel_format"]).join(
        objs.select("scene_id", "object_id", "object_ord", "start", F.col("duration").alias("object_duration"), F.col("gain").alias("object_gain"), "mute"),
        ["scene_id", "object_id"],
    )
    begin = saturating_add(F.col("start"), F.col("rtime"))
    end = F.least(
        F.when(F.col("duration").isNotNull(), saturating_add(begin, F.col("duration"))),
        F.when(F.col("object_duration").isNotNull(), saturating_add(F.col("start"), F.col("object_duration"))),
    )
    return out.withColumns({"start_sample": begin, "end_sample": end}).drop("start", "rtime", "duration", "object_duration")


#: The types that have tables here.
KNOWN_TYPES = ("DirectSpeakers", "HOA", "Objects")


def skipped_types(docs: DataFrame) -> DataFrame:
    """``scene_id, skipped``: the types of channels that an import leaves out, each once, in order."""
    kinds = _each(docs, "audioChannelFormat", "k").select("scene_id", F.col("x._typeDefinition").alias("type"))
    left = kinds.filter(F.col("type").isNotNull() & ~F.col("type").isin(*KNOWN_TYPES))
    return left.groupBy("scene_id").agg(F.array_sort(F.collect_set("type")).alias("skipped"))


def import_scenes(spark: SparkSession, paths: list[str], parts: int | None = None) -> dict[str, DataFrame]:
    """Scene tables of wave files that carry a description: ``files, objects,
    membership, tracks, blocks, skipped``.

    Tasks read the files' metadata chunks, from a folder that all of them see;
    samples are read by the ``pcm`` source. A file without a description is an
    error that names it.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                text = text_chunk(path)
                if text is None:
                    raise ValueError(f"no scene description in {path}")
                at = layout(path)
                uids = [{"uid": u, "channel": c} for u, c in channel_uids(path).items()]
                name = os.path.splitext(os.path.basename(path))[0]
                rows.append({"scene_id": name, "path": path, "sample_rate": at.rate, "channels": at.channels, "frames": at.frames,
                             "axml": text.decode("utf-8").rstrip("\0"), "uids": uids})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([("scene_id", pa.string()), ("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()),
                       ("axml", pa.string()), ("uids", pa.list_(pa.struct([("uid", pa.string()), ("channel", pa.int32())])))])
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(parts or max(1, len(paths)))
    schema = "scene_id string, path string, sample_rate int, channels int, frames long, axml string, uids array<struct<uid: string, channel: int>>"
    files = listed.mapInArrow(run, schema)
    docs = parsed(files)
    chna = files.select("scene_id", F.explode("uids").alias("u")).select("scene_id", "u.uid", "u.channel")
    objs = started(objects(docs))
    return {
        "files": files.drop("axml", "uids"), "objects": objs, "membership": membership(docs), "tracks": tracks(docs, objs, chna),
        "blocks": object_blocks(docs, chna), "skipped": skipped_types(docs),
    }
