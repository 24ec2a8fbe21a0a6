"""Speaker layouts, output layouts and names, as tables.

Layouts that a user registers stand beside the built-in ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Layouts, their speakers in channel order (label, azimuth, elevation).
LAYOUTS = {
    ("0+2+0", "Stereo"): [
        ("M+030", 30, 0), ("M-030", -30, 0),
    ],
    ("0+5+0", "5.1"): [
        ("M+030", 30, 0), ("M-030", -30, 0), ("M+000", 0, 0), ("LFE1", 45, -30), ("M+110", 110, 0), ("M-110", -110, 0),
    ],
    ("2+5+0", "5.1.2"): [
        ("M+030", 30, 0), ("M-030", -30, 0), ("M+000", 0, 0), ("LFE1", 45, -30), ("M+110", 110, 0), ("M-110", -110, 0), ("U+030", 30, 30),
        ("U-030", -30, 30),
    ],
    ("4+5+0", "5.1.4"): [
        ("M+030", 30, 0), ("M-030", -30, 0), ("M+000", 0, 0), ("LFE1", 45, -30), ("M+110", 110, 0), ("M-110", -110, 0), ("U+030", 30, 30),
        ("U-030", -30, 30), ("U+110", 110, 30), ("U-110", -110, 30),
    ],
    ("wav71", "7.1"): [
        ("M+030", 30, 0), ("M-030", -30, 0), ("M+000", 0, 0), ("LFE1", 45, -30), ("M+135", 135, 0), ("M-135", -135, 0), ("M+090", 90, 0),
        ("M-090", -90, 0),
    ],
    ("4+7+0", "7.1.4"): [
        ("M+030", 30, 0), ("M-030", -30, 0), ("M+000", 0, 0), ("LFE1", 45, -30), ("M+090", 90, 0), ("M-090", -90, 0), ("M+135", 135, 0),
        ("M-135", -135, 0), ("U+045", 45, 30), ("U-045", -45, 30), ("U+135", 135, 30), ("U-135", -135, 30),
    ],
    ("4+5+4", "9.1.4"): [
        ("M+030", 30, 0), ("M-030", -30, 0), ("M+000", 0, 0), ("LFE1", 45, -30), ("M+110", 110, 0), ("M-110", -110, 0), ("M+150", 150, 0),
        ("M-150", -150, 0), ("M+070", 70, 0), ("M-070", -70, 0), ("U+070", 70, 45), ("U-070", -70, 45), ("U+150", 150, 45), ("U-150", -150, 45),
    ],
    ("9.1.6", "9.1.6 (Dolby Atmos)"): [
        ("M+030", 30, 0), ("M-030", -30, 0), ("M+000", 0, 0), ("LFE1", 45, -30), ("M+110", 110, 0), ("M-110", -110, 0), ("M+150", 150, 0),
        ("M-150", -150, 0), ("M+070", 70, 0), ("M-070", -70, 0), ("U+070", 70, 45), ("U-070", -70, 45), ("U+110", 110, 45), ("U-110", -110, 45),
        ("U+150", 150, 45), ("U-150", -150, 45),
    ],
    ("9+10+3", "22.2"): [
        ("M+060", 60, 0), ("M-060", -60, 0), ("M+000", 0, 0), ("LFE1", 45, -30), ("M+135", 135, 0), ("M-135", -135, 0), ("M+030", 30, 0),
        ("M-030", -30, 0), ("M+180", 180, 0), ("LFE2", -45, -30), ("M+090", 90, 0), ("M-090", -90, 0), ("U+045", 45, 30), ("U-045", -45, 30),
        ("U+000", 0, 30), ("T+000", 0, 90), ("U+135", 135, 30), ("U-135", -135, 30), ("U+090", 90, 30), ("U-090", -90, 30), ("U+180", 180, 30),
        ("B+000", 0, -30), ("B+045", 45, -30), ("B-045", -45, -30),
    ],
}

# Output layouts of each file format with their channels.
OUTPUT_LAYOUTS = [
    ("wav", "binaural", 2), ("wav", "5.1", 6), ("wav", "5.1.2", 8), ("wav", "7.1", 8), ("wav", "5.1.4", 10), ("wav", "7.1.4", 12),
    ("wav", "9.1.4", 14), ("wav", "9.1.6", 16), ("wav", "22.2", 24), ("wav", "hoa3", 16), ("caf", "binaural", 2), ("caf", "5.1", 6),
    ("caf", "7.1", 8), ("caf", "hoa3", 16), ("caf", "5.1.4", 10), ("caf", "7.1.4", 12), ("caf", "9.1.6", 16), ("caf", "22.2", 24),
    ("flac", "binaural", 2), ("flac", "5.1", 6), ("flac", "7.1", 8), ("apac", "binaural", 2), ("apac", "7.1", 8), ("apac", "hoa3", 16),
    ("apac", "5.1.4", 10), ("apac", "7.1.4", 12), ("apac", "9.1.6", 16), ("apac", "22.2", 24), ("iamf", "5.1", 6), ("iamf", "5.1.2", 8),
    ("iamf", "5.1.4", 10), ("iamf", "7.1", 8), ("iamf", "7.1.4", 12),
]

# Layout a name stands for (names are compared in lower case).
LAYOUT_NAMES = {
    "0+2+0": ["0+2+0", "stereo", "2.0"],
    "0+5+0": ["0+5+0", "5.1"],
    "2+5+0": ["2+5+0", "5.1.2"],
    "wav71": ["wav71", "7.1", "wave_7_1", "wave-7.1", "0+7+0"],
    "4+5+0": ["4+5+0", "5.1.4", "atmos514"],
    "4+5+4": ["4+5+4", "9.1.4"],
    "4+7+0": ["4+7+0", "7.1.4", "atmos714"],
    "9.1.6": ["9.1.6", "atmos916"],
    "9+10+3": ["9+10+3", "22.2"],
    "binaural": ["binaural"],
    "hoa3": ["hoa3"],
}

# Speaker that a loudspeaker label stands for (labels without signs, in upper case).
LABEL_NAMES = [
    ("RCL", "M+030"), ("RCR", "M-030"), ("RCC", "M+000"), ("RCLFE", "LFE1"), ("RCLSS", "M+090"), ("RCRSS", "M-090"), ("RCLRS", "M+135"),
    ("RCRRS", "M-135"), ("RCLTS", "U+090"), ("RCRTS", "U-090"), ("L", "M+030"), ("R", "M-030"), ("C", "M+000"), ("LFE", "LFE1"), ("LFEL", "LFE1"),
    ("LFER", "LFE2"), ("LS", "M+090"), ("RS", "M-090"), ("LSS", "M+090"), ("RSS", "M-090"), ("LRS", "M+135"), ("RRS", "M-135"), ("LB", "M+135"),
    ("RB", "M-135"), ("LW", "M+060"), ("RW", "M-060"), ("CS", "M+180"), ("VHL", "U+045"), ("VHR", "U-045"), ("VHC", "U+000"), ("TSL", "U+090"),
    ("TSR", "U-090"), ("LTM", "U+090"), ("RTM", "U-090"),
]

# Output target, format, container, encoding, format whose layouts it takes (- for any).
TARGETS = [
    ("wav", "wav", "wav", "pcm", "wav"),
    ("caf", "caf", "caf", "pcm", "caf"),
    ("flac", "flac", "flac", "flac", "flac"),
    ("opus_mka", "opus_mka", "mka", "opus", "-"),
    ("apac_mpeg4", "apac", "mpeg4", "apac", "apac"),
    ("apac_caf", "apac", "caf", "apac", "apac"),
    ("iamf", "iamf", "iamf", "iamf_opus", "iamf"),
    ("iamf_mp4", "iamf_mp4", "mp4", "iamf_opus", "iamf"),
]


class Registry:
    """Layouts by id, built-in and registered."""

    def __init__(self):
        self.layouts = {
            (i, name): [(k, label, float(az), float(el), label.startswith("LFE")) for k, (label, az, el) in enumerate(speakers)]
            for (i, name), speakers in LAYOUTS.items()
        }

    def register(self, layout_id: str, name: str, speakers: list[tuple[str, float, float, bool]]) -> None:
        """Add a layout of (label, azimuth, elevation, is_lfe) speakers."""
        if not speakers or all(s[3] for s in speakers):
            raise ValueError("a layout needs a speaker that is not an LFE")
        if any(not (math.isfinite(s[1]) and math.isfinite(s[2])) for s in speakers):
            raise ValueError("a speaker's direction has to be finite")
        if any(i == layout_id for i, _ in self.layouts):
            raise ValueError(f"layout {layout_id!r} exists")
        self.layouts[(layout_id, name)] = [(k, s[0], float(s[1]), float(s[2]), s[3]) for k, s in enumerate(speakers)]

    def speakers(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, *s) for (i, name), each in self.layouts.items() for s in each]
        return spark.createDataFrame(
            rows, "layout_id string, layout_name string, spk_ord int, label string, azimuth double, elevation double, is_lfe boolean"
        )


def output_layouts(spark: SparkSession) -> DataFrame:
    rows = [(k, *row) for k, row in enumerate(OUTPUT_LAYOUTS)]
    return spark.createDataFrame(rows, "ord int, format string, layout string, channels int").withColumn("layout_id", layout_id(F.col("layout")))


def layout_rows(spark: SparkSession, renderers: dict[str, list[str]]) -> DataFrame:
    """``output_layouts`` with ``supported_by``, the renderers of each in the order given."""
    own = spark.createDataFrame([(k, r, i) for k, (r, ids) in enumerate(renderers.items()) for i in ids], "k int, renderer string, layout_id string")
    names = own.groupBy("layout_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "renderer"))), lambda x: x["renderer"]).alias("supported_by"))
    out = output_layouts(spark).join(F.broadcast(names), "layout_id", "left")
    return out.withColumn("supported_by", F.coalesce("supported_by", F.array().cast("array<string>")))


def layouts_of(rows: DataFrame, format_: str, layout: str | None = None, renderer: str | None = None) -> DataFrame:
    """The rows of a format, and of a layout (by any of its names) and a renderer if they are given."""
    out = rows.filter(F.col("format") == format_)
    if layout is not None:
        out = out.filter(F.col("layout_id") == layout_id(F.lit(layout)))
    return out if renderer is None else out.filter(F.array_contains("supported_by", renderer))


def layout_id(name):
    """The id that a layout's name stands for; unknown names pass through."""
    out = name
    for i, names in LAYOUT_NAMES.items():
        out = F.when(F.lower(name).isin(names), F.lit(i)).otherwise(out)
    return F.when(name == "", F.lit("0+2+0")).otherwise(out)


def label_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(LABEL_NAMES)], "name string, label string, ord int")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, *t) for k, t in enumerate(TARGETS)], "ord int, target string, format string, container string, encoding string, layouts_of string"
    )


def layout_summary(speakers: DataFrame) -> DataFrame:
    """Speakers, LFEs and height of each layout."""
    return speakers.groupBy("layout_id").agg(
        F.count(F.lit(1)).alias("channels"), F.count_if("is_lfe").alias("lfe"), F.bool_or(~F.col("is_lfe") & (F.abs("elevation") > 1e-3)).alias("is_3d")
    )


def support_matrix(spark: SparkSession, renderers: dict[str, list[str]], formats: dict[str, tuple[bool, int, bool]]) -> DataFrame:
    """Renderer x layout x target: ``supported``, or the first ``reason`` why not.

    ``renderers``: layout ids that each supports; ``formats``: of each format
    whether it is available, its most channels (0: any) and whether it has
    height. All tables are registries of a few rows.
    """
    own = spark.createDataFrame([(r, i) for r, ids in renderers.items() for i in ids], "renderer string, layout_id string")
    kinds = spark.createDataFrame([(f, *v) for f, v in formats.items()], "format string, available boolean, most int, height boolean")
    rows = output_layouts(spark)
    layouts = rows.groupBy("layout").agg(F.min_by(F.struct("layout_id", "channels"), "ord").alias("l")).select("layout", "l.*")
    layouts = layouts.withColumn("is_3d", F.regexp_like("layout", F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+$|^22\.2$|^hoa")))
    every = own.select("renderer").distinct().crossJoin(F.broadcast(layouts)).crossJoin(F.broadcast(targets(spark))).join(F.broadcast(kinds), "format")
    every = every.join(F.broadcast(own.withColumn("_has", F.lit(True))), ["renderer", "layout_id"], "left")
    defined = rows.select(F.col("format").alias("layouts_of"), "layout", F.lit(True).alias("_row"))
    every = every.join(F.broadcast(defined), ["layouts_of", "layout"], "left")
    reason = (
        F.when(F.col("_has").isNull(), F.lit("renderer"))
        .when(~F.col("available"), F.lit("format"))
        .when((F.col("layouts_of") != "-") & F.col("_row").isNull(), F.lit("target"))
        .when((F.col("most") > 0) & (F.col("channels") > F.col("most")), F.lit("channels"))
        .when(~F.col("height") & F.col("is_3d"), F.lit("height"))
    )
    return every.select("renderer", "layout", "layout_id", "channels", "is_3d", "target", "format", reason.isNull().alias("supported"), reason.alias("reason"))
