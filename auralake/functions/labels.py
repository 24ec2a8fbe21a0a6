"""Names: labels, globs, stems and identifiers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)


def same_name(a: Column, b: Column) -> Column:
    """Equal but for the case of ASCII letters."""
    return ascii_lower(a) == ascii_lower(b)


def glob_pattern(glob: str) -> str:
    """A regular expression for ``*`` and ``?``; nothing else is special."""
    parts = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(parts.get(c) or re.escape(c) for c in glob.translate(str.maketrans(_UPPER, _LOWER))) + "$"


def matches_glob(c: Column, glob: str | None) -> Column:
    """Whole string, case of ASCII letters aside; an empty glob matches nothing."""
    return ascii_lower(c).rlike(glob_pattern(glob)) if glob else F.lit(False)


def canonical_label(c: Column) -> Column:
    return ascii_upper(F.regexp_replace(c, "[^0-9A-Za-z+-]", ""))


def label_key(c: Column) -> Column:
    return ascii_upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def label_direction(c: Column) -> Column:
    """``azimuth, elevation`` of a label such as ``U-045``; null for others."""
    pattern = r"^([MUTB])([+-][0-9.]{3,})$"
    layer = F.regexp_extract(c, pattern, 1)
    el = F.when(layer == "M", 0.0).when(layer == "U", 30.0).when(layer == "T", 90.0).when(layer == "B", -30.0)
    az = F.regexp_extract(c, pattern, 2).try_cast("double")
    return F.when(az.isNotNull(), F.struct(az.alias("azimuth"), el.alias("elevation")))


def is_low_frequency(labels: Column, low_pass: Column) -> Column:
    """A renderer's notion: a low-pass filter, or a label that says so."""
    key = lambda x: label_key(x)
    named = F.exists(labels, lambda x: key(x).rlike("LFE|SUB|LOWFREQUENCY") | (key(x) == "LF"))
    return low_pass.isNotNull() | F.coalesce(named, F.lit(False))


def track_uid(c: Column) -> Column:
    """Upper case, without padding and NULs at the end."""
    return ascii_upper(F.regexp_replace(c, r"[\s\x00]+$", ""))


def stem_and_side(c: Column) -> Column:
    """``stem, side`` of names such as ``Piano L`` or ``Piano_r``; null for others."""
    pattern = r"(?s)^(.*)[ _-]([LRlr])$"
    side = ascii_upper(F.regexp_extract(c, pattern, 2))
    return F.when(side != "", F.struct(F.regexp_extract(c, pattern, 1).alias("stem"), side.alias("side")))


def boundary_prefixes(c: Column) -> Column:
    """All prefixes that end with a separator."""
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda i: F.substr(c, i, F.lit(1)).rlike("[_ /-]"))
    return F.transform(ends, lambda i: F.substr(c, F.lit(1), i))


def listed(c: Column) -> Column:
    """Trimmed, non-empty items of a comma-separated list."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def render_comment(renderer: Column, layout: Column, loudness: Column, peak: Column) -> Column:
    return F.concat_ws(
        " ",
        F.concat(F.lit("renderer="), renderer),
        F.concat(F.lit("layout="), layout),
        F.when(loudness.isNotNull(), F.format_string("loudness=%.1fLUFS", loudness)),
        F.when(peak.isNotNull(), F.format_string("peak=%.2fdBTP", peak)),
    )


#: Azimuth and elevation of the labels that binaural rendering knows. It does not parse others.
BINAURAL_DIRECTIONS = [
    ("M+000", 0, 0), ("M+030", 30, 0), ("M-030", -30, 0), ("M+060", 60, 0), ("M-060", -60, 0), ("M+090", 90, 0), ("M-090", -90, 0),
    ("M+110", 110, 0), ("M-110", -110, 0), ("M+135", 135, 0), ("M-135", -135, 0), ("M+180", 180, 0),
    ("U+030", 30, 30), ("U-030", -30, 30), ("U+000", 0, 30), ("U+045", 45, 30), ("U-045", -45, 30), ("U+110", 110, 30), ("U-110", -110, 30),
    ("U+135", 135, 30), ("U-135", -135, 30), ("U+180", 180, 30), ("T+000", 0, 90), ("B+045", 45, -30), ("B-045", -45, -30),
]
