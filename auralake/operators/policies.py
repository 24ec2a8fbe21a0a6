"""Rules put to work on scene tables: which objects, packs and speaker blocks
they meet, what they change there, and a report of it.

Objects have ``scene_id, object_ord, object_id, name, uids, contents,
programmes`` (arrays: track UIDs; ids and names of what holds the object),
``importance, dialogue_id, gain, mute``. Rules are the table of
``sources.policy.rules_table``; they come from one document that the driver
parsed, so they are few and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import to_polar
from ..functions.labels import ascii_lower, same_name
from ..sources.policy import SETTINGS, flat
from .rules import any_of, between_open, folded, glob_matches, limited, moved

GLOBAL = -1
#: settings of which the last rule that sets one wins; those of speaker blocks are never merged
MERGED = [c for part, spec in SETTINGS.items() if part != "direct_speakers" for c in flat(spec, f"{part}_")]
SPEAKER = list(flat(SETTINGS["direct_speakers"], "direct_speakers_"))


def _among(values: Column, name: Column) -> Column:
    return F.exists(values, lambda v: ascii_lower(v) == ascii_lower(name))


def object_rule(o: str = "o", r: str = "r") -> Column:
    """A rule meets an object if any of its match fields does."""
    c = lambda side, name: F.col(f"{side}.{name}")
    return any_of(
        c(r, "all"), same_name(c(o, "object_id"), c(r, "id")), same_name(c(o, "name"), c(r, "name")),
        glob_matches(c(o, "name"), c(r, "name_glob")), _among(c(o, "uids"), c(r, "track_uid")),
        between_open(c(o, "importance"), c(r, "importance_min"), c(r, "importance_max")), c(o, "dialogue_id") == c(r, "dialogue_id"),
        _among(c(o, "contents"), c(r, "content")), _among(c(o, "programmes"), c(r, "programme")),
    )


def pack_rule(o: str = "o", r: str = "r") -> Column:
    """Ambisonic packs are met by all, by the id of their object, or by their pack format."""
    c = lambda side, name: F.col(f"{side}.{name}")
    return any_of(c(r, "all"), same_name(c(o, "object_id"), c(r, "id")), same_name(c(o, "pack_format"), c(r, "pack_format")))


def matched(objects: DataFrame, rules: DataFrame, condition: Column, columns: list[str], settings: list[str]) -> DataFrame:
    """``columns`` of each object with the ``settings`` of each rule that meets it; the global rule meets all."""
    met = objects.alias("o").join(F.broadcast(rules.alias("r")), (F.col("r.rule_ord") == GLOBAL) | condition)
    return met.select(*(F.col(f"o.{c}") for c in columns), "r.rule_ord", *(F.col(f"r.{c}") for c in settings))


def effective(objects: DataFrame, rules: DataFrame, keys: list[str], condition: Column | None = None) -> DataFrame:
    """The settings that hold for each object that a rule meets, by ``keys``."""
    condition = object_rule() if condition is None else condition
    return folded(matched(objects, rules, condition, keys, MERGED), keys, MERGED)


def gained(gain: Column, scale: Column, db: Column) -> Column:
    return gain * F.coalesce(scale, F.lit(1.0)) * F.pow(F.lit(10.0), F.coalesce(db, F.lit(0.0)) / 20)


def on_objects(objects: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """``objects`` with ``gain`` and ``mute`` as the rules have them."""
    own = settings.select(*keys, "gain_scale", "gain_gain_db", "gain_mute")
    return objects.join(own, keys, "left").withColumns({
        "gain": gained(F.col("gain"), F.col("gain_scale"), F.col("gain_gain_db")), "mute": F.coalesce("gain_mute", "mute"),
    }).drop("gain_scale", "gain_gain_db", "gain_mute")


def on_packs(packs: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Ambisonic packs: gain and mute only."""
    return on_objects(packs, effective(packs, rules, keys, pack_rule()), keys)


def position_changes(s: dict[str, Column]) -> Column:
    """Whether an absolute or locked value or an offset other than 0 is there."""
    absolute = any_of(*(s[k].isNotNull() for k in ("azimuth", "elevation", "distance", "lock_azimuth", "lock_elevation")))
    return absolute | any_of(*(s[f"offset_{k}"] != 0 for k in ("azimuth", "elevation", "distance")))


def _moved(az: Column, el: Column, dist: Column, s: dict[str, Column]) -> Column:
    names = {k.replace("offset_", "d_"): v for k, v in s.items()}
    return moved(az, el, dist, names)


def locked(lock: Column, distance: Column, enabled: Column, most: Column) -> Column:
    """``lock, distance``: switching it off clears its distance; a distance counts only where it is on."""
    on = F.coalesce(enabled, lock)
    kept = F.when(~F.coalesce(enabled, F.lit(True)), F.lit(None)).otherwise(distance)
    return F.struct(on.alias("lock"), F.when(on & most.isNotNull(), most).otherwise(kept).alias("distance"))


def on_blocks(blocks: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """Object blocks as the rules of their object have them.

    Blocks have ``diffuse, width, height, depth, divergence, divergence_range,
    channel_lock, lock_distance, jump, interp_length, sample_rate`` and a position:
    ``cartesian`` and ``x, y, z``, or ``azimuth, elevation, distance``.
    A position that is changed is polar afterwards; any other stays as it is.
    """
    s = lambda name: F.col(f"_s.{name}")
    inner = settings.select(*keys, F.struct(*MERGED).alias("_s"))
    sized = lambda c, own: F.when(
        any_of(*(s(f"extent_{k}").isNotNull() for k in SETTINGS["extent"])),
        limited(F.col(c), s("extent_enabled"), F.coalesce(s("extent_scale"), F.lit(1.0)) * F.coalesce(s(own), F.lit(1.0)), F.coalesce(s("extent_max"), F.lit(1.0))),
    ).otherwise(F.col(c))
    has = lambda part: any_of(*(s(c).isNotNull() for c in flat(SETTINGS[part], f"{part}_")))
    position = {k.removeprefix("position_"): s(k) for k in flat(SETTINGS["position"], "position_")}
    now = to_polar(F.col("x"), F.col("y"), F.col("z"))
    at = {c: F.when(F.col("cartesian"), now[c]).otherwise(F.col(c)) for c in ("azimuth", "elevation", "distance")}
    off = ~F.coalesce(s("divergence_enabled"), F.lit(True))
    spread = F.least(F.greatest(F.col("divergence_range") * F.coalesce(s("divergence_range_scale"), F.lit(1.0)), F.lit(0.0)), F.coalesce(s("divergence_max_range"), F.lit(120.0)))
    cap = F.when(s("interpolation_max_ms") > 0, F.floor(F.col("sample_rate") * s("interpolation_max_ms") / 1000).cast("long"))
    out = blocks.join(inner, keys, "left").withColumns({
        "_moves": F.coalesce(position_changes(position), F.lit(False)),
        "_lock": locked(F.col("channel_lock"), F.col("lock_distance"), s("channel_lock_enabled"), s("channel_lock_max_distance")),
        "_at": _moved(at["azimuth"], at["elevation"], at["distance"], position),
    })
    to = lambda c: F.when(F.col("_moves"), F.col(f"_at.{c}")).otherwise(F.col(c))
    return out.withColumns({
        "diffuse": F.when(has("diffuse"), limited(F.col("diffuse"), s("diffuse_enabled"), s("diffuse_scale"), F.coalesce(s("diffuse_max"), F.lit(1.0)))).otherwise(F.col("diffuse")),
        **{c: sized(c, f"extent_{c}_scale") for c in ("width", "height", "depth")},
        "divergence": F.when(has("divergence"), limited(F.col("divergence"), s("divergence_enabled"), s("divergence_scale"), F.lit(1.0))).otherwise(F.col("divergence")),
        "divergence_range": F.when(has("divergence") & ~off, spread).otherwise(F.col("divergence_range")),
        "channel_lock": F.col("_lock.lock"), "lock_distance": F.col("_lock.distance"),
        "jump": F.col("jump") & F.coalesce(s("interpolation_honor_jump_position"), F.lit(True)),
        "interp_length": F.when(F.col("interp_length").isNotNull(), F.least("interp_length", cap)),
        **{c: to(c) for c in ("azimuth", "elevation", "distance")},
        "cartesian": F.col("cartesian") & ~F.col("_moves"),
    }).drop("_s", "_moves", "_lock", "_at")


def speaker_policies(objects: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, policies``: the rules for speaker blocks of each object, in order; never merged,
    as each has a filter of its own. An object has at most as many as the document."""
    own = matched(objects, rules, object_rule(), keys, SPEAKER).filter(F.coalesce(*(F.col(c).cast("string") for c in SPEAKER)).isNotNull())
    step = F.struct("rule_ord", *(F.col(c).alias(c.removeprefix("direct_speakers_")) for c in SPEAKER))
    return own.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("policies"))


def on_speaker_blocks(blocks: DataFrame, policies: DataFrame, keys: list[str]) -> DataFrame:
    """Speaker blocks (``speaker_labels, low_pass_hz, gain, azimuth, elevation,
    distance, has_position``) after each policy in turn whose label and LFE
    filters both let it through. Muted is a gain of 0."""
    state = F.struct(
        *(F.col(c).cast("double").alias(c) for c in ("gain", "azimuth", "elevation", "distance")), F.col("has_position")
    )

    def step(b: Column, p: Column) -> Column:
        label = p["speaker_label"].isNull() | F.coalesce(_among(F.col("speaker_labels"), p["speaker_label"]), F.lit(False))
        hit = label & (p["lfe"].isNull() | (p["lfe"] == F.col("low_pass_hz").isNotNull()))
        gain = F.when(F.coalesce(p["gain_mute"], F.lit(False)), F.lit(0.0)).otherwise(gained(b["gain"], p["gain_scale"], p["gain_gain_db"]))
        s = {k.removeprefix("position_"): p[k] for k in flat(SETTINGS["position"], "position_")}
        moves = hit & position_changes(s)
        to = _moved(b["azimuth"], b["elevation"], b["distance"], s)
        return F.struct(
            F.when(hit, gain).otherwise(b["gain"]).alias("gain"),
            *(F.when(moves, to[c]).otherwise(b[c]).alias(c) for c in ("azimuth", "elevation", "distance")),
            (b["has_position"] | moves).alias("has_position"),
        )

    out = blocks.join(policies, keys, "left").withColumn("_b", F.coalesce(F.aggregate("policies", state, step), state))
    return out.withColumns({c: F.col(f"_b.{c}") for c in ("gain", "azimuth", "elevation", "distance", "has_position")}).drop("_b", "policies")


def report(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str], matches: DataFrame) -> DataFrame:
    """``keys, rules, changes``: the names of the rules that met each object and
    what is different after them, by place in the two tables."""
    same = [F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("was"), F.col(f"a.{f}").cast("string").alias("is")) for f in fields]
    both = before.alias("b").join(after.alias("a"), keys)
    changes = both.select(*keys, F.filter(F.array(*same), lambda d: ~d["was"].eqNullSafe(d["is"])).alias("changes"))
    name = F.when(F.col("rule_ord") == GLOBAL, F.lit("global")).otherwise(F.concat(F.lit("objects["), F.col("rule_ord"), F.lit("]")))
    names = F.transform(F.array_sort(F.collect_list(F.struct("rule_ord", name.alias("name")))), lambda x: x["name"])
    met = matches.groupBy(*keys).agg(names.alias("rules"))
    return changes.join(met, keys, "left").select(*keys, F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), "changes")
