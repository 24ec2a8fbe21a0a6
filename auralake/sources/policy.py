"""Rule documents: a strict JSON reader that gives a table of rules.

A document has a ``schema`` id, an optional ``global`` rule and an ordered list
``objects`` of rules, whose match fields stand beside their settings. Unknown
keys, wrong types, numbers that are not finite and negative sizes are errors,
and every rule in the list needs a match field.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: what the schema id of a document ends with; a name of its maker stands before it.
SCHEMA = "semantic-policy.v1"
NUMBER, SIZE, FLAG, TEXT, WHOLE = "double", "size", "boolean", "string", "int"

#: The fields of a document.
MATCH = {
    "id": TEXT, "name": TEXT, "name_glob": TEXT, "track_uid": TEXT, "all": FLAG, "importance_min": WHOLE,
    "importance_max": WHOLE, "dialogue_id": WHOLE, "content": TEXT, "programme": TEXT, "pack_format": TEXT,
}
GAIN = {"scale": SIZE, "gain_db": NUMBER, "mute": FLAG}
POSITION = {
    "azimuth": NUMBER, "elevation": NUMBER, "distance": SIZE,
    "offset": {"azimuth": NUMBER, "elevation": NUMBER, "distance": NUMBER}, "lock_azimuth": NUMBER, "lock_elevation": NUMBER,
}
SETTINGS = {
    "diffuse": {"enabled": FLAG, "scale": SIZE, "max": SIZE},
    "extent": {"enabled": FLAG, "scale": SIZE, "width_scale": SIZE, "height_scale": SIZE, "depth_scale": SIZE, "max": SIZE},
    "divergence": {"enabled": FLAG, "scale": SIZE, "range_scale": SIZE, "max_range": SIZE},
    "channel_lock": {"enabled": FLAG, "max_distance": SIZE},
    "interpolation": {"honor_jump_position": FLAG, "max_ms": WHOLE},
    "gain": GAIN,
    "position": POSITION,
    "direct_speakers": {"speaker_label": TEXT, "lfe": FLAG, "gain": GAIN, "position": POSITION},
}


class PolicyError(ValueError):
    """A document that is not valid, with the place of the fault."""


def _value(v, kind: str, where: str):
    if kind == FLAG and isinstance(v, bool) or kind == TEXT and isinstance(v, str):
        return v or None if kind == TEXT else v
    if kind in (NUMBER, SIZE, WHOLE) and isinstance(v, (int, float)) and not isinstance(v, bool):
        if not math.isfinite(v) or kind == WHOLE and v != int(v):
            raise PolicyError(f"{where}: {v!r} is not a {'whole ' * (kind == WHOLE)}finite number")
        if kind == SIZE and v < 0:
            raise PolicyError(f"{where}: {v!r} is below 0")
        return int(v) if kind == WHOLE else float(v)
    raise PolicyError(f"{where}: {v!r} is not a {kind}")


def _checked(d, known, where: str) -> dict:
    if not isinstance(d, dict):
        raise PolicyError(f"{where}: not an object")
    for k in d:
        if k not in known:
            raise PolicyError(f"{where}: unknown key {k!r}")
    return d


def _fields(d: dict, spec: dict, where: str, name: str) -> dict:
    """The fields of a section by their flat names; those inside another section too."""
    out = {}
    for k, kind in spec.items():
        if isinstance(kind, dict):
            inner = _checked(d[k], kind, f"{where}.{k}") if k in d else {}
            out |= _fields(inner, kind, f"{where}.{k}", f"{name}{k}_")
        else:
            out[name + k] = _value(d[k], kind, f"{where}.{k}") if k in d else None
    return out


def _rule(d: dict, ord_: int, where: str, has_match: bool) -> dict:
    _checked(d, {**(MATCH if has_match else {}), **SETTINGS}, where)
    row = {"rule_ord": ord_} | _fields(d if has_match else {}, MATCH, where, "")
    if has_match and all(row[k] is None for k in MATCH):
        raise PolicyError(f"{where}: no match field")
    return row | _fields(d, SETTINGS, where, "")


def flat(spec: dict, name: str = "") -> dict[str, str]:
    """Flat names and Spark types of fields."""
    out = {}
    for k, kind in spec.items():
        out |= flat(kind, f"{name}{k}_") if isinstance(kind, dict) else {name + k: NUMBER if kind == SIZE else kind}
    return out


def columns() -> dict[str, str]:
    return {"rule_ord": "int", **flat(MATCH), **flat(SETTINGS)}


def parse(text: str) -> list[dict]:
    """The rules of a document in order; the global one has ``rule_ord`` -1."""
    try:
        doc = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(PolicyError(f"{c} is not a number")))
    except json.JSONDecodeError as e:
        raise PolicyError(str(e)) from e
    _checked(doc, ("schema", "global", "objects"), "document")
    schema = doc.get("schema")
    if not isinstance(schema, str) or schema.partition(".")[2] != SCHEMA:
        raise PolicyError(f"schema {schema!r} does not end with {SCHEMA!r}")
    rules = doc.get("objects", [])
    if not isinstance(rules, list):
        raise PolicyError("objects: not a list")
    out = [_rule(doc["global"], -1, "global", False)] if "global" in doc else []
    return out + [_rule(r, k, f"objects[{k}]", True) for k, r in enumerate(rules)]


def rules_table(spark: SparkSession, text: str) -> DataFrame:
    schema = ", ".join(f"`{k}` {kind}" for k, kind in columns().items())
    return spark.createDataFrame([tuple(r[k] for k in columns()) for r in parse(text)], schema)


def template(maker: str = "auralake") -> dict:
    """A document whose global rule changes nothing: what forces a value by
    being there (mute, absolute positions, locks) is left out."""
    gain = {"scale": 1.0, "gain_db": 0.0}
    position = {"offset": {"azimuth": 0.0, "elevation": 0.0, "distance": 0.0}}
    return {
        "schema": f"{maker}.{SCHEMA}",
        "global": {
            "diffuse": {"enabled": True, "scale": 1.0, "max": 1.0},
            "extent": {"enabled": True, "scale": 1.0, "width_scale": 1.0, "height_scale": 1.0, "depth_scale": 1.0, "max": 1.0},
            "divergence": {"enabled": True, "scale": 1.0, "range_scale": 1.0, "max_range": 120.0},
            "interpolation": {"honor_jump_position": True, "max_ms": 0},
            "gain": gain, "position": position, "direct_speakers": {"gain": gain, "position": position},
        },
        "objects": [],
    }
