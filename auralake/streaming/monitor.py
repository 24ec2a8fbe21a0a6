"""A monitor over streams of blocks: overrides, meters, filters, loops.

Media time is contiguous; a seek starts a new ``epoch`` of a stream, and what
is integrated since a seek is keyed by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.metering import biquad


def latest_overrides(overrides: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """The settings of the highest revision of each key (update mode). State is one row a key."""
    fields = [c for c in overrides.columns if c not in keys]
    return overrides.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(revision)).alias("_o")).select(*keys, "_o.*")


def sliding_levels(stream: DataFrame, keys: list[str], time: str, value: Column, length: str, hop: str, late: str) -> DataFrame:
    """Peak and RMS of sliding windows. The watermark bounds the state; rows later than it are dropped."""
    w = F.window(time, length, hop)
    out = stream.withWatermark(time, late).groupBy(*keys, w.alias("w"))
    return out.agg(F.max(F.abs(value)).alias("peak"), F.sqrt(F.avg(value * value)).alias("rms"), F.count(F.lit(1)).alias("n"))


def looped(frame: Column, start: Column, length: Column) -> Column:
    """A frame inside a loop region."""
    return F.pmod(frame - start, length) + start


def crossfaded(old: Column, new: Column, frame: Column, start: Column, frames: int = 2048) -> Column:
    """From one rendering to another, linearly, from ``start`` on."""
    a = F.least(F.greatest((frame - start) / frames, F.lit(0.0)), F.lit(1.0))
    return old * (1 - a) + new * a


def filtered_stream(blocks: DataFrame, keys: list[str], order: str, samples: str, coefficients: list[float]) -> DataFrame:
    """A biquad along each channel's blocks; its two state values are kept
    between batches, so any way to cut the stream gives the same samples.

    Blocks of a channel have to come in order; one that is not the next one is
    an error rather than a wrong sample.
    """
    c = np.array(coefficients, np.float64)
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {order} {kinds[order]}, {samples} array<double>"

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s1, s2, last = state.get if state.exists else (0.0, 0.0, -(2**62))
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, x in zip(rows[order], rows[samples]):
            if at <= last:
                raise ValueError(f"block {at} of {key} after block {last}")
            y, (s1, s2) = biquad(np.asarray(x, np.float64), c, (s1, s2))
            out.append((*key, at, y.tolist()))
            last = int(at)
        state.update((s1, s2, last))
        yield pd.DataFrame(out, columns=[*keys, order, samples])

    return blocks.groupBy(*keys).applyInPandasWithState(
        run, schema, "s1 double, s2 double, last long", "append", GroupStateTimeout.NoTimeout
    )
