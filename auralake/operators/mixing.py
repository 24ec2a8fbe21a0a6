"""Gain matrices and channel orders."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: out[i] = in[PERMUTATION[i]]: rear and side pairs of a 7.1 bed change places
SWAP_REAR_SIDE = [0, 1, 2, 3, 6, 7, 4, 5]


def permuted(channels: Column, order: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(channels, i))


def mixed(samples: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """``sum(value * gain)`` for each of ``keys`` and ``out_ch``.

    ``samples``: ``keys, in_ch, value``; ``matrix``: ``in_ch, out_ch, gain``, the
    channels of one device, so it is broadcast. Gains of 0 are dropped first.
    """
    used = matrix.filter("gain <> 0")
    return samples.join(F.broadcast(used), "in_ch").groupBy(*keys, "out_ch").agg(F.sum(F.col("value") * F.col("gain")).alias("mix"))


def mixed_blocks(blocks: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Interleaved blocks through a matrix (inputs x outputs), a block a row;
    samples are never exploded. ``blocks``: the columns of ``PCM_BLOCKS``."""
    m = np.array(matrix, np.float64)
    at = blocks.columns.index("samples")

    def run(batches):
        for batch in batches:
            out = [
                (np.array(x.as_py(), np.float64).reshape(-1, m.shape[0]) @ m).astype(np.float32).reshape(-1)
                for x in batch.column(at)
            ]
            batch = batch.set_column(at, "samples", pa.array(out, pa.list_(pa.float32())))
            k = batch.schema.names.index("channels")
            yield batch.set_column(k, "channels", pa.array([m.shape[1]] * batch.num_rows, pa.int32()))

    return blocks.mapInArrow(run, blocks.schema)


def stereo_fold(speakers: list[tuple[float, bool]]) -> list[list[float]]:
    """Constant-power pan of (azimuth, is_lfe) speakers to left and right."""
    out = []
    for az, lfe in speakers:
        if lfe:
            out.append([0.5, 0.5])
            continue
        p = (max(-90.0, min(90.0, az)) + 90.0) / 180.0  # 1 is left
        out.append([math.sin(p * math.pi / 2), math.cos(p * math.pi / 2)])
    return out


def pair_gains(azimuths: list[float], az: float) -> list[float]:
    """Two-dimensional amplitude panning: gains of the speakers of a ring, of
    which the pair around the direction sounds, with unit power."""
    by = sorted(range(len(azimuths)), key=lambda k: azimuths[k] % 360)
    vec = lambda a: (math.cos(math.radians(a)), math.sin(math.radians(a)))
    x, best = vec(az), None
    for i, k in enumerate(by):
        j = by[(i + 1) % len(by)]
        (a, b), (c, d) = vec(azimuths[k]), vec(azimuths[j])
        det = a * d - b * c
        if abs(det) < 1e-9:
            continue
        g, h = (x[0] * d - x[1] * c) / det, (a * x[1] - b * x[0]) / det
        if min(g, h) > -1e-7 and (best is None or min(g, h) > best[0]):
            best = (min(g, h), k, j, max(g, 0.0), max(h, 0.0))
    out = [0.0] * len(azimuths)
    if best:
        _, k, j, g, h = best
        norm = math.hypot(g, h)
        out[k], out[j] = g / norm, h / norm
    else:  # beyond every pair: the nearest speaker
        out[min(range(len(azimuths)), key=lambda k: abs((azimuths[k] - az + 180) % 360 - 180))] = 1.0
    return out


def strongest_three(gains: Column, floor: float = 1e-7) -> Column:
    """The first three gains above ``floor``, scaled to sum 1."""
    kept = F.slice(F.filter(gains, lambda g: g > floor), 1, 3)
    total = F.aggregate(kept, F.lit(0.0).cast("double"), lambda a, g: a + g)
    return F.when(total > 0, F.transform(kept, lambda g: g / total)).otherwise(kept)


def lfe_apart(samples: DataFrame, keys: list[str], low: Column, value: Column) -> DataFrame:
    """``keys, mix, peak``: low-frequency samples stay out of the mix, and are
    metered on their own; the peak is the greater of both."""
    mix, apart = F.sum(F.when(~low, value)), F.max(F.when(low, F.abs(value)))
    out = samples.groupBy(*keys).agg(F.coalesce(mix, F.lit(0.0)).alias("mix"), apart.alias("_low"))
    return out.withColumn("peak", F.greatest(F.abs("mix"), F.coalesce("_low", F.lit(0.0)))).drop("_low")
