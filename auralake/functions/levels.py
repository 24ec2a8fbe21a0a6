"""Gains and levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def decibels(gain: Column) -> Column:
    return F.when(gain > 0, 20 * F.log10(gain))


def device_decibels(gain: Column) -> Column:
    """Clamped to -120 … 20 dB; next to nothing is -120."""
    db = F.least(F.greatest(20 * F.log10(F.greatest(gain, F.lit(1e-6))), F.lit(-120.0)), F.lit(20.0))
    return F.when(gain <= 1e-6, F.lit(-120.0)).otherwise(db)


def loudness(energy: Column) -> Column:
    """LUFS of a mean K-weighted energy."""
    return F.when(energy > 0, -0.691 + 10 * F.log10(energy))


def energy_of(lufs: float) -> float:
    return 10 ** ((lufs + 0.691) / 10)


def meter_scale(gain: Column) -> Column:
    """0 … 1 over 60 dB."""
    db = 20 * F.log10(F.greatest(gain, F.lit(1e-6)))
    return F.when(gain <= 1e-6, F.lit(0.0)).otherwise(F.least(F.greatest((db + 60) / 60, F.lit(0.0)), F.lit(1.0)))


def clamped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def stage_gain(
    measured: Column, target: Column, peak: Column, ceiling: Column, normalize: Column, limit: Column, final_db: Column
) -> Column:
    """Gain in dB to apply: to the loudness target, up to the peak ceiling (if
    ``normalize``), down under it (if ``limit``), then the final gain.

    The first counts from 0.1 dB on, the next two over 0.1 dB, the whole from 0.01 dB on.
    """
    zero = F.lit(0.0)
    a = F.coalesce(F.when(F.abs(target - measured) >= 0.1, target - measured), zero)
    b = F.coalesce(F.when(normalize & (ceiling - (peak + a) > 0.1), ceiling - (peak + a)), zero)
    c = F.coalesce(F.when(limit & (ceiling - (peak + a + b) < -0.1), ceiling - (peak + a + b)), zero)
    total = a + b + c + F.coalesce(final_db, zero)
    return F.when(F.abs(total) >= 0.01, total).otherwise(zero)


def hundredths(lufs: Column) -> Column:
    """Loudness in a bext chunk: hundredths, half away from zero; absent is 0x7FFF."""
    return F.coalesce((F.signum(lufs) * F.floor(F.abs(lufs) * 100 + 0.5)).cast("int"), F.lit(0x7FFF))


def quantised(sample: Column, bits: int) -> Column:
    """A float sample as a signed integer of ``bits`` bits."""
    full = float(2 ** (bits - 1) - 1)
    x = clamped(sample, -1.0, 1.0) * full
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("int")


def opus_family(channels: Column, is_hoa: Column, standard: Column) -> Column:
    return F.when(is_hoa, 2).when(channels <= 2, 0).when(standard, 1).otherwise(255)


def default_bitrate(layout_id: Column, channels: Column) -> Column:
    """kbit/s of spatial layouts: 2048 for 12 channels, in proportion for others; 0 otherwise."""
    spatial = layout_id.isin("4+5+0", "4+7+0", "9.1.6", "9+10+3", "hoa3")
    return F.when(spatial, F.floor((channels * 2048 + 6) / 12)).otherwise(0).cast("int")
