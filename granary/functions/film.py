"""Photographic response as columns. Curve shapes marked 'ours' stand in for learned ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_exposure(x: Column, floor: float = 1e-6) -> Column:
    """log10 of x, not below the floor; null stays null (PRJ-08)."""
    return F.when(x.isNotNull(), F.log10(F.greatest(x, F.lit(floor))))


def density(log_h: Column, toe: float, linear_shoulder: float, gamma: float, dmax: float) -> Column:
    """Density by log exposure (PRJ-29, ours): gamma times the exposure above the toe, between 0 and dmax, flat past the shoulder."""
    return F.least(F.greatest(F.lit(gamma) * (F.least(log_h, F.lit(linear_shoulder)) - F.lit(toe)), F.lit(0.0)), F.lit(dmax))


def midtone(e: Column) -> Column:
    """1 - 2 |e - 0.5|: grain weight by exposure (PRJ-16)."""
    return F.lit(1.0) - 2.0 * F.abs(e - 0.5)


def kernel_size(sigma: Column) -> Column:
    """Odd size of a Gaussian kernel (PRJ-17)."""
    return (F.floor(F.floor(6 * sigma + 1) / 2) * 2 + 1).cast("long")


def spectrum_filter(f: Column, fc: float, p: Column) -> Column:
    """1 / (1 + (f / fc)^2)^(p / 2), p held in 0.5 to 2 (PRJ-18)."""
    power = F.least(F.greatest(p, F.lit(0.5)), F.lit(2.0))
    return 1.0 / F.pow(1.0 + F.pow(f / F.lit(fc), F.lit(2.0)), power / 2)


def bit_depth(v: Column, bits: int) -> Column:
    """v / (2^bits - 1) (PRJ-06)."""
    return v / F.lit(float(2**bits - 1))


def exposure_shift(x: Column, ev: Column) -> Column:
    """x * 2^ev (PRJ-24)."""
    return x * F.pow(F.lit(2.0), ev)


def sensitivity(wavelength: Column, peak: float, width: float) -> Column:
    """Gaussian spectral sensitivity (PRJ-32); ``width`` is taken as the standard deviation."""
    return F.exp(-0.5 * F.pow((wavelength - peak) / width, F.lit(2.0)))


def crosstalk(rgb: tuple[Column, Column, Column], matrix) -> list[Column]:
    """Three linear combinations of three channels (PRJ-31)."""
    return [sum((F.lit(float(m)) * c for m, c in zip(row[1:], rgb[1:], strict=True)), F.lit(float(row[0])) * rgb[0]) for row in matrix]


def channel_scale(rgb: tuple[Column, Column, Column], c: float) -> list[Column]:
    """Red times c, green, blue over c or 0.3 if that is more (PRJ-19)."""
    return [rgb[0] * c, rgb[1], rgb[2] / max(c, 0.3)]


def white_balance(rgb: tuple[Column, Column, Column], kelvin: Column) -> list[Column]:
    """Gains that take daylight (6500 K) to another temperature, 2500 to 10000 K (PRJ-25; the square-root form is ours)."""
    gain = F.sqrt(F.greatest(F.lit(2500.0), F.least(F.lit(10000.0), kelvin)) / F.lit(6500.0))
    return [rgb[0] * gain, rgb[1], rgb[2] / gain]


def vignette(value: Column, x: Column, y: Column, width: int, height: int, fall: float) -> Column:
    """value less a share ``fall`` of it at the corners, by the squared distance from the centre (PRJ-33; the form is ours)."""
    u, v = (x - (width - 1) / 2) / (width / 2), (y - (height - 1) / 2) / (height / 2)
    return value * (1 - F.lit(float(fall)) * (u * u + v * v) / 2)


def overrides(strength: Column, factor: float | None) -> Column:
    """A style's strength, scaled by a caller's factor if there is one (PRJ-23; scaling is our reading)."""
    return strength if factor is None else strength * F.lit(float(factor))


def exponential_decay(step: Column, rate: float, peak: float) -> Column:
    """peak * exp(-rate * step) (PRJ-38)."""
    return F.lit(peak) * F.exp(-F.lit(rate) * step)


def warmup(step: Column, steps: int, peak: float) -> Column:
    """Linear warm-up of a rate (PRJ-38)."""
    return F.lit(peak) * F.least(F.lit(1.0), (step + 1) / F.lit(float(steps)))


def cosine_decay(step: Column, steps: int, peak: float) -> Column:
    """Half a cosine from the peak to 0 (PRJ-38)."""
    return F.lit(peak) * 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), step / F.lit(float(steps)))))
