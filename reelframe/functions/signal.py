"""Gains, fades, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the crossfade rule.
XFADE_BASE_S, SIM_HIGH, SIM_FLOOR = 0.030, 0.90, 0.70


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(lit(high), F.greatest(lit(low), x))


def gain(db: Column) -> Column:
    """Decibels as a factor."""
    return F.pow(F.lit(10.0), db / F.lit(20.0))


def exponential_fade(x: Column) -> Column:
    """1 at x = 0 down to 0.001 at x = 1."""
    return F.pow(F.lit(10.0), F.lit(-3.0) * x)


def fade_in(t: Column, length: float) -> Column:
    return clamp(t / F.lit(length), 0, 1) if length > 0 else F.lit(1.0)


def fade_out(t: Column, duration: Column, length: float) -> Column:
    return clamp((duration - t) / F.lit(length), 0, 1) if length > 0 else F.lit(1.0)


def crossfade(x: Column) -> tuple[Column, Column]:
    """Equal-power gains of the part that leaves and the part that enters, x from 0 to 1."""
    half = x * F.lit(3.141592653589793 / 2)
    return F.cos(half), F.sin(half)


def crossfade_seconds(similarity: Column, beat_period: Column) -> Column:
    """The base length for a good match, up to one beat for a poor one."""
    part = clamp((F.lit(SIM_HIGH) - similarity) / F.lit(SIM_HIGH - SIM_FLOOR), 0, 1)
    return F.when(similarity >= SIM_HIGH, F.lit(XFADE_BASE_S)).otherwise(F.lit(XFADE_BASE_S) + part * (beat_period - F.lit(XFADE_BASE_S)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is at most 1e-9; the shorter length counts."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na <= 1e-9) | (nb <= 1e-9), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def normalise(v: Column) -> Column:
    """Unit length; vectors near zero stay."""
    n = F.sqrt(dot(v, v))
    return F.when(n <= 1e-9, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))
