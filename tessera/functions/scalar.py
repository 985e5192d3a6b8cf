"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def defined(c: Column) -> Column:
    """NaN and null become zero."""
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))


def clamp_normalise(c: Column, floor: float = 0.30, ceil: float = 0.70) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (defined(c) - floor) / (ceil - floor)))


def weighted_fitness(coherence: Column, diversity: Column, stability: Column, weights: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> Column:
    return sum((w * defined(c) for w, c in zip(weights, (coherence, diversity, stability), strict=True)), F.lit(0.0))


def triangle(x: Column, a: float, b: float, c: float) -> Column:
    """Triangular membership: 1 at the apex (an edge may be upright), 0 at the feet."""
    if not a <= b <= c:
        raise ValueError("parameters must ascend")
    out = F.when(x == b, 1.0)
    if a < b:
        out = out.when((x > a) & (x < b), (x - a) / (b - a))
    if b < c:
        out = out.when((x > b) & (x < c), (c - x) / (c - b))
    return out.otherwise(0.0)


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Trapezoidal membership with plateau [b, c]; an upright side saturates."""
    if not a <= b <= c <= d:
        raise ValueError("parameters must ascend")
    out = F.when((x >= b) & (x <= c), 1.0)
    out = out.when((x > a) & (x < b), (x - a) / (b - a)) if a < b else out.when(x < b, 1.0)
    out = out.when((x > c) & (x < d), (d - x) / (d - c)) if c < d else out.when(x > c, 1.0)
    return out.otherwise(0.0)


def membership(x: Column, points: tuple[float, ...]) -> Column:
    return triangle(x, *points) if len(points) == 3 else trapezoid(x, *points)


def _within(dim: int, shift: tuple[float, ...]) -> None:
    if not 2 <= dim <= len(shift):
        raise ValueError(f"{dim} dimensions; the shift vector has {len(shift)}")


def shifted_rosenbrock(x: Column, dim: int) -> Column:
    """Of an array's first ``dim`` values; the optimum is the shift vector."""
    _within(dim, fixed.SHIFT_ROSENBROCK)
    z = F.transform(F.slice(x, 1, dim), lambda v, i: v - F.get(F.array(*map(F.lit, fixed.SHIFT_ROSENBROCK[:dim])), i) + 1.0)
    pairs = F.zip_with(F.slice(z, 1, dim - 1), F.slice(z, 2, dim - 1), lambda a, b: 100.0 * F.pow(a * a - b, F.lit(2)) + F.pow(a - 1.0, F.lit(2)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) + fixed.BIAS_ROSENBROCK


def shifted_rastrigin(x: Column, dim: int) -> Column:
    _within(dim, fixed.SHIFT_RASTRIGIN)
    z = F.transform(F.slice(x, 1, dim), lambda v, i: v - F.get(F.array(*map(F.lit, fixed.SHIFT_RASTRIGIN[:dim])), i))
    terms = F.transform(z, lambda v: v * v - 10.0 * F.cos(2.0 * F.pi() * v) + 10.0)
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) + fixed.BIAS_RASTRIGIN


def encode8(v: Column, lo: float, hi: float) -> Column:
    """Fixed point on 0..255, half to even, clipped."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround((v - lo) / (hi - lo) * 255.0).cast("int")))


def decode8(b: Column, lo: float, hi: float) -> Column:
    return lo + b * ((hi - lo) / 255.0)


def agreement_label(alpha: Column) -> Column:
    return F.when(alpha.isNull() | F.isnan(alpha), "not computable").when(alpha >= 0.8, "reliable").when(alpha >= 0.667, "tentative").otherwise("unreliable")


def trend_label(slope: Column, change: Column) -> Column:
    """Unknown without a slope; the direction is that of the change between the ends."""
    return F.when(slope.isNull(), "unknown").when(F.abs(change) < 0.01, "stable").when(change > 0, "rising").otherwise("falling")


# --- Fixed values of the reference policy ---
SETPOINT, PER_ACTIVITY, PER_PREFERENCE, GAIN, LIMIT = 23.5, -0.45, 0.60, 14.0, 85.0
LAMP, LAMP_PER_ACTIVITY, CREDIT, LAMP_LOW, LAMP_HIGH = 25.0, 6.5, 0.85, 8.0, 95.0


def policy(room_temp: Column, activity: Column, daylight: Column, preference: Column) -> tuple[Column, Column]:
    """Reference policy: two clipped linear ramps of the four inputs."""

    def clip(v: Column, lo: float, hi: float) -> Column:
        return F.greatest(F.lit(lo), F.least(F.lit(hi), v))

    comfort = SETPOINT + PER_ACTIVITY * activity + PER_PREFERENCE * preference
    return clip(GAIN * (comfort - room_temp), -LIMIT, LIMIT), clip(LAMP + LAMP_PER_ACTIVITY * activity - CREDIT * daylight, LAMP_LOW, LAMP_HIGH)
