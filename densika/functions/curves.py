"""Piecewise scalar curves and small expressions, all inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from densika.config import DensityScore, MapNormalization, WaterScoring, Weighting


def squared_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Sums of products, not powers, so that closed comparisons agree between engines."""
    dx, dy, dz = (p - q for p, q in zip(a, b, strict=True))
    return dx * dx + dy * dy + dz * dz


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(squared_distance(a, b))


def parabola_weight(d: Column, r: Column, cfg: Weighting = Weighting()) -> Column:
    """Positive within the sphere, negative in the ring around it, 0 beyond twice the radius or if r <= 0."""

    def piece(curve: tuple[float, float, float]) -> Column:
        slope, centre, offset = curve
        t = d - r * centre
        return (t * t) * (F.lit(slope) / (r * r)) + offset

    return (
        F.when((r <= 0) | (d < 0), F.lit(0.0))
        .when(d <= r * cfg.end_first, piece(cfg.first))
        .when(d <= r * cfg.end_second, piece(cfg.second))
        .when(d <= r * 2.0, piece(cfg.third))
        .otherwise(F.lit(0.0))
    )


def gaussian_weight(d: Column, cfg: WaterScoring = WaterScoring()) -> Column:
    """A Gaussian of the covalent radius that runs out linearly to the van der Waals radius."""
    delta, end = cfg.covalent_radius, cfg.vdw_radius
    if delta <= 0 or end <= 0:
        return F.lit(0.0)
    bell = F.exp((d / delta) * (d / delta) * -0.5)
    inside = (d >= 0) & (d <= end)
    room = end * end / 4 - delta * delta
    if room < 0:
        return F.when(inside, bell).otherwise(F.lit(0.0))
    knee = end / 2 + math.sqrt(room)
    slope = math.exp(-0.5 * (knee / delta) * (knee / delta)) / (knee - end)
    return F.when(~inside, F.lit(0.0)).when(d <= knee, bell).otherwise((d - end) * slope)


def density_score(value: Column, mean: Column, sigma: Column, density: DensityScore, norm: MapNormalization) -> Column:
    """Normalised if asked for, then clipped to [0, zeta]; NaN stays NaN, which ``least`` would lose."""
    z = (value - mean) / sigma if norm.normalize else value
    clipped = F.greatest(z, F.lit(0.0))
    if density.use_truncation:
        clipped = F.least(clipped, F.lit(density.zeta))
    return F.when(F.isnan(z), z).otherwise(clipped)


def ratio_or_zero(top: Column, bottom: Column, least: float = 1e-12) -> Column:
    """``top / bottom``, or 0 where the bottom is null (one map), NaN or next to nothing."""
    return F.when(bottom.isNull() | F.isnan(bottom) | (bottom <= least), F.lit(0.0)).otherwise(top / bottom)


def power_mean(score: Column, shift: float = 0.1, exponent: float = -2.0) -> Column:
    """An aggregate that low scores pull down: 0 at least, 0 of nothing."""
    raised = F.pow(F.greatest(score + shift, F.lit(1e-10)), F.lit(exponent))
    return F.coalesce(F.greatest(F.lit(0.0), F.pow(F.avg(raised), F.lit(1 / exponent)) - shift), F.lit(0.0))


def badge(value: Column, green: float, yellow: float) -> Column:
    return F.when(value.isNull(), "none").when(value >= green, "green").when(value >= yellow, "yellow").otherwise("red")


#: Colours of scores from 0 to the usual clip, and of p-values.
SCORE_COLOURS = ((0.0, "#D62728"), (0.4, "#FF9896"), (0.8, "#AEC7E8"), (1.2, "#1F77B4"))
P_VALUE_COLOURS = ((0.0, "#D62728"), (0.5, "#FFDD71"), (1.0, "#2CA02C"))


def colour(value: Column, stops: tuple[tuple[float, str], ...] = SCORE_COLOURS) -> Column:
    """``#RRGGBB`` of a value on a scale of colours, linear between its stops and constant outside; null of null and NaN."""
    at = F.least(F.greatest(value, F.lit(stops[0][0])), F.lit(stops[-1][0]))

    def channel(k: int) -> Column:
        part = [int(c[1 + 2 * k : 3 + 2 * k], 16) for _, c in stops]
        out = F.lit(float(part[-1]))
        for (a, _), (b, _), low, high in reversed(list(zip(stops, stops[1:], part, part[1:], strict=False))):
            out = F.when(at <= b, (at - a) / (b - a) * (high - low) + low).otherwise(out)
        return F.round(out).cast("int")

    return F.when(~F.isnan(value), F.format_string("#%02X%02X%02X", channel(0), channel(1), channel(2)))


def safe_float(text: Column) -> Column:
    return F.round(text.try_cast("double"), 4)


def safe_int(text: Column) -> Column:
    return text.try_cast("double").cast("long")


def token_kind(token: Column) -> Column:
    return (
        F.when(token.rlike("^(?i)none$"), "none")
        .when(token.rlike("^(?i)(true|false)$"), "bool")
        .when(token.rlike(r"^-?[0-9]+$"), "int")
        .when(token.rlike(r"^-?[0-9]+\.[0-9]+$"), "float")
        .otherwise("str")
    )


def oversampling(spacing: Column, most: float = 0.7) -> Column:
    return F.greatest(F.lit(1), F.ceil(spacing / most)).cast("int")


def id_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def key_part(key: Column, n: int) -> Column:
    """Part ``n`` of a key, from 0; an alternative location of NUL counts as none."""
    part = F.get(F.split(key, r"\|"), F.lit(n))
    return F.coalesce(F.when(part == "\x00", F.lit("")).otherwise(part), F.lit("")) if n == 4 else part
