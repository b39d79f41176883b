"""Vector arithmetic on array columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklattice.functions.music import is_wheel_code, wheel_number


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column, least: float = 1e-8) -> Column:
    """The vector at length 1 as doubles."""
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def half_distance(a: Column, b: Column) -> Column:
    """Half the distance of two unit vectors: 0 for equal directions, 1 for opposite ones."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))) / 2


def blended(tag: Column, dsp: Column, embed: Column) -> Column:
    """Blend of three distances; without an embedding distance the other two share its weight."""
    return F.when(embed.isNotNull(), tag * 0.25 + dsp * 0.30 + embed * 0.45).otherwise(tag * 0.45 + dsp * 0.55)


def mean_vector(c: Column, dim: int) -> Column:
    """Aggregate expression: element-wise mean of unit vectors."""
    return F.array(*[F.avg(c[i]) for i in range(dim)])


def circular_key(code: Column) -> Column:
    """[sin, cos] of the wheel position among 24 places; [0, 0] for no key."""
    place = wheel_number(code) - 1 + F.when(code.endswith("B"), 12).otherwise(0)
    angle = place * (2 * 3.141592653589793 / 24)
    return F.when(is_wheel_code(code), F.array(F.sin(angle), F.cos(angle))).otherwise(F.array(F.lit(0.0), F.lit(0.0)))


def tag_vector(energy: Column, bpm: Column, bars: Column, code: Column, energy_confidence: Column) -> Column:
    """Energy, tempo and bars on [0, 1], each drawn to its middle by missing confidence, and the key on a circle."""
    e = (F.coalesce(energy, F.lit(3)) - 1) / 4
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce(bpm, F.lit(128)) - 100) / 40))
    b = F.when(bars == 16, 0.0).when(bars == 64, 1.0).otherwise(0.5)
    c = F.coalesce(energy_confidence, F.lit(0.0))
    return F.concat(F.array(e * c + (1 - c) * 0.5, t, b), circular_key(code))
