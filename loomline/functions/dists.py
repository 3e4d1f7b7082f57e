"""Expressions on probability arrays: decoding, scoring rules, calibration maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an outer expression is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    e = let(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp((x - m) / t)))
    return let(e, renormalise)


def argmax(p: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def one_hot(at: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def normalised_entropy(p: Column) -> Column:
    return F.when(F.size(p) > 1, entropy(p) / F.ln(F.size(p).cast("double"))).otherwise(0.0)


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def nll(p: Column, y: Column, floor: float = 1e-12) -> Column:
    """-sum y ln max(p, floor)."""
    return -total(F.zip_with(p, y, lambda x, t: F.when(t > 0, t * F.ln(F.greatest(x, F.lit(floor)))).otherwise(0.0)))


def nll_literal(p: Column, y: Column) -> Column:
    """-sum y ln p; null if a positive target has no probability."""
    return F.when(~F.exists(F.zip_with(p, y, lambda x, t: (t > 0) & (x <= 0)), lambda b: b), nll(p, y, 1e-300))


def brier(p: Column, y: Column) -> Column:
    return total(F.zip_with(p, y, lambda x, t: (x - t) * (x - t)))


def spherical(p: Column, y: Column) -> Column:
    return -dot(p, y) / F.greatest(F.sqrt(dot(p, p)), F.lit(1e-12))


def correct(p: Column, y: Column) -> Column:
    """Target mass at the first argmax: soft labels give part of a point."""
    return F.element_at(y, argmax(p) + 1)


def total_variation(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def smooth(y: Column, s: float) -> Column:
    return F.transform(y, lambda t: (1 - s) * t + s / F.size(y))


def renormalise(p: Column) -> Column:
    return let(total(p), lambda s: F.transform(p, lambda x: x / s))


def symmetric_kl(p: Column, q: Column, floor: float = 1e-12) -> Column:
    def kl(a: Column, b: Column) -> Column:
        return total(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * (F.ln(x) - F.ln(F.greatest(y, F.lit(floor))))).otherwise(0.0)))

    return (kl(p, q) + kl(q, p)) / 2


def valid_distribution(p: Column, k: Column | None = None, tolerance: float = 1e-5) -> Column:
    fine = p.isNotNull() & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))) & (F.abs(total(p) - 1) <= tolerance)
    return F.coalesce(fine if k is None else fine & (F.size(p) == k), F.lit(False))


def cardinality_bucket(k: Column) -> Column:
    """The power of two at or above k, at least 2."""
    return F.pow(F.lit(2), F.greatest(F.lit(1), F.ceil(F.log2(k.cast("double"))))).cast("int")


def bin_floor(c: Column, bins: int = 10) -> Column:
    return F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")


def bin_right_closed(c: Column, bins: int = 10) -> Column:
    """(lo, hi], with 0 in the first bin."""
    return F.greatest(F.ceil(c * bins) - 1, F.lit(0)).cast("int")


def bin_left_closed(c: Column, bins: int = 10) -> Column:
    """[lo, hi); a confidence of 1 falls outside and gives null."""
    return F.when(c < 1, F.floor(c * bins).cast("int"))


def apply_histogram(p: Column, accuracy: Column) -> Column:
    """Set the top probability to its bin's accuracy and share out the rest in proportion (evenly if it is zero)."""
    top, at = F.array_max(p), argmax(p)
    rest = 1 - top
    scaled = let(F.struct(at.alias("at"), rest.alias("rest")), lambda m: F.transform(p, lambda x, i: F.when(i == m["at"], accuracy).when(m["rest"] > 0, x * (1 - accuracy) / m["rest"]).otherwise((1 - accuracy) / (F.size(p) - 1))))
    return F.when(accuracy.isNull() | (F.size(p) == 1), p).otherwise(scaled)
