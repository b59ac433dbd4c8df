"""Column helpers shared by the operators: finite tests, safe division, squashing maps, arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    """x cut to [low, high]; null stays null, which greatest() alone would turn into low."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column) -> Column:
    """Logistic function; the argument is cut at 50, beyond which the result no longer moves."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(x, -50.0, 50.0)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


#: Coefficients of the rational error-function approximation in Abramowitz and Stegun 7.1.26. Fixed values.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function to about 1e-7, as plain arithmetic."""
    z = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + F.lit(c)) * t
    upper = F.lit(0.5) * poly * F.exp(-z * z)
    return F.when(x < 0, upper).otherwise(F.lit(1.0) - upper)


def pool(values: Column, how: str) -> Column:
    """One number for an array of scores: mean, last, sum or median; 0 for an empty array."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    n = F.size(values)
    if how == "last":
        out = F.try_element_at(values, F.lit(-1))
    elif how == "sum":
        out = total
    elif how == "median":
        s = F.array_sort(values)
        low = F.get(s, F.floor((n - 1) / 2).cast("int"))
        out = (low + F.get(s, F.floor(n / 2).cast("int"))) / 2
    elif how == "mean":
        out = F.try_divide(total, n)
    else:
        raise ValueError(f"unknown pooling {how!r}")
    return F.coalesce(out, F.lit(0.0))


def all_finite(values: Column) -> Column:
    return F.forall(values, finite)


def first_finite_array(*arrays: Column) -> Column:
    """The first of the arrays whose elements are all finite."""
    return F.coalesce(*[F.when(all_finite(a), a) for a in arrays])


def numbers_to(n: Column) -> Column:
    """1 to n as an array; none for 0 or less, where sequence() would count down."""
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n)


def mask_from_first_error(n: Column, first_error: Column) -> Column:
    """1 for steps before the first error, 0 from it on; all 1 where it is -1."""
    return F.transform(numbers_to(n), lambda i: F.when((first_error == -1) | (i - 1 < first_error), 1).otherwise(0))


def labels_from_error_steps(n: Column, error_steps: Column) -> Column:
    """1-based numbers of wrong steps to an array of 0 and 1."""
    return F.transform(numbers_to(n), lambda i: F.array_contains(error_steps, i).cast("int"))


def trimmed(*arrays: Column) -> list[Column]:
    """The arrays cut to the shortest one's length."""
    n = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    return [F.slice(a, F.lit(1), n) for a in arrays]


def split_by_lengths(flat: Column, lengths: Column) -> Column:
    """A flat array cut into parts of the given lengths; of many parts steps.split_flat is faster."""
    offsets = F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, v: a + v))
    return F.zip_with(offsets, lengths, lambda o, n: F.slice(flat, o + 1, n))


def head_score(vector: Column, weights: list[float], bias: float = 0.0) -> Column:
    """A linear head on an array of numbers."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector.cast("array<double>"), w, lambda a, b: a * b), F.lit(float(bias)), lambda a, v: a + v)


def bce_with_logits(score: Column, target: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross-entropy of a logit in its stable form."""
    soft = F.log1p(F.exp(-F.abs(score))) + F.greatest(-score, F.lit(0.0))
    return (1 - target) * score + (1 + (pos_weight - 1) * target) * soft
