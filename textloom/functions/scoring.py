"""Column -> Column math for scores: sigmoid, argmax, rounding, stable losses,
pair truncation (T19, T23-T27).  Pure SQL expressions, whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x) -> Column:
    """1 / (1 + exp(-x))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def softplus(x) -> Column:
    """log(1 + exp(x)) without overflow: max(x, 0) + log1p(exp(-|x|))."""
    x = _c(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(x, y, pos_weight: float = 1.0) -> Column:
    """Binary cross-entropy on a logit; `pos_weight` scales the positive term."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    if pos_weight == 1.0:
        return softplus(x) - x * y
    return F.lit(float(pos_weight)) * y * softplus(-x) + (F.lit(1.0) - y) * softplus(x)


def cross_entropy_2(logits, cls) -> Column:
    """2-class cross-entropy of ARRAY<DOUBLE>(2) logits and a class 0/1."""
    lg = _c(logits)
    a, b = F.get(lg, 0), F.get(lg, 1)
    m = F.greatest(a, b)
    lse = m + F.log(F.exp(a - m) + F.exp(b - m))
    return lse - F.when(_c(cls) == 1, b).otherwise(a)


def squared_error(pred, y) -> Column:
    d = _c(pred).cast("double") - _c(y).cast("double")
    return d * d


def argmax(arr) -> Column:
    """0-based index of the first maximum of an array."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def rint(x) -> Column:
    """Round half to even."""
    return F.bround(_c(x).cast("double"), 0)


def threshold(x, t: float = 0.5, use_sigmoid: bool = True) -> Column:
    """1 when (sigmoid(x) if use_sigmoid else x) > t, strict."""
    v = sigmoid(x) if use_sigmoid else _c(x)
    return (v > F.lit(float(t))).cast("int")


def truncate_pair(len_a, len_b, max_total) -> tuple[Column, Column]:
    """T19 closed form of "pop from the longer list, ties pop B" until the sum fits.

    a' = least(A, greatest(M - B, ceil(M / 2))), b' = least(B, greatest(M - A, floor(M / 2))).
    """
    a, b, m = _c(len_a), _c(len_b), _c(max_total) if not isinstance(max_total, int) else F.lit(max_total)
    a2 = F.least(a, F.greatest(m - b, F.ceil(m / F.lit(2))))
    b2 = F.least(b, F.greatest(m - a, F.floor(m / F.lit(2))))
    return a2.cast("int"), b2.cast("int")
