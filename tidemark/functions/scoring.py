"""Row-wise scores of probability forecasts and their binning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least probability that the logarithmic score takes.
CLIP = 1e-12


def binary_brier(p: Column, y: Column) -> Column:
    return F.pow(p - y, 2)


def binary_log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def multi_brier(probs: list[Column], outcome: Column) -> Column:
    """Sum of squared errors over the classes 0..k-1."""
    terms = [F.pow(p - (outcome == i).cast("double"), 2) for i, p in enumerate(probs)]
    return sum(terms[1:], terms[0])


def multi_log_loss(probs: list[Column], outcome: Column) -> Column:
    return -F.ln(F.least(F.greatest(F.element_at(F.array(*probs), outcome + 1), F.lit(CLIP)), F.lit(1.0)))


def right_closed_bin(p: Column, bins: int) -> Column:
    """Index of the equal-width bin (lo, hi] of [0, 1]; 0 lies in the first bin."""
    return F.least(F.greatest(F.ceil(p * bins).cast("int") - 1, F.lit(0)), F.lit(bins - 1))


def left_closed_bin(x: Column, edges: list[float]) -> Column:
    """Index of [edge_i, edge_i+1) with open ends below and above; NULL stays NULL."""
    c = F.when(x.isNotNull(), F.lit(0))
    out = sum(((x >= e).cast("int") for e in edges[1:]), (x >= edges[0]).cast("int"))
    return F.when(x.isNotNull(), out).otherwise(c)


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
