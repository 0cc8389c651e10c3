"""Arithmetic of quoted prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_price(c: Column) -> Column:
    """The price if it is a finite number above 1, else NULL (NaN compares above every number in Spark)."""
    return F.when((c > 1.0) & ~F.isnan(c) & (c < F.lit(float("inf"))), c)


def implied(c: Column) -> Column:
    return F.lit(1.0) / valid_price(c)


def hold(prices: list[Column]) -> Column:
    """Sum of the implied probabilities less 1; NULL if a price is missing."""
    p = [implied(c) for c in prices]
    return sum(p[1:], p[0]) - 1


def without_margin(prices: list[Column]) -> list[Column]:
    """Implied probabilities scaled to sum 1; NULL if a price is missing."""
    p = [implied(c) for c in prices]
    total = sum(p[1:], p[0])
    return [x / total for x in p]


def fair_price(p: Column) -> Column:
    """1 / p; infinite for p = 0."""
    return F.when(p > 0, 1 / p).when(p.isNotNull(), F.lit(float("inf")))


def expected_value(p: Column, price: Column) -> Column:
    """Mean profit of a unit stake; NULL unless p is a probability and the price valid."""
    return F.when(p.between(0.0, 1.0), p * valid_price(price) - 1)


def closing_line_value(taken: Column, closing_fair: Column) -> Column:
    """Percent by which the fair closing price lies above the price taken."""
    return (valid_price(closing_fair) / valid_price(taken) - 1) * 100


def kelly_fraction(p: Column, price: Column) -> Column:
    """Growth-optimal share of the balance; negative where the bet loses on average."""
    return (p * valid_price(price) - 1) / (valid_price(price) - 1)


def limited_stake(raw: Column, balance: Column, share: float, cap: float) -> Column:
    """A stake within a share of the balance, a cap and the balance itself, never below 0."""
    return F.greatest(F.least(raw, balance * share, F.lit(cap), balance), F.lit(0.0))


def settle_fraction(difference: Column, line: Column) -> Column:
    """Part of a handicap stake that is won (+) or lost (-): one of -1, -0.5, 0, 0.5, 1."""
    edge = difference + line
    return F.when(edge >= 0.5, 1.0).when(edge == 0.25, 0.5).when(edge == 0, 0.0).when(edge == -0.25, -0.5).when(edge.isNotNull(), -1.0)
