"""Score distributions of two independent counts, as array expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest count on the grid; factorial() ends at 20.
TOP = 20


def pmf(rate: Column, top: int = TOP) -> Column:
    """Poisson probabilities of 0..top as an array; NULL rate gives NULL."""
    p = F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.exp(-rate) * F.pow(rate, k) / F.factorial(k))
    return F.when(rate.isNotNull(), p)


def outcome_probabilities(home: Column, away: Column) -> Column:
    """Struct (home, draw, away) from two pmf arrays, in one pass, scaled to sum 1."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("below"), zero.alias("home"), zero.alias("draw"), zero.alias("sh"), zero.alias("sa"))

    def step(acc: Column, z: Column) -> Column:
        return F.struct(
            (acc["below"] + z["a"]).alias("below"),
            (acc["home"] + z["h"] * acc["below"]).alias("home"),
            (acc["draw"] + z["h"] * z["a"]).alias("draw"),
            (acc["sh"] + z["h"]).alias("sh"),
            (acc["sa"] + z["a"]).alias("sa"),
        )

    def finish(acc: Column) -> Column:
        total = acc["sh"] * acc["sa"]
        return F.struct(F.try_divide(acc["home"], total).alias("home"), F.try_divide(acc["draw"], total).alias("draw"), F.try_divide(F.greatest(total - acc["home"] - acc["draw"], zero), total).alias("away"))

    pairs = F.zip_with(home, away, lambda h, a: F.struct(h.alias("h"), a.alias("a")))
    return F.aggregate(pairs, start, step, finish)


def total_distribution(home: Column, away: Column, bucket: int = 6) -> Column:
    """P(total = 0..bucket-1) and P(total >= bucket) as an array, scaled to sum 1 over the grid."""
    mass = F.aggregate(home, F.lit(0.0), lambda s, x: s + x) * F.aggregate(away, F.lit(0.0), lambda s, x: s + x)

    def at(k: int) -> Column:
        terms = [F.element_at(home, i + 1) * F.element_at(away, k - i + 1) for i in range(k + 1)]
        return F.try_divide(sum(terms[1:], terms[0]), mass)

    head = [at(k) for k in range(bucket)]
    return F.array(*head, F.lit(1.0) - sum(head[1:], head[0]))


def over_probability(distribution: Column, line: float) -> Column:
    """P(total > line) from a total distribution; the line lies below its last bucket."""
    n = int(line) + 1
    return F.lit(1.0) - F.aggregate(F.slice(distribution, 1, n), F.lit(0.0), lambda s, x: s + x)


def difference_distribution(home: Column, away: Column, top: int = TOP) -> Column:
    """P(home - away = d) for d in -top..top as an array of structs (d, p), scaled to sum 1."""
    mass = F.aggregate(home, F.lit(0.0), lambda s, x: s + x) * F.aggregate(away, F.lit(0.0), lambda s, x: s + x)

    def at(d: Column) -> Column:
        ks = F.sequence(F.greatest(F.lit(0), d), F.least(F.lit(top), d + top))
        return F.aggregate(F.transform(ks, lambda h: F.get(home, h) * F.get(away, h - d)), F.lit(0.0), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(-top), F.lit(top)), lambda d: F.struct(d.alias("d"), F.try_divide(at(d), mass).alias("p")))


def handicap_probabilities(difference: Column, line: float) -> Column:
    """Struct (home, push, away) of a handicap; a quarter line is the mean of its two neighbours."""
    if abs(line * 4 % 2) > 1e-9:
        low, high = handicap_probabilities(difference, line - 0.25), handicap_probabilities(difference, line + 0.25)
        return F.struct(*[((low[c] + high[c]) / 2).alias(c) for c in ("home", "push", "away")])

    def mass(test) -> Column:  # noqa: ANN001
        return F.aggregate(F.filter(difference, test), F.lit(0.0), lambda s, x: s + x["p"])

    return F.struct(mass(lambda x: x["d"] + line > 0).alias("home"), mass(lambda x: x["d"] + line == 0).alias("push"), mass(lambda x: x["d"] + line < 0).alias("away"))


def low_score_factor(x: Column, y: Column, lam: Column, mu: Column, rho: Column) -> Column:
    """Factor on the cells 0-0, 0-1, 1-0 and 1-1 that lets low scores depend on each other."""
    return (
        F.when((x == 0) & (y == 0), 1 - lam * mu * rho)
        .when((x == 0) & (y == 1), 1 + lam * rho)
        .when((x == 1) & (y == 0), 1 + mu * rho)
        .when((x == 1) & (y == 1), 1 - rho)
        .otherwise(F.lit(1.0))
    )


def rho_bounds(lam: Column, mu: Column) -> tuple[Column, Column]:
    """Least and greatest rho that keep all four factors non-negative."""
    return F.greatest(-1 / lam, -1 / mu), F.least(F.lit(1.0), 1 / (lam * mu))


def corrected_low_scores(home: Column, away: Column, lam: Column, mu: Column, rho: Column) -> Column:
    """P(0-0), P(1-0), P(0-1), P(1-1) under the correction, scaled by the corrected grid's sum."""
    cells = [(0, 0), (1, 0), (0, 1), (1, 1)]
    raw = [F.element_at(home, x + 1) * F.element_at(away, y + 1) for x, y in cells]
    new = [r * low_score_factor(F.lit(x), F.lit(y), lam, mu, rho) for r, (x, y) in zip(raw, cells, strict=True)]
    mass = F.aggregate(home, F.lit(0.0), lambda s, x: s + x) * F.aggregate(away, F.lit(0.0), lambda s, x: s + x)
    total = mass + sum((n - r for n, r in zip(new[1:], raw[1:], strict=True)), new[0] - raw[0])
    return F.array(*[F.try_divide(n, total) for n in new])


def total_variation(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2


def is_distribution(p: Column, tolerance: float = 1e-6) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.forall(p, lambda x: x >= -tolerance) & (F.abs(total - 1) <= tolerance)


def is_non_increasing(p: Column) -> Column:
    return F.forall(F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: a >= b - 1e-9), lambda ok: ok)
