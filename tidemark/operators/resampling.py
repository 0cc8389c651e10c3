"""Resampling and exact tests, per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one task weighs; a group of any size is spread over blocks of about so many.
BLOCK_ROWS = 20_000
#: Fixed value: Poisson(1) counts by even share of 65,536 places, so that a draw is one look-up.
POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(65_536) + 0.5) / 65_536).astype("float32")


def blocked(df: DataFrame, id_column: str) -> DataFrame:
    """Add `b`: the block of each row of (grp, ...), as many blocks per group as its rows fill."""
    sizes = df.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.lit(1)).alias("_blocks"))
    return df.join(sizes, df["grp"].eqNullSafe(sizes["grp"])).drop(sizes["grp"]).withColumn("b", F.pmod(F.xxhash64(id_column), F.col("_blocks"))).drop("_blocks")


def weighted_sums(df: DataFrame, sums: list[str], draws: int, seed: int = 42) -> DataFrame:
    """(grp, draw, sums...): sums of df (grp, id, sums...) under random row weights; draw -1 has all rows once.

    Weights are Poisson(1) counts (the bootstrap), or, with a column `_share`
    in df, 1 with that probability and else 0 (random relabelling).  Blocks are
    weighed in parallel and only their sums meet.  Weights depend on group,
    block and row order by id alone, so a task that runs again gives the same.
    """
    labelled = "_share" in df.columns
    part = T.StructType([T.StructField("grp", T.StringType()), T.StructField("draw", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in sums]])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = pdf[sums].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, hash_text(str(key[0])), int(key[1])])
        out = np.zeros((draws, len(sums)))
        for d in range(0, draws, 1000):
            n = min(1000, draws - d)
            for at in range(0, len(x), 2048):
                some = x[at : at + 2048]
                w = rng.integers(0, 65_536, size=(n, len(some)), dtype=np.uint16)
                w = (w < pdf["_share"].to_numpy()[at : at + 2048] * 65_536).astype(float) if labelled else POISSON[w].astype(float)
                out[d : d + n] += w @ some
        out = np.concatenate([x.sum(0)[None], out])
        return pd.DataFrame({"grp": key[0], "draw": np.arange(-1, draws, dtype="int32"), **{c: out[:, i] for i, c in enumerate(sums)}})

    parts = blocked(df, "id").groupBy("grp", "b").applyInPandas(run, part)
    return parts.groupBy("grp", "draw").agg(*[F.sum(c).alias(c) for c in sums])


def interval(drawn: DataFrame, statistic: Column, n: str = "n") -> DataFrame:
    """grp, n, estimate, low, high, p_value of a statistic of the drawn sums: 2.5 and 97.5 percentiles, two-sided p capped at 1.

    Draws in which the statistic is not defined are left out.
    """
    d = drawn.select("grp", "draw", F.col(n).alias("n"), statistic.alias("m"))
    seen, all_rows = F.when(F.col("draw") >= 0, F.col("m")), F.col("draw") < 0
    out = d.groupBy("grp").agg(F.max(F.when(all_rows, F.col("n"))).cast("long").alias("n"), F.max(F.when(all_rows, F.col("m"))).alias("estimate"), F.percentile(seen, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((seen <= 0).cast("double")).alias("le"), F.avg((seen >= 0).cast("double")).alias("ge"))
    p = F.least(F.lit(1.0), 2 * F.when(F.col("estimate") >= 0, F.col("le")).otherwise(F.col("ge")))
    return out.select("grp", "n", "estimate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), p.alias("p_value"))


def grouped(df: DataFrame, group: str, id_column: str, **columns: Column) -> DataFrame:
    return df.select(F.col(group).cast("string").alias("grp"), F.col(id_column).alias("id"), *[c.alias(n) for n, c in columns.items()])


def bootstrap_means(df: DataFrame, group: str, value: str, id_column: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean per group with the 95 % interval and two-sided p of its bootstrap; NULL values are left out."""
    rows = grouped(df.where(F.col(value).isNotNull()), group, id_column, n=F.lit(1.0), s=F.col(value).cast("double"))
    return interval(weighted_sums(rows, ["n", "s"], draws, seed), F.try_divide("s", "n")).withColumnRenamed("estimate", "mean")


def bootstrap_difference(df: DataFrame, group: str, value: str, side: Column, id_column: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean of the rows where `side` holds less the mean of the others, both sides drawn independently; NULL if a side is empty."""
    v = F.col(value).cast("double")
    on = F.when(side, 1.0).otherwise(0.0)
    rows = grouped(df.where(F.col(value).isNotNull() & side.isNotNull()), group, id_column, n=F.lit(1.0), na=on, sa=on * v, nb=1 - on, sb=(1 - on) * v)
    return interval(weighted_sums(rows, ["n", "na", "sa", "nb", "sb"], draws, seed), F.try_divide("sa", "na") - F.try_divide("sb", "nb"))


def moments(x: Column, y: Column, on: Column, tag: str = "") -> dict[str, Column]:
    """Columns whose sums give Pearson's r of the rows where `on` is 1."""
    return {f"n{tag}": on, f"x{tag}": on * x, f"y{tag}": on * y, f"xx{tag}": on * x * x, f"yy{tag}": on * y * y, f"xy{tag}": on * x * y}


def pearson(tag: str = "") -> Column:
    n, x, y, xx, yy, xy = (F.col(f"{c}{tag}") for c in ("n", "x", "y", "xx", "yy", "xy"))
    vx, vy = n * xx - x * x, n * yy - y * y
    return F.when((vx > 1e-12) & (vy > 1e-12), (n * xy - x * y) / F.sqrt(vx * vy))


def paired_columns(df: DataFrame, x: str, y: str) -> tuple[DataFrame, Column, Column]:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), F.col(x).cast("double"), F.col(y).cast("double")


def bootstrap_correlation(df: DataFrame, group: str, x: str, y: str, id_column: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Pearson's r per group with its bootstrap interval."""
    full, cx, cy = paired_columns(df, x, y)
    cols = moments(cx, cy, F.lit(1.0))
    return interval(weighted_sums(grouped(full, group, id_column, **cols), list(cols), draws, seed), pearson())


def bootstrap_correlation_difference(df: DataFrame, group: str, x: str, y: str, side: Column, id_column: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """r of the rows where `side` holds less r of the others, with its bootstrap interval."""
    full, cx, cy = paired_columns(df.where(side.isNotNull()), x, y)
    on = F.when(side, 1.0).otherwise(0.0)
    cols = {"n": F.lit(1.0), **moments(cx, cy, on, "a"), **moments(cx, cy, 1 - on, "b")}
    return interval(weighted_sums(grouped(full, group, id_column, **cols), list(cols), draws, seed), pearson("a") - pearson("b"))


def permutation_correlation_difference(df: DataFrame, group: str, x: str, y: str, side: Column, id_column: str, draws: int = 2_000, seed: int = 42) -> DataFrame:
    """grp, n, estimate, p_value: difference of two correlations against random labels.

    Each row draws its label anew with the share of the first side, so side
    sizes vary by chance about their own; p = (hits + 1) / (draws + 1).
    """
    full, cx, cy = paired_columns(df.where(side.isNotNull()), x, y)
    on = F.when(side, 1.0).otherwise(0.0)
    base = grouped(full, group, id_column, side=on, **moments(cx, cy, F.lit(1.0)))
    cols = list(moments(cx, cy, F.lit(1.0)))
    whole = base.groupBy("grp").agg(F.avg("side").alias("_share"), *[F.sum(c).alias(f"{c}t") for c in cols], *[F.sum(F.col("side") * F.col(c)).alias(f"{c}a") for c in cols])
    rows = base.join(whole.select("grp", "_share"), "grp").select("grp", "id", "_share", *cols)
    drawn = weighted_sums(rows, cols, draws, seed).where("draw >= 0").join(whole, "grp")
    first = drawn.select("grp", *cols, *[F.col(f"{c}t") for c in cols]).select("grp", *[F.col(c).alias(f"{c}a") for c in cols], *[(F.col(f"{c}t") - F.col(c)).alias(f"{c}b") for c in cols])
    seen = whole.select("grp", F.col("nt").cast("long").alias("n"), *[F.col(f"{c}a") for c in cols], *[(F.col(f"{c}t") - F.col(f"{c}a")).alias(f"{c}b") for c in cols]).select("grp", "n", (pearson("a") - pearson("b")).alias("estimate"))
    d = first.select("grp", (pearson("a") - pearson("b")).alias("m")).join(seen, "grp")
    return d.groupBy("grp", "n", "estimate").agg(((F.count_if(F.abs("m") >= F.abs("estimate") - 1e-12) + 1) / (F.count("m") + 1)).alias("p_value"))


def hash_text(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    if not df > 0 or t != t:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for k in (even, odd):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - front * f if flip else front * f


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(float(a), float(b)) for a, b in zip(t, df, strict=True)])


def paired_t(df: DataFrame, group: str, difference: str) -> DataFrame:
    """grp, n, mean, t, p_value of a mean of differences against 0; no spread gives t 0 and p 1."""
    d = df.where(F.col(difference).isNotNull()).groupBy(F.col(group).cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg(difference).alias("mean"), F.stddev_samp(difference).alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0)
    return d.withColumn("t", t).select("grp", "n", "mean", "t", F.when(F.col("sd") > 0, t_p_value("t", (F.col("n") - 1).cast("double"))).otherwise(1.0).alias("p_value"))


def normal_quantile(p: float) -> float:
    """Place below which a standard normal lies with probability p, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def power_of(r: float, se: float, alpha: float = 0.05) -> float:
    """Chance that a two-sided Wald test of a correlation r with standard error `se` rejects."""
    z, shift = normal_quantile(1 - alpha / 2), abs(r) / se
    tail = lambda x: 0.5 * math.erfc(x / math.sqrt(2))
    return tail(z - shift) + tail(z + shift)


def sample_needed(r: float, power: float = 0.8, alpha: float = 0.05) -> float:
    """Rows that a test of a correlation needs for a power, by Fisher's z."""
    return ((normal_quantile(1 - alpha / 2) + normal_quantile(power)) / math.atanh(abs(r))) ** 2 + 3


POWER = T.StructType([T.StructField(c, T.DoubleType()) for c in ("r", "n", "se", "power", "inflation", "needed_independent", "needed_dependent", "seasons")])


def power_report(slopes: DataFrame, per_season: int = 380) -> DataFrame:
    """One row per (n, r, r_variance): power now, how much dependence inflates the error, rows and seasons needed for 80 %."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, r, v in zip(pdf["n"], pdf["r"], pdf["r_variance"], strict=True):
                se = math.sqrt(max(v, 0.0))
                ok = r == r and 0 < abs(r) < 1 and se > 0 and n > 3
                inflation = se * math.sqrt(n - 1) / math.sqrt(1 - r * r) if ok else math.nan
                free = sample_needed(r) if ok else math.nan
                need = free * inflation**2 if ok else math.nan
                out.append((r, float(n), se, power_of(r, se) if ok else math.nan, inflation, free, need, float(max(0, math.ceil((need - n) / per_season))) if ok else math.nan))
            yield pd.DataFrame(out, columns=[f.name for f in POWER.fields])

    return slopes.select("n", "r", "r_variance").mapInPandas(run, POWER)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: the sum over all tables no likelier than this one."""
    n, r, k = a + b + c + d, a + b, a + c
    log = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(n - r + 1) - math.lgamma(k - x + 1) - math.lgamma(n - r - k + x + 1)
    base = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    ps = [math.exp(log(x) - base) for x in range(max(0, k - (n - r)), min(r, k) + 1)]
    here = math.exp(log(a) - base)
    return min(1.0, sum(p for p in ps if p <= here * (1 + 1e-7)))


def chi2_two_by_two(a: int, b: int, c: int, d: int) -> float:
    """p of the chi-square test without correction."""
    n = a + b + c + d
    den = (a + b) * (c + d) * (a + c) * (b + d)
    return 1.0 if den == 0 else math.erfc(math.sqrt(n * (a * d - b * c) ** 2 / den / 2))


@F.pandas_udf(T.DoubleType())
def association_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    def one(w: int, x: int, y: int, z: int) -> float:
        return fisher_exact(w, x, y, z) if min(w, x, y, z) < 5 else chi2_two_by_two(w, x, y, z)

    return pd.Series([one(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)])


def two_by_two(df: DataFrame, group: str, flag: str, outcome: str) -> DataFrame:
    """Cell counts, both rates, their difference with a Wald interval, and the p value per group."""
    f, y = F.col(flag), F.col(outcome)
    cells = df.where(f.isNotNull() & y.isNotNull()).groupBy(group).agg(F.count_if(f & y).alias("a"), F.count_if(f & ~y).alias("b"), F.count_if(~f & y).alias("c"), F.count_if(~f & ~y).alias("d"))
    n1, n0 = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    p1, p0 = F.try_divide(F.col("a"), n1), F.try_divide(F.col("c"), n0)
    se = F.sqrt(F.try_divide(p1 * (1 - p1), n1) + F.try_divide(p0 * (1 - p0), n0))
    return cells.select(group, "a", "b", "c", "d", p1.alias("rate_with"), p0.alias("rate_without"), (p1 - p0).alias("difference"), (p1 - p0 - 1.959963984540054 * se).alias("low"), (p1 - p0 + 1.959963984540054 * se).alias("high"), association_p("a", "b", "c", "d").alias("p_value"))


def holm(df: DataFrame, p: str, order: str, alpha: float = 0.05) -> DataFrame:
    """Add `rejected` by the step-down rule: all smaller p values must pass theirs too."""
    ranked = df.withColumn("_i", F.row_number().over(Window.orderBy(p, order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    ok = (F.col(p) <= alpha / (F.col("_n") - F.col("_i") + 1)).cast("int")
    return ranked.withColumn("rejected", F.min(ok).over(Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_i", "_n")


def dyadic_slope(df: DataFrame, x: str, y: str, left: str, right: str) -> DataFrame:
    """OLS slope of y on x with a variance that lets rows sharing a member depend on each other.

    The sum over all pairs sharing a member is taken from sums per member and
    per pair of members, never from the pairs: rows sharing exactly one member
    count once, rows with the same two members once too.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in (x, y, left, right))).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(left).alias("l"), F.col(right).alias("r"))
    m = rows.agg(F.struct(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))).scalar()
    slope = m["c"] / m["v"]
    score = (F.col("x") - m["mx"]) * (F.col("y") - m["my"] - slope * (F.col("x") - m["mx"]))
    s = rows.select("l", "r", score.alias("g"))
    member = s.select(F.explode(F.array_distinct(F.array("l", "r"))).alias("k"), "g").groupBy("k").agg(F.sum("g").alias("t"))
    pair = s.where("l <> r").groupBy(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).agg(F.sum("g").alias("t"))
    meat = member.agg(F.sum(F.col("t") * F.col("t"))).scalar() - F.coalesce(pair.agg(F.sum(F.col("t") * F.col("t"))).scalar(), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("x", "y") / F.var_pop("x")).alias("slope"), F.corr("x", "y").alias("r"), F.var_pop("x").alias("_v")).select("n", "slope", "r", F.try_divide(meat, F.pow(F.col("n") * F.col("_v"), 2)).alias("slope_variance"))
