"""Calibration and reliability of forecasts as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scoring import binary_brier, binary_log_loss, right_closed_bin
from tidemark.operators import ranks
from tidemark.operators.pit import running_as_of


def bin_rows(df: DataFrame, p: str, y: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Per bin: n, mean forecast, mean outcome (only bins with rows).  Rows with NULL p or y are left out."""
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", right_closed_bin(F.col(p), bins))
    return rows.groupBy(*(by or []), "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """All bins 0..bins-1 in the table, empty ones with n = 0 and NULL means."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(bin_rows(df, p, y, bins), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y")


def murphy(df: DataFrame, p: str, y: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Reliability, resolution, uncertainty and their sum, with ECE, from one pass over the bins."""
    by = by or []
    b = bin_rows(df, p, y, bins, by)
    n = F.col("n")
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    base = F.sum(n * F.col("mean_y")).over(w) / F.sum(n).over(w)
    b = b.withColumn("base", base)
    total = F.sum("n")
    return b.groupBy(*by).agg(
        total.alias("n"),
        (F.sum(n * F.pow(F.col("mean_p") - F.col("mean_y"), 2)) / total).alias("reliability"),
        (F.sum(n * F.pow(F.col("mean_y") - F.col("base"), 2)) / total).alias("resolution"),
        F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
        (F.sum(n * F.abs(F.col("mean_p") - F.col("mean_y"))) / total).alias("ece"),
    )


def decreases(bins: DataFrame, order: str, value: str) -> DataFrame:
    """Number of falls of `value` from one filled bin to the next."""
    d = F.col(value) - F.lag(value).over(Window.orderBy(order))
    return bins.where(F.col(value).isNotNull()).withColumn("d", d).agg(F.count_if(F.col("d") < 0).alias("violations"))


def quantile_bin(df: DataFrame, x: str, parts: int, by: list[str] | None = None) -> DataFrame:
    """Add `part`: index of the interpolated quantile interval (lo, hi], the lowest value included.

    Without groups the edges come from counts per value, range by range; with
    groups from one aggregate per group.  Equal edges leave parts empty.
    """
    if not by:
        edges = ranks.quantiles(df, x, [i / parts for i in range(1, parts)])
        return df.withColumn("part", sum((F.coalesce((e < F.col(x)).cast("int"), F.lit(0)) for e in edges), F.lit(0)))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    edges = df.groupBy(*by).agg(F.percentile(x, shares).alias("_edges"))
    return df.join(edges, by).withColumn("part", F.size(F.filter("_edges", lambda e: e < F.col(x)))).drop("_edges")


def walk_forward_scale(df: DataFrame, key: list[str], at: str, actual: str, expected: str, least: int = 30) -> DataFrame:
    """Add `scale`: sum(actual) / sum(expected) over the key's rows strictly before; NULL with fewer than `least` of them."""
    facts = df.select(*key, F.col(at).alias("_known"), F.col(actual).alias("_a"), F.col(expected).alias("_e"), F.col(actual).isNotNull().cast("int").alias("_one"))
    d = running_as_of(facts, df, key, "_known", at, {"_sa": "_a", "_se": "_e", "_n": "_one"}, strict=True)
    return d.withColumn("scale", F.when(F.col("_n") >= least, F.try_divide("_sa", "_se"))).drop("_sa", "_se", "_n")


def chronological_split(df: DataFrame, group: list[str], order: list[str], shares: tuple[float, float] = (0.4, 0.3)) -> DataFrame:
    """Add `split`: burn_in, calibration or test by position in time, sizes cut to whole rows."""
    w = Window.partitionBy(*group)
    i = F.row_number().over(w.orderBy(*order))
    n = F.count(F.lit(1)).over(w)
    a, b = F.floor(n * shares[0]), F.floor(n * shares[1])
    return df.withColumn("split", F.when(i <= a, "burn_in").when(i <= a + b, "calibration").otherwise("test"))


def pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit of y in the given order."""
    level, weight, size = [], [], []
    for v, k in zip(y, w, strict=True):
        level.append(float(v))
        weight.append(float(k))
        size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            t = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / t
            weight[-2] = t
            size[-2] += size[-1]
            for x in (level, weight, size):
                x.pop()
    return np.repeat(level, size)


ISOTONIC = T.StructType([T.StructField("grp", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("fitted", T.DoubleType())])


def isotonic_curve(df: DataFrame, group: str, p: str, y: str) -> DataFrame:
    """Calibration curve per group: (grp, x, fitted), non-decreasing in x.

    Equal forecasts are first combined, unrounded: forecasts of k digits reach
    their task as at most 10^k + 1 rows whatever the group's size.
    """
    small = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).cast("string").alias("grp"), F.col(p).alias("x")).agg(F.avg(F.col(y).cast("double")).alias("y"), F.count(F.lit(1)).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        return pd.DataFrame({"grp": pdf["grp"], "x": pdf["x"], "fitted": pava(pdf["y"].to_numpy(), pdf["w"].to_numpy())})

    return small.groupBy("grp").applyInPandas(run, ISOTONIC)


COX = T.StructType([T.StructField("grp", T.StringType()), T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType()), T.StructField("n", T.LongType())])


def irls(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(x.shape[1])
        d = np.linalg.solve(h, x.T @ (w * (y - p)))
        b = b + np.clip(d, -4, 4)
        if np.abs(d).max() < 1e-10:
            break
    return b


def logistic_recalibration(df: DataFrame, group: str, p: str, y: str) -> DataFrame:
    """Intercept and slope of logit(outcome) on logit(forecast) per group, equal forecasts combined unrounded."""
    small = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).cast("string").alias("grp"), F.col(p).alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.clip(pdf["x"].to_numpy(), 1e-6, 1 - 1e-6)
        b = irls(np.column_stack([np.ones(len(q)), np.log(q / (1 - q))]), pdf["y"].to_numpy(), pdf["w"].to_numpy(dtype=float))
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "intercept": [b[0]], "slope": [b[1]], "n": [int(pdf["w"].sum())]})

    return small.groupBy("grp").applyInPandas(run, COX)


WALKED = T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("trained_on", T.LongType())])


def walk_forward_logistic(df: DataFrame, group: str, at: str, period: int, x: list[str], y: str, id_column: str, offset: str | None = None, least: int = 50) -> DataFrame:
    """(id, p, trained_on): forecast of each row by a logistic fit on its group's rows of earlier periods.

    A period is `period` units of `at`; refits begin from the last coefficients.
    NULL before `least` training rows.  Rows of a period with equal covariates,
    offset and outcome are first combined (by their hash), so a task holds distinct rows only.
    With an offset its coefficient is fixed at 1.
    """
    named = {f"_x{i}": F.col(c).cast("double") for i, c in enumerate(x)} | {"_o": F.col(offset).cast("double") if offset else F.lit(0.0)}
    rows = df.where(F.col(at).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.floor(F.col(at) / period).cast("long").alias("t"), F.col(id_column).cast("long").alias("id"), F.col(y).cast("double").alias("y"), *[c.alias(n) for n, c in named.items()])
    full = rows.where(" and ".join(f"{n} is not null" for n in named))
    cells = full.groupBy("grp", "t", *named).agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.collect_list("id").alias("ids"))
    order = ["t", *named]
    columns = [n for n in order[1:] if n != "_o"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        d = np.column_stack([np.ones(len(pdf)), *[pdf[c] for c in columns]])
        o, n, s, t = (pdf[c].to_numpy(dtype=float) for c in ("_o", "n", "s", "t"))
        p, seen, beta = np.full(len(pdf), np.nan), np.zeros(len(pdf)), np.zeros(d.shape[1])
        for start in np.unique(t):
            past = t < start
            rows_now = t == start
            held = n[past].sum()
            seen[rows_now] = held
            if held < least:
                continue
            beta = newton(d[past], s[past], n[past], o[past], beta)
            p[rows_now] = 1 / (1 + np.exp(-np.clip(d[rows_now] @ beta + o[rows_now], -30, 30)))
        ids = pdf["ids"].tolist()
        size = [len(i) for i in ids]
        return pd.DataFrame({"id": np.concatenate(ids) if ids else [], "p": np.repeat(p, size), "trained_on": np.repeat(seen, size).astype("int64")})

    return cells.groupBy("grp").applyInPandas(run, WALKED).withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def newton(x: np.ndarray, s: np.ndarray, n: np.ndarray, offset: np.ndarray, beta: np.ndarray, steps: int = 40) -> np.ndarray:
    """Logistic coefficients from successes s of n trials per row, from a starting point."""
    b = beta.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b + offset, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (s - n * p))
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-10:
            break
    return b


def apply_isotonic(df: DataFrame, curve: DataFrame, group: str, p: str) -> DataFrame:
    """Add `calibrated`: each forecast read off its group's curve, straight lines between its points and flat beyond its ends.

    Forecasts meet the curve's points along the sorted line of their group, not as pairs.
    """
    c = curve.select(F.col("grp").alias("_g"), F.col("x").alias("_x"), F.struct("x", "fitted").alias("_at"))
    asked = df.select(F.col(group).cast("string").alias("_g"), F.col(p).alias("_x")).where("_x is not null").distinct().withColumn("_asked", F.lit(True))
    line = asked.unionByName(c, allowMissingColumns=True).groupBy("_g", "_x").agg(F.max("_at").alias("_at"), F.bool_or("_asked").alias("_asked"))
    w = Window.partitionBy("_g").orderBy("_x")
    lo = F.last("_at", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first("_at", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    line = line.select("_g", "_x", "_asked", lo.alias("lo"), hi.alias("hi")).where("_asked")
    between = F.col("lo.fitted") + (F.col("hi.fitted") - F.col("lo.fitted")) * F.try_divide(F.col("_x") - F.col("lo.x"), F.col("hi.x") - F.col("lo.x"))
    value = F.when(F.col("lo").isNull(), F.col("hi.fitted")).when(F.col("hi").isNull() | (F.col("lo.x") == F.col("hi.x")), F.col("lo.fitted")).otherwise(between)
    read = line.select("_g", "_x", value.alias("calibrated"))
    return df.join(read, (F.col(group).cast("string") == F.col("_g")) & (F.col(p) == F.col("_x")), "left").drop("_g", "_x")


def category_table(df: DataFrame, category: str, p: str, y: str) -> DataFrame:
    """Per category n, mean forecast and outcome, bias with its normal 95 % interval, Brier score and log loss."""
    cp, cy = F.col(p), F.col(y).cast("double")
    n = F.count(F.lit(1))
    half = 1.959963984540054 * F.stddev_samp(cp - cy) / F.sqrt(n)
    return df.where(cp.isNotNull() & cy.isNotNull()).groupBy(category).agg(n.alias("n"), F.avg(cp).alias("mean_p"), F.avg(cy).alias("mean_y"), F.avg(cp - cy).alias("bias"), (F.avg(cp - cy) - half).alias("low"), (F.avg(cp - cy) + half).alias("high"), F.avg(binary_brier(cp, cy)).alias("brier"), F.avg(binary_log_loss(cp, cy)).alias("log_loss"))
