"""Ordered money paths and positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def running_balance(bets: DataFrame, key: list[str], order: list[str], profit: str, start: float) -> DataFrame:
    """Add balance, its running peak and the drawdown (balance / peak - 1) along each key's order."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    b = bets.withColumn("balance", F.lit(start) + F.sum(profit).over(w))
    return b.withColumn("peak", F.greatest(F.lit(start), F.max("balance").over(w))).withColumn("drawdown", F.try_divide(F.col("balance"), F.col("peak")) - 1)


def path_metrics(path: DataFrame, key: list[str], order: list[str], start: float) -> DataFrame:
    """Bets, final balance, return, worst drawdown, volatility of step returns and win rate per key."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.coalesce(F.lag("balance").over(w), F.lit(start))
    step = F.when((before > 0) & (F.col("balance") > 0), F.col("balance") / before - 1)
    rows = path.withColumns({"_step": step, "_won": (F.col("balance") > before).cast("double"), "_order": F.struct(*order)})
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("bets"), F.max_by("balance", "_order").alias("final_balance"), (F.max_by("balance", "_order") / start - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"), F.stddev_pop("_step").alias("volatility"), F.avg("_won").alias("win_rate"))


SIM = T.StructType([T.StructField("sim", T.LongType()), T.StructField("strategy", T.StringType()), T.StructField("final_balance", T.DoubleType()), T.StructField("max_drawdown", T.DoubleType()), T.StructField("ruined", T.BooleanType())])


def simulate_paths(spark, sims: int, bets: int, p: float, price: float, start: float = 100.0, flat: float = 1.0, fraction: float = 0.02, seed: int = 42) -> DataFrame:  # noqa: ANN001
    """Final balances of flat and proportional stakes on the same simulated outcomes, one seed per path; all paths of a batch step together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            won = np.array([np.random.default_rng([seed, int(sim)]).random(bets) < p for sim in pdf["id"]]).reshape(len(pdf), bets)
            for name in ("flat", "proportional"):
                balance, peak, worst = (np.full(len(pdf), x) for x in (start, start, 0.0))
                for k in range(bets):
                    stake = np.clip(flat if name == "flat" else balance * fraction, 0.0, balance)
                    balance = balance + np.where(won[:, k], stake * (price - 1), -stake)
                    peak = np.maximum(peak, balance)
                    worst = np.minimum(worst, balance / peak - 1)
                yield pd.DataFrame({"sim": pdf["id"].to_numpy(), "strategy": name, "final_balance": balance, "max_drawdown": worst, "ruined": balance <= 0})

    return spark.range(sims).mapInPandas(run, SIM)


def summarise_paths(paths: DataFrame, start: float = 100.0) -> DataFrame:
    return paths.groupBy("strategy").agg(F.count(F.lit(1)).alias("paths"), F.median("final_balance").alias("median_final"), F.avg("final_balance").alias("mean_final"), F.avg(F.col("ruined").cast("double")).alias("ruin_share"), F.median("max_drawdown").alias("median_drawdown"), F.stddev_pop(F.col("final_balance") / start - 1).alias("return_sd"))


def positions_as_of(trades: DataFrame, key: list[str], at: str, before: Column, side: Column, size: str) -> DataFrame:
    """Net signed size per key from trades strictly before a moment; other sides than buy and sell raise."""
    sign = F.when(side == "buy", 1).when(side == "sell", -1).otherwise(F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce(side, F.lit("NULL")))).cast("int"))
    return trades.where(F.col(at) < before).groupBy(*key).agg(F.sum(sign * F.col(size)).alias("net_size"), F.count(F.lit(1)).alias("n_trades"), F.max(at).alias("last_at"))


def settled_profit(side: Column, price: Column, size: Column, won: Column) -> Column:
    """Profit of a trade of a settled market: sign x (1 if the outcome won - price) x size."""
    return F.when(side == "buy", 1).otherwise(-1) * (won.cast("double") - price) * size
