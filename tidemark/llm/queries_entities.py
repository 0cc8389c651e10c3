"""Queries of problem 6: markets and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import entities
from tidemark.plans import registry
from tidemark.session import table

R = registry.new()


def best_matches(spark: SparkSession, sf: str) -> DataFrame:
    return entities.match_markets(table(spark, sf, "markets"), table(spark, sf, "football_data_matches"))


@R.query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return best_matches(spark, sf).where("accepted").select("match_id", "market_id")


@R.query("p6_confidence")
def p6_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each market's best match with its cosine, score and calibrated confidence."""
    return best_matches(spark, sf).where("accepted").select("match_id", "market_id", "cosine", "score", "confidence")
