"""Queries of problems 7 and 8: containers and mixtures of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing
from tidemark.llm.tokens import token_count
from tidemark.plans import registry
from tidemark.session import cut, table

R = registry.new()
CAPACITY = 2048


def sized(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Documents with their size, each text encoded once."""
    return table(spark, sf, "documents").select("doc_id", *columns, token_count(F.col("text")).alias("tokens"))


def packed(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.length("text").alias("chars"))
    # Characters are known without reading tokens: about four make one.
    mass = docs.agg(F.sum(F.col("chars").cast("long"))).first()[0] or 0
    return packing.pack(docs.drop("chars"), CAPACITY, max(1, round(mass / 4 / packing.TOPIC_TOKENS)), sizes=True)


@R.query("p7_containers")
def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf)


@R.query("p7_fill")
def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(packed(spark, sf), CAPACITY)


@R.query("p8_mixture")
def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = cut(sized(spark, sf, "source", "lang", "competition"))
    return mixing.mix(docs, table(spark, sf, "mix_targets"))


@R.query("p8_shares")
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.share_report(cut(p8_mixture(spark, sf)), table(spark, sf, "mix_targets"))


@R.query("p8_marginals")
def p8_marginals(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of sources, languages and topics in the mixture, with what each misses."""
    docs = cut(sized(spark, sf, "source", "lang", "competition"))
    targets = table(spark, sf, "mix_targets")
    return mixing.mix_report(mixing.mix(docs, targets), docs, targets)
