"""Queries of problem 9: abusive, hateful or sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import toxicity
from tidemark.plans import registry
from tidemark.session import cut, table

R = registry.new()


def scored(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf, "doc_labels")))


@R.query("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).where("abusive").select("doc_id")


@R.query("p9_scores")
def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's score and the offsets of its offending stretches."""
    return scored(spark, sf)


@R.query("p9_source_rates")
def p9_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.source_rates(cut(scored(spark, sf).drop("spans")), table(spark, sf, "documents"))
