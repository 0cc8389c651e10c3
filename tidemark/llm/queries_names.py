"""Queries of problem 5: typed club names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import clubnames
from tidemark.plans import registry
from tidemark.session import table

R = registry.new()


def typed_names(spark: SparkSession, sf: str) -> DataFrame:
    """source_table, record_id, name, competition; where the competition is missing, what the row's file or tournament says."""
    comp = F.lower(F.trim("competition"))
    from_file = F.regexp_replace(F.lower(F.trim("source_file")), r"(_v\d+)?\.txt$", "")
    from_title = F.regexp_replace(F.lower(F.trim("tournament_name")), r"\s+", "_")
    fixtures = table(spark, sf, "future_fixtures").select(
        F.lit("future_fixtures").alias("source_table"), F.col("fixture_id").alias("record_id"), F.col("home_team_openfootball").alias("name"), F.coalesce(comp, from_file).alias("competition")
    )
    results = table(spark, sf, "ligue1_results").select(
        F.lit("ligue1_results").alias("source_table"), F.col("result_id").alias("record_id"), F.col("home_team").alias("name"), F.coalesce(comp, from_title).alias("competition")
    )
    return fixtures.unionByName(results).where("name is not null")


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    rows = typed_names(spark, sf)
    found = clubnames.match_clubs(rows.select("name", "competition").distinct(), table(spark, sf, "clubs"))
    same = (F.col("r.name") == F.col("f.name")) & F.col("r.competition").eqNullSafe(F.col("f.competition"))
    return rows.alias("r").join(found.alias("f"), same).select("source_table", "record_id", "r.name", "r.competition", "club_id", "jaccard")


@R.query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select("source_table", "record_id", "club_id")


@R.query("p5_unresolved")
def p5_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that no club of the list is meant by, with how often and in how many competitions they occur."""
    lost = resolved(spark, sf).where("club_id = 0")
    return lost.groupBy("source_table", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("competition").alias("competitions"))
