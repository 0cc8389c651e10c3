"""Typed text exports: CSV, JSON arrays and JSON lines, with bad records kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that holds the raw text of a record that does not fit its schema.
BAD = "_bad"


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line per row in column `value`."""
    return df.select(F.to_csv(F.struct(*df.columns)).alias("value"))


def parse_csv(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Typed columns of CSV lines; a line that does not fit has NULLs and its text in `_bad`."""
    parsed = F.from_csv(F.col(column), f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.select(parsed.alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """CSV files with a header under a stated schema; a missing required column is an error."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    return spark.read.schema(f"{schema}, {BAD} string").option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", BAD).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of objects; anything else fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, torn lines are kept in `_bad`."""
    return spark.read.schema(f"{schema}, {BAD} string").option("columnNameOfCorruptRecord", BAD).json(path)


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def new_only(rows: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """Rows whose key the journal does not hold yet, so that appending twice changes nothing."""
    return rows.join(journal.select(key).distinct(), key, "left_anti")


def first_present(json: Column, paths: list[str]) -> Column:
    """The first non-NULL of several places in a JSON text."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def epoch_or_iso(text: Column) -> Column:
    """Instant of a text that is epoch seconds or an ISO time with zone; a time without zone gives NULL."""
    number = text.try_cast("double")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(number.isNotNull(), F.timestamp_micros((number * 1_000_000).cast("long"))).when(zoned, text.try_cast("timestamp"))


def string_list(text: Column) -> Column:
    """Array from a JSON list kept as text; anything else gives NULL."""
    return F.from_json(text, "array<string>")
