"""Parquet tables as registered views, and writing them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """One view per table of a folder; a missing table is an error before any query runs."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_small_json(path: str, rows: list[dict]) -> None:
    """A small JSON file that readers see whole or not at all (written aside, then renamed)."""
    aside = f"{path}.tmp{os.getpid()}"
    with open(aside, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)
