"""Recurrences along an order, streamed: a key's rows never lie in memory together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_scan(df: DataFrame, key: str, order: list[str], new_state: Callable[[], object], step: Callable[[object, tuple], tuple], schema: T.StructType) -> DataFrame:
    """One output row per input row: step(state, row) along each key's order.

    Rows are hashed by key and sorted in the JVM (which spills), then pass
    through Python batch by batch; only the state of the current key is held.
    """
    columns = df.columns
    at = columns.index(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c] for c in columns), strict=True):
                if row[at] != current:
                    current, state = row[at], new_state()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
