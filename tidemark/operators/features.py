"""Per-entity feature table from events (problem 3).

Method: cumulative counts and totals are stored by entity, type and day; a
window feature is the cumulative value at its end less the one at its start,
recency comes from the greatest timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_row_per_event(events: DataFrame, keys: tuple[Column, Column], order: list[str], carry: list[str]) -> DataFrame:
    """Copies of one event (equal fingerprint) become one row: the first by `order`.

    The shuffle key is the fingerprint, so an entity that holds a third of all
    rows is spread evenly.
    """
    rows = events.select(keys[0].alias("_k1"), keys[1].alias("_k2"), F.struct(*order, *carry).alias("_r"))
    return rows.groupBy("_k1", "_k2").agg(F.min("_r").alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in carry])


def daily(events: DataFrame, entity: str, kind: str, at: str, amount: str) -> DataFrame:
    """Counts, totals and greatest time per entity, type and day, combined before the shuffle."""
    return events.groupBy(entity, kind, F.to_date(at).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"), F.max(at).alias("last_at")
    )


def cumulative(days: DataFrame, entity: str, kind: str) -> DataFrame:
    """The stored form: running count, total and greatest time per entity, type and day.

    A window group is one entity and type with one row per active day, so it is
    bounded by the length of the history, not by the number of events.
    """
    w = Window.partitionBy(entity, kind).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(
        entity, kind, "day", F.sum("n").over(w).alias("cum_n"), F.sum("total").over(w).alias("cum_total"), F.max("last_at").over(w).alias("last_at")
    )


def extended(stored: DataFrame, days: DataFrame, entity: str, kind: str) -> DataFrame:
    """The stored form with later days added: new days continue from the last stored value of their entity and type.

    Days that lie within the stored range would need the rows after them
    changed; they raise.
    """
    last = stored.groupBy(entity, kind).agg(F.max_by(F.struct("day", "cum_n", "cum_total", "last_at"), "day").alias("_last"))
    new = cumulative(days, entity, kind).join(last, [entity, kind], "left")
    late = F.when(F.col("day") <= F.col("_last.day"), F.raise_error(F.lit("a new day lies within the stored days")).cast("int")).otherwise(0)
    zero = lambda c: F.coalesce(F.col(f"_last.{c}"), F.lit(0))
    new = new.select(entity, kind, "day", (F.col("cum_n") + zero("cum_n") + late).alias("cum_n"), (F.col("cum_total") + zero("cum_total")).alias("cum_total"), F.greatest("last_at", "_last.last_at").alias("last_at"))
    return stored.unionByName(new)


def as_of_features(cum: DataFrame, entity: str, kind: str, end: str, windows: dict[str, int | None]) -> DataFrame:
    """Window features per entity and type: everything before day `end`, per window of so many days (None: all).

    Each feature is cumulative(end) - cumulative(start); both endpoints come
    from one aggregate on the stored table's own partitioning.  Windows with no
    event give 0; types with no event before `end` give no row.
    """
    stop = F.to_date(F.lit(end))

    def at(day: Column, value: str) -> Column:
        return F.coalesce(F.max_by(value, F.when(F.col("day") < day, F.col("day"))), F.lit(0))

    aggs = [F.max(F.when(F.col("day") < stop, F.col("last_at"))).alias("last_at")]
    for name, length in windows.items():
        for value, label in (("cum_n", "n"), ("cum_total", "total")):
            upto = at(stop, value)
            aggs.append((upto if length is None else upto - at(F.date_sub(stop, length), value)).cast("long").alias(f"{label}_{name}"))
    return cum.groupBy(entity, kind).agg(*aggs).where("last_at is not null")


def wide_by_entity(features: DataFrame, entity: str, kind: str) -> DataFrame:
    """One row per entity with a map type -> features; a map holds at most one entry per type."""
    rest = [c for c in features.columns if c not in (entity, kind)]
    return features.groupBy(entity).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, F.struct(*rest))))).alias("by_type"))
