"""Point-in-time reads: what was known, last, or summed up at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_scan(facts: DataFrame, known: str, at: Column, tie: list[str]) -> DataFrame:
    """Facts known at `at` or before, in a total order.  A NULL knowledge time is never known."""
    return facts.where(F.col(known) <= at).orderBy(known, *tie)


def latest_as_of(facts: DataFrame, key: list[str], known: str, at: Column, strict: bool = False) -> DataFrame:
    """All rows at the greatest knowledge time per key among those known at `at` (strict: before)."""
    seen = facts.where(F.col(known) < at if strict else F.col(known) <= at)
    last = F.max(known).over(Window.partitionBy(*key))
    return seen.withColumn("_last", last).where(F.col("_last") == F.col(known)).drop("_last")


def cumulated(facts: DataFrame, times: DataFrame, key: list[str], known: str, at: str, sums: dict[str, str], strict: bool = False) -> DataFrame:
    """(key, at, sums): totals of all facts of a key known by each of the asked times.

    Facts are first combined per key and instant, asked times made distinct, so
    a key's time line is as long as the calendar has instants, not as its facts
    are many.  At equal times a fact counts unless `strict`.
    """
    per = facts.where(F.col(known).isNotNull()).groupBy(*key, F.col(known).alias("_t")).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).withColumn("_asked", F.lit(False))
    asked = times.select(*key, F.col(at).alias("_t")).where("_t is not null").distinct().withColumn("_asked", F.lit(True))
    line = per.unionByName(asked, allowMissingColumns=True).groupBy(*key, "_t").agg(*[F.sum(n).alias(n) for n in sums], F.bool_or("_asked").alias("_asked"))
    w = Window.partitionBy(*key).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    totals = [F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums]
    return line.select(*key, F.col("_t").alias(at), "_asked", *totals).where("_asked").drop("_asked")


def running_as_of(facts: DataFrame, decisions: DataFrame, key: list[str], known: str, at: str, sums: dict[str, str], strict: bool = False) -> DataFrame:
    """Decisions with the sums over all facts of their key known by then.

    `sums` maps result name -> fact column; a key without facts, or with a NULL
    part or time, gives 0.  Decisions meet their totals on key and time, so a
    key that holds most decisions is spread over its times.
    """
    totals = cumulated(facts, decisions, key, known, at, sums, strict)
    joined = decisions.join(totals, [*key, at], "left")
    return joined.select(*decisions.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in sums])


def scd2_windows(log: DataFrame, key: str, start: str, payload: list[str], order: str) -> DataFrame:
    """Validity windows from a scrape log: first row per key and start day; valid until the day before the next start."""
    day = F.to_date(start)
    first = log.where(F.col(key).isNotNull() & day.isNotNull()).groupBy(key, day.alias("valid_from")).agg(F.min_by(F.struct(*payload), F.struct(start, order)).alias("p"))
    nxt = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    return first.select(key, "valid_from", F.coalesce(F.date_sub(nxt, 1), F.lit("9999-12-31").cast("date")).alias("valid_to"), "p.*")


def scd2_lookup(events: DataFrame, windows: DataFrame, key: str, day: Column, payload: list[str]) -> DataFrame:
    """Events with the attributes of the window that holds their day; NULL where none does.

    Windows are spread over the months they touch, so the join is an equi join
    on key and month with the exact day test behind it.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    ev = events.withColumn("_day", day)
    # Windows that are still open are spread no further than the last event.
    end = F.least(F.col("valid_to"), ev.agg(F.max("_day")).scalar())
    w = windows.where(F.col("valid_from") <= end).withColumn("_month", F.explode(F.sequence(month(F.col("valid_from")), month(end)))).select(F.col(key).alias("_key"), "_month", "valid_from", "valid_to", F.struct(*payload).alias("_p"))
    hit = ev.join(w, (F.col(key) == F.col("_key")) & (month(F.col("_day")) == F.col("_month")) & F.col("_day").between(F.col("valid_from"), F.col("valid_to")), "left")
    return hit.select(*events.columns, *[F.col(f"_p.{c}").alias(c) for c in payload])


def previous_event(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Add the time of the key's event strictly before this one (`previous_at`), NULL for the first."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return events.withColumn("previous_at", F.max(at).over(w))


def counts_before(events: DataFrame, key: str, at: str, lengths: dict[str, int]) -> DataFrame:
    """Add per name the number of the key's events in the `length` units before each event, itself left out."""
    cols = {n: F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(at).rangeBetween(-length, -1)) for n, length in lengths.items()}
    return events.withColumns(cols)


def last_n_rate(events: DataFrame, key: str, at: str, tie: str, flag: Column, n: int) -> Column:
    """Mean of a flag over the key's last n earlier events; NULL with fewer than n."""
    w = Window.partitionBy(key).orderBy(at, tie).rowsBetween(-n, -1)
    return F.when(F.count(F.lit(1)).over(w) == n, F.avg(flag.cast("double")).over(w))
