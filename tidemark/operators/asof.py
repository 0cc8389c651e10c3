"""Attributes as known at event time (problem 4).

Method: per entity the versions become a change log of the value that was
believed at each moment; the believed value is materialised at the start of
each period (the snapshot).  An event meets the snapshot of its own period and
only the changes inside that period are replayed up to its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_log(versions: DataFrame, entity: str, known: str, rank: list[str], payload: list[str]) -> DataFrame:
    """Rows (e, t, p, best): the moments at which the believed version changes.

    A version is believed from the moment it is known until a version with a
    greater rank is known.  Versions with no entity, no known time or a NULL
    first rank column are never visible.
    """
    best = F.struct(*[F.col(c) for c in rank], *[F.col(c) for c in payload if c not in rank])
    rows = versions.where(F.col(entity).isNotNull() & F.col(known).isNotNull() & F.col(rank[0]).isNotNull())
    at_once = rows.groupBy(F.col(entity).alias("e"), F.col(known).alias("t")).agg(F.max(best).alias("best"))
    w = Window.partitionBy("e").orderBy("t")
    top = F.max("best").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max("best").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return at_once.select("e", "t", top.alias("best"), before.alias("before")).where("before is null or best > before").drop("before")


def period_of(t: Column, seconds: int) -> Column:
    """Number of the period that holds a timestamp without zone."""
    return F.floor(F.unix_timestamp(t.cast("timestamp")) / F.lit(seconds)).cast("long")


def as_known_join(
    events: DataFrame,
    entity: str,
    at: str,
    carry: list[str],
    log: DataFrame,
    period_s: int = 7 * 86400,
    hot_rows: int = 2_000_000,
    hot_groups: int = 1000,
) -> DataFrame:
    """Events with the version believed at their time (columns carry + best); others are left out.

    A version known exactly at the event's time counts.  Groups are (entity,
    period).  Where one group holds more than the hot limit, its events are
    salted and its snapshot and changes repeated per salt; the limit grows with
    the table so that at most `hot_groups` groups are hot, which bounds the
    broadcast list.  Events without entity or time match nothing.
    """
    ev = events.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(
        F.col(entity).alias("e"), F.col(at).alias("t"), period_of(F.col(at), period_s).alias("p"), F.struct(*carry).alias("c")
    )
    changes = log.select("e", "t", period_of(F.col("t"), period_s).alias("p"), "best")

    sizes = ev.groupBy("e", "p").agg(F.count(F.lit(1)).alias("rows"))
    # Snapshots: the believed version at the start of every period that has events.
    ends = changes.groupBy("e", "p").agg(F.max("best").alias("end_best"))
    w = Window.partitionBy("e").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    spine = sizes.select("e", "p", "rows").join(ends, ["e", "p"], "full_outer")
    snaps = spine.select("e", "p", "rows", F.max("end_best").over(w).alias("best")).where("rows is not null")
    return _replay(ev, changes, snaps, hot_rows, hot_groups).select("c.*", "best")


def _replay(ev: DataFrame, changes: DataFrame, snaps: DataFrame, hot_rows: int, hot_groups: int) -> DataFrame:
    all_rows = snaps.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    per_salt = F.greatest(F.lit(hot_rows), F.ceil(all_rows / F.lit(hot_groups)))
    hot = F.broadcast(snaps.select("e", "p", F.ceil(F.col("rows") / per_salt).cast("int").alias("salts")).where("salts > 1"))

    def spread(df: DataFrame) -> DataFrame:
        salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        return df.join(hot, ["e", "p"], "left").withColumn("s", F.explode(salts)).drop("salts")

    salted = ev.join(hot, ["e", "p"], "left").withColumn("s", F.pmod(F.xxhash64("c"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int"))
    none = F.lit(None)
    ctype = ev.schema["c"].dataType
    btype = changes.schema["best"].dataType
    stream = (
        salted.select("e", "p", "s", "t", F.lit(2).alias("o"), "c", none.cast(btype).alias("best"))
        .unionByName(spread(changes.join(snaps.select("e", "p"), ["e", "p"], "left_semi")).select("e", "p", "s", "t", F.lit(1).alias("o"), none.cast(ctype).alias("c"), "best"))
        .unionByName(spread(snaps.where("best is not null").select("e", "p", "best")).select("e", "p", "s", none.cast("timestamp_ntz").alias("t"), F.lit(0).alias("o"), none.cast(ctype).alias("c"), "best"))
    )
    w = Window.partitionBy("e", "p", "s").orderBy(F.col("t").asc_nulls_first(), "o").rowsBetween(Window.unboundedPreceding, 0)
    # The believed version only ever rises in rank, so the last change replayed is the greatest one.
    return stream.select("o", "c", F.max("best").over(w).alias("best")).where("o = 2 and best is not null")
