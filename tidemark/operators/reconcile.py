"""Joining, comparing and merging two descriptions of the same records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str) -> DataFrame:
    """Key, both ids and status of a reconciliation that accepts keys unique on both sides.

    status: matched, left_only, right_only, or duplicate where either side has
    the key more than once (neither matched nor unmatched).  Keys with a NULL
    part match nothing and are left out.
    """
    def side(df: DataFrame, i: str, n: str, out: str) -> DataFrame:
        full = df.where(" and ".join(f"`{k}` is not null" for k in key))
        return full.groupBy(*key).agg(F.count(F.lit(1)).alias(n), F.min(i).alias(out))

    both = side(left, left_id, "nl", "left_id").join(side(right, right_id, "nr", "right_id"), key, "full_outer")
    status = F.when((F.col("nl") > 1) | (F.col("nr") > 1), "duplicate").when(F.col("nr").isNull(), "left_only").when(F.col("nl").isNull(), "right_only").otherwise("matched")
    one = F.col("status") == "matched"
    return both.withColumn("status", status).select(*key, F.when(one | (F.col("status") == "left_only"), F.col("left_id")).alias("left_id"), F.when(one | (F.col("status") == "right_only"), F.col("right_id")).alias("right_id"), "status")


def diff(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """key, change: new, missing, modified or unchanged, by comparing content with NULLs equal."""
    a = old.select(F.col(key).alias("_k"), F.struct(*content).alias("_a"))
    b = new.select(F.col(key).alias("_k"), F.struct(*content).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "missing").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
    return a.join(b, "_k", "full_outer").select(F.col("_k").alias(key), kind.alias("change"))


def insert_only_merge(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """old plus the records only new has; any modified or missing record refuses the whole batch."""
    changes = diff(old, new, key, content)
    bad = changes.agg(F.count_if(F.col("change").isin("modified", "missing"))).scalar()
    fresh = new.join(changes.where("change = 'new'").select(key), key, "left_semi")
    merged = old.unionByName(fresh.select(*old.columns))
    return merged.where(F.when(bad > 0, F.raise_error(F.lit("merge refused: modified or missing records")).cast("boolean")).otherwise(True))


def keep_first(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row per key in a total order; NULL key parts are values of their own."""
    named = {f"_k{i}": k for i, k in enumerate(key)}
    w = Window.partitionBy(*named).orderBy(*order)
    return df.withColumns(named).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", *named)


def coverage(names: DataFrame, known: DataFrame, name: str, known_name: str) -> DataFrame:
    """name, resolved: whether each distinct non-NULL name is in the known list."""
    k = known.select(F.col(known_name).alias("_n")).where("_n is not null").distinct().withColumn("_hit", F.lit(True))
    d = names.select(name).where(F.col(name).isNotNull()).distinct()
    return d.join(k, F.col(name) == F.col("_n"), "left").select(name, F.coalesce("_hit", F.lit(False)).alias("resolved"))


def interval_match(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, left_id: str, right_id: str, within: int) -> DataFrame:
    """left_id, status, candidates: right rows of the same key whose time is at most `within` units away.

    Times are meet by bucket of `within` units and its neighbours, so a hot key
    is split by time.  status is MATCHED, AMBIGUOUS or UNMATCHED.
    """
    lt = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(left_at) / within) + d for d in (-1, 0, 1)])))
    rt = right.withColumn("_b", F.floor(F.col(right_at) / within))
    on = [*key, "_b"]
    hits = lt.select(*on, F.col(left_id).alias("left_id"), F.col(left_at).alias("_lt")).join(rt.select(*on, F.col(right_id).alias("right_id"), F.col(right_at).alias("_rt")), on).where(F.abs(F.col("_lt") - F.col("_rt")) <= within)
    per = hits.groupBy("left_id").agg(F.count(F.lit(1)).alias("n"), F.min("right_id").alias("first_candidate"))
    status = F.when(F.col("n").isNull(), "UNMATCHED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("MATCHED")
    return left.select(F.col(left_id).alias("left_id")).join(per, "left_id", "left").select("left_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("candidates"), "first_candidate")


def nearest_rank(values: Column, share: float) -> Column:
    """Element of a sorted array at position round(share * (n - 1)), halves to even."""
    return F.element_at(values, (F.bround(F.lit(share) * (F.size(values) - 1), 0) + 1).cast("int"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, fingerprint): a hash of the content that no row or file order changes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.pmod(F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).alias("fingerprint"))
