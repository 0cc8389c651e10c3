"""What changed between consecutive full snapshots (problem 1).

Method: within each snapshot the rows are sorted by key and cut into
content-defined chunks (a cut falls where a row's own hash says so, so an edit
moves no other cut).  Chunks whose digest also occurs in the neighbouring
snapshot are discarded unseen; only rows of unmatched chunks are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import fingerprint
from tidemark.session import cut


@dataclass(frozen=True)
class SnapshotSpec:
    """Columns of a delivery log of full snapshots."""

    group: str = "feed"
    number: str = "snapshot_no"
    key: str = "id"
    delivered: str = "delivered_at"
    row_order: str = "row_no"
    #: A row ends a chunk when its hash is 0 modulo this; the mean chunk length.
    chunk_rows: int = 16
    #: Rows per key block, the unit that one task sorts, about at most.
    block_rows: int = 50_000


def delivered_rows(df: DataFrame, spec: SnapshotSpec, content: list[Column]) -> DataFrame:
    """Rows as (g, n, k, at, o, c1, c2); NULL delivery times and row numbers sort lowest.

    Rows without group or snapshot number belong to no snapshot and are left out.
    """
    c1, c2 = fingerprint(*content)
    return df.select(
        F.col(spec.group).alias("g"),
        F.col(spec.number).alias("n"),
        F.col(spec.key).alias("k"),
        F.coalesce(F.col(spec.delivered).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"),
        F.coalesce(F.col(spec.row_order).cast("long"), F.lit(-(2**63) + 1)).alias("o"),
        c1.alias("c1"),
        c2.alias("c2"),
    ).where("g is not null and n is not null")


def arrivals(rows: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """One row per snapshot that arrived: g, n, at (its last delivery), blocks (of its group), seq, next_n.

    All snapshots of a group have the same number of key blocks, as many as
    the rows of its largest delivery need.
    """
    per = rows.groupBy("g", "n", "at").agg(F.count(F.lit(1)).alias("rows"))
    last = per.groupBy("g", "n").agg(F.max("at").alias("at"), F.max("rows").alias("rows"))
    order = Window.partitionBy("g").orderBy("n")
    blocks = F.greatest(F.ceil(F.max("rows").over(Window.partitionBy("g")) / spec.block_rows), F.lit(1))
    return last.select("g", "n", "at", blocks.alias("blocks"), F.row_number().over(order).alias("seq"), F.lead("n").over(order).alias("next_n"))


def effective_rows(rows: DataFrame, arrived: DataFrame) -> DataFrame:
    """One row (g, n, k, c1, c2, blocks) per key of the delivery that holds.

    The delivery with the greatest delivery time holds; within it the greatest
    row number per key.  Rows without key cannot be compared and are left out
    (though they show that a delivery arrived).  Rows tied on both are told
    apart by their content hash, so the result is defined.
    """
    last = rows.where("k is not null").join(arrived.select("g", "n", "at", "blocks"), ["g", "n", "at"])
    return (
        last.groupBy("g", "n", "k")
        .agg(F.max(F.struct("o", "c1", "c2")).alias("r"), F.first("blocks").alias("blocks"))
        .select("g", "n", "k", F.col("r.c1").alias("c1"), F.col("r.c2").alias("c2"), "blocks")
    )


def chunked(rows: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Add block b and chunk number to key-sorted rows.

    Blocks are ranges of the hashed key, so no task sorts a whole snapshot and
    a feed that holds most of the rows is spread like any other.
    """
    h = F.xxhash64("k")
    block = Window.partitionBy("g", "n", "b").orderBy("h", "k")
    cut_after = F.pmod(F.xxhash64("k", "c1"), F.lit(spec.chunk_rows)) == 0
    return (
        rows.withColumn("h", h)
        .withColumn("b", F.pmod(F.shiftrightunsigned("h", 40), F.col("blocks")))
        .withColumn("chunk", F.coalesce(F.sum(cut_after.cast("long")).over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("g", "n", "b", "chunk", "k", "c1", "c2")
    )


def snapshot_changes(df: DataFrame, spec: SnapshotSpec, content: list[Column]) -> DataFrame:
    """Rows (group, number, key, change_kind) between consecutive arrived snapshots.

    The first snapshot of a group has no rows.  Snapshot numbers that never
    arrived are skipped: each is compared with the one before it that arrived.
    """
    delivered = delivered_rows(df, spec, content)
    # One row per snapshot, read three times below.
    arrived = cut(arrivals(delivered, spec))
    # Read for the digests and again for the rows of unmatched chunks; written once in between.
    rows = cut(chunked(effective_rows(delivered, arrived), spec))
    d1, d2 = fingerprint(F.col("k"), F.col("c1"), F.col("c2"))
    digests = rows.groupBy("g", "n", "b", "chunk").agg(F.bit_xor(d1).alias("d1"), F.bit_xor(d2).alias("d2"), F.count(F.lit(1)).alias("size"))
    same = Window.partitionBy("g", "b", "d1", "d2", "size").orderBy("seq")
    flagged = (
        digests.join(arrived.select("g", "n", "seq", "next_n"), ["g", "n"])
        .withColumns({"in_prev": F.coalesce(F.lag("seq").over(same) == F.col("seq") - 1, F.lit(False)), "in_next": F.coalesce(F.lead("seq").over(same) == F.col("seq") + 1, F.lit(False))})
        .where("not (in_prev and in_next)")
        .select("g", "n", "b", "chunk", "seq", "next_n", "in_prev", "in_next")
    )
    open_rows = cut(rows.join(flagged, ["g", "n", "b", "chunk"]))
    new = open_rows.where("not in_prev and seq > 1").select("g", "n", "k", F.struct("c1", "c2").alias("new"))
    old = open_rows.where("not in_next and next_n is not null").select("g", F.col("next_n").alias("n"), "k", F.struct("c1", "c2").alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return (
        new.join(old, ["g", "n", "k"], "full_outer")
        .select(F.col("g").alias(spec.group), F.col("n").alias(spec.number), F.col("k").alias(spec.key), kind.alias("change_kind"))
        .where("change_kind is not null")
    )
