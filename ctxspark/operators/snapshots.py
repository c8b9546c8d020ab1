"""Changes between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: list[Column]) -> Column:
    """Canonical hash of a row's compared values: nulls and empty strings differ, order counts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns])), 256)


def snapshot_changes(
    rows: DataFrame,
    snapshots: DataFrame,
    group: str,
    number: str,
    key: Column,
    compared: list[Column],
    newest: list[Column],
    absent: Column,
    key_name: str = "key",
) -> DataFrame:
    """One row per key that differs between a listed snapshot and the group's previous listed one.

    rows: full snapshots, row by row, in any order and possibly late. snapshots: the (group, number)
    pairs delivered; a listed snapshot is complete even without rows, an unlisted one is ignored.
    If a snapshot lists a key more than once, the row that is greatest by `newest` counts (nulls are
    least; ties end in the row hash, so the result never depends on row order). `absent` marks rows
    that say the key is gone. Result: group, number, key_name, change (new, changed, deleted).

    Rows whose group, number or key is null are in no snapshot. An empty table of rows gives
    deletions of nothing, so no rows. Extra columns are ignored.

    The method is a full outer join on (group, number, key) of each snapshot with the one before it,
    comparing row hashes; the key has the row's own path in it, so no group is hot.
    """
    w = Window.partitionBy(group).orderBy(number)
    listed = (
        snapshots.select(F.col(group).alias("g"), F.col(number).alias("n"))
        .where(F.col("g").isNotNull() & F.col("n").isNotNull())
        .distinct()
    )
    w = Window.partitionBy("g").orderBy("n")
    listed = listed.select("g", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"))
    state = (
        rows.select(
            F.col(group).alias("g"),
            F.col(number).alias("n"),
            key.alias("k"),
            row_hash(compared).alias("h"),
            F.coalesce(absent, F.lit(False)).alias("gone"),
            F.struct(*newest).alias("rank"),
        )
        .where(F.col("k").isNotNull() & (F.col("k") != ""))
        .groupBy("g", "n", "k")
        .agg(F.max_by(F.struct("h", "gone"), F.struct("rank", "h", "gone")).alias("top"))
        .select("g", "n", "k", "top.*")
        .where(~F.col("gone"))
        .join(listed, ["g", "n"])
    )
    now = state.where(F.col("before").isNotNull()).select("g", "n", "k", F.col("h").alias("h_now"))
    past = state.where(F.col("after").isNotNull()).select("g", F.col("after").alias("n"), "k", F.col("h").alias("h_past"))
    change = (
        F.when(F.col("h_past").isNull(), "new").when(F.col("h_now").isNull(), "deleted").when(F.col("h_now") != F.col("h_past"), "changed")
    )
    return (
        now.join(past, ["g", "n", "k"], "full_outer")
        .select(F.col("g").alias(group), F.col("n").alias(number), F.col("k").alias(key_name), change.alias("change"))
        .where(F.col("change").isNotNull())
    )
