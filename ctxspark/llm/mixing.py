"""Mixing sources to target weights, block by block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.llm.prefix import running_total
from ctxspark.runtime import cut_lineage, written


def source_name(source: Column) -> Column:
    """One spelling of a source's name: lower case, no outer blanks, `_` for blanks and hyphens."""
    return F.lower(F.regexp_replace(F.trim(source), r"[\s-]+", "_"))


def quotas(weights: list[float], limits: list[int], total: int) -> list[int]:
    """Whole slots for each source: shares of `total` by weight, none over its limit. What a source
    at its limit cannot give goes to the others by their weights, round by round."""
    total = min(total, sum(x for x, w in zip(limits, weights) if w > 0))
    given = [0.0] * len(weights)
    free = [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    left = float(total)
    while free and left > 1e-9:
        scale = left / sum(weights[i] for i in free)
        full = [i for i in free if given[i] + weights[i] * scale >= limits[i]]
        if not full:
            for i in free:
                given[i] += weights[i] * scale
            break
        for i in full:
            left -= limits[i] - given[i]
            given[i] = limits[i]
        free = [i for i in free if i not in full]
    whole = [int(g + 1e-9) for g in given]
    for i in sorted(range(len(given)), key=lambda i: (whole[i] - given[i], i)):
        if sum(whole) < total and whole[i] < limits[i] and given[i] > 0:
            whole[i] += 1
    return whole


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1 at `index`, by a keyed Feistel network over the next
    even power of two; results outside the range walk on until they are inside."""
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) // 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def rounds(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        left, right = x >> half[at], x & mask[at]
        for r in range(4):
            f = (right + key[at] + np.uint64(r * 0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask[at])
        return (left << half[at]) | right

    out, at = index.astype(np.uint64), np.arange(len(index))
    while len(at):
        out[at] = rounds(out[at], at)
        at = at[out[at] >= size[at].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Mix:
    """slots: one row per document part of each slot (shard_no, slot_no, source, repeat_no, block_no,
    item, from_token, n_tokens). shares: one row per target source."""

    slots: DataFrame
    shares: DataFrame


def mix_sources(
    items: DataFrame,
    targets: DataFrame,
    item: str,
    source: str,
    n_tokens: str,
    block_tokens: int = 512,
    shard_slots: int = 64,
    total_tokens: int | None = None,
    seed: int = 17,
    bucket_items: int = 20_000,
) -> Mix:
    """Draws blocks of the sources' documents so that each source gives its target share.

    items: `item` (unique), `source`, `n_tokens`. targets: source, weight, max_repeats (null: 1);
    spellings of a name that `source_name` unites are one source, their weights add up. Documents
    of other sources, without source or without tokens are not candidates; targets without
    documents get the share 0, a null or negative weight counts as 0. Empty tables give no slots.

    Each source's documents are laid end to end in a pseudorandom order and cut into blocks of
    `block_tokens`. Every shard of `shard_slots` slots draws its counts of the sources from a
    multinomial distribution; slots over a source's quota go to the sources under theirs, so that
    the quotas hold exactly over all shards. A source's n-th slot takes the n-th block of its
    pseudorandom permutation, a new one for each pass, and no pass goes beyond `max_repeats`.
    A source that cannot give its share is exhausted and the others fill up by their weights; the
    shares table tells both. The size is `total_tokens`, or that of all candidate documents.
    """
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), "weight", "max_repeats")
        .where("source is not null")
        .groupBy("source")
        .agg(
            F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("weight"),
            F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"),
        )
    )
    held = items.select(F.col(item).alias("item"), source_name(F.col(source)).alias("source"), F.col(n_tokens).cast("long").alias("n")).where("n > 0")
    held = written(held.join(wanted.select("source"), "source", "left_semi"))
    supply = held.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("items"))
    # one row per target source: as long as the table of targets
    plan = wanted.join(supply, "source", "left").orderBy("source").toPandas().fillna({"tokens": 0, "items": 0, "weight": 0.0})
    plan["blocks"] = [-(-int(t) // block_tokens) for t in plan["tokens"]]
    total = int(plan["tokens"].sum()) if total_tokens is None else total_tokens
    limits = [int(b) * int(r) for b, r in zip(plan["blocks"], plan["max_repeats"])]
    quota = quotas([float(w) for w in plan["weight"]], limits, -(-total // block_tokens))
    slots_total = sum(quota)
    k = len(plan)

    # documents to block parts
    buckets = max(1, -(-int(plan["items"].sum()) // bucket_items))
    laid = running_total(held, "source", F.xxhash64(F.col("item"), F.lit(seed)), "n", F.pmod(F.xxhash64("item"), F.lit(buckets)), "start")
    first, last = F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("n") - 1) / block_tokens)
    parts = laid.select("source", "item", "start", "n", F.explode(F.sequence(first, last)).alias("block_no"))
    begin = F.greatest("start", F.col("block_no") * block_tokens)
    parts = parts.select(
        "source",
        "item",
        "block_no",
        (begin - F.col("start")).alias("from_token"),
        (F.least(F.col("start") + F.col("n"), (F.col("block_no") + 1) * block_tokens) - begin).cast("int").alias("n_tokens"),
    )

    # counts of the sources per shard
    chances = np.array(quota, dtype=float) / max(slots_total, 1)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for shard in frame["shard_no"]:
                n = min(shard_slots, slots_total - shard * shard_slots)
                out.append(np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(n, chances))
            counts = np.array(out, dtype=np.int64).reshape(-1, k)
            shard, s = np.nonzero(counts)
            yield pd.DataFrame({"shard_no": frame["shard_no"].to_numpy()[shard], "s": s.astype(np.int32), "count": counts[shard, s]})

    spark = items.sparkSession
    shards = spark.range(-(-slots_total // shard_slots)).withColumnRenamed("id", "shard_no")
    drawn = cut_lineage(shards.mapInPandas(draw, "shard_no long, s int, count long"))
    got = [0] * k
    for r in drawn.groupBy("s").agg(F.sum("count").alias("n")).collect():  # one row per source
        got[r.s] = r.n
    ordinals = running_total(drawn, "s", F.col("shard_no"), "count", F.floor(F.col("shard_no") / bucket_items), "before")
    slots = ordinals.select("shard_no", "s", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("count") - 1)).alias("j"))
    # by source: the o-th slot over a quota becomes the o-th one missing to another quota
    have, want, blocks = np.array(got), np.array(quota), np.maximum(1, plan["blocks"].to_numpy(dtype=np.int64))
    excess, lack = np.maximum(have - want, 0), np.maximum(want - have, 0)
    over_from, lack_to = np.cumsum(excess) - excess, np.cumsum(lack)
    names = np.array(plan["source"].tolist(), dtype=object)

    @F.pandas_udf(T.StructType([T.StructField("source", T.StringType()), T.StructField("repeat_no", T.IntegerType()), T.StructField("block_no", T.LongType())]))
    def block_of(s: pd.Series, j: pd.Series) -> pd.DataFrame:
        s, j = s.to_numpy(), j.to_numpy()
        moved = j >= want[s]
        o = over_from[s] + j - want[s]
        to = np.where(moved, np.minimum(np.searchsorted(lack_to, o, side="right"), k - 1), s)
        j = np.where(moved, have[to] + o - (lack_to[to] - lack[to]), j)
        passes, index = np.divmod(j, blocks[to])
        key = (to.astype(np.uint64) * np.uint64(1000003) + passes.astype(np.uint64)) * np.uint64(2654435761) + np.uint64(seed)
        return pd.DataFrame({"source": names[to], "repeat_no": (passes + 1).astype(np.int32), "block_no": permuted(index, blocks[to], key)})

    slot_no = F.row_number().over(Window.partitionBy("shard_no").orderBy("s", "j"))
    chosen = slots.withColumn("slot_no", slot_no).withColumn("b", block_of("s", "j")).select("shard_no", "slot_no", "b.*")
    # both sides grow with the data: a sort-merge join, whatever their sizes are now
    out = chosen.join(parts.hint("merge"), ["source", "block_no"]).select("shard_no", "slot_no", "source", "repeat_no", "block_no", "item", "from_token", "n_tokens")
    used = out.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("repeat_no").alias("most_repeats"))
    rows = [
        (n, float(w), int(m), int(t), bool(q < w / max(plan["weight"].sum(), 1e-300) * slots_total - 1))
        for n, w, m, t, q in zip(plan["source"], plan["weight"], plan["max_repeats"], plan["tokens"], quota)
    ]
    known = spark.createDataFrame(rows, "source string, weight double, max_repeats int, available_tokens long, exhausted boolean")
    one = Window.partitionBy(F.lit(0))  # the table of shares has one row per target
    all_weight, all_used = F.sum("weight").over(one), F.sum("used_tokens").over(one)
    shares = (
        known.join(used, "source", "left")
        .fillna(0, ["used_tokens", "most_repeats"])
        .select(
            "source",
            F.try_divide("weight", all_weight).alias("target_share"),
            F.coalesce(F.try_divide("used_tokens", all_used), F.lit(0.0)).alias("actual_share"),
            "available_tokens",
            "used_tokens",
            "max_repeats",
            "most_repeats",
            "exhausted",
        )
    )
    return Mix(out, shares)

