"""Filling fixed-capacity containers with whole items (hierarchical multi-length packing)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.runtime import written

PACKED = "capacity int, container_no long, step_no long, item string, part_no int, from_token long, n_tokens int, filled int, tier int, in_gap boolean"


class _Rooms:
    """Open windows by the room they have left, for best fit: the least room that is enough."""

    def __init__(self, most: int):
        self.by_room: list[list[int]] = [[] for _ in range(most + 1)]
        self.bits = 0  # bit r is set if a window with room for r tokens is open

    def add(self, window: int, room: int) -> None:
        if room:
            self.by_room[room].append(window)
            self.bits |= 1 << room

    def take(self, n: int) -> int | None:
        fits = self.bits >> n
        if not fits:
            return None
        room = (fits & -fits).bit_length() - 1 + n
        window = self.by_room[room].pop()
        if not self.by_room[room]:
            self.bits &= ~(1 << room)
        self.add(window, room - n)
        return window


@dataclass
class Packing:
    """By size its container, the tier it was routed to, and whether it fills a gap of longer
    windows; the number of containers."""

    where: np.ndarray
    tier: np.ndarray
    in_gap: np.ndarray
    count: int


def pack(sizes: np.ndarray, capacity: int, context_sizes: list[int]) -> Packing:
    """Hierarchical packing of sizes (none over `capacity`) into containers of `capacity`.

    Each size is routed to the tier of the least context size that holds it. Tiers are packed one
    after another, the longest first: what fits into the gaps that longer windows left goes there
    (largest first, best fit); the rest is packed into windows of the tier's own size, and these
    windows, fullest first, are put into containers by what they hold. The gaps of a container are
    all that its windows leave free, so shorter tiers fill them next."""
    tiers = sorted({t for t in context_sizes if t < capacity} | {capacity})
    tier = np.searchsorted(tiers, sizes)
    where, in_gap, count = np.full(len(sizes), -1, dtype=np.int64), np.zeros(len(sizes), dtype=bool), 0
    order, open_containers = np.argsort(-sizes, kind="stable"), _Rooms(capacity)
    for t in reversed(range(len(tiers))):
        own, inside, held = _Rooms(tiers[t]), [], []
        for i in order[tier[order] == t].tolist():
            n = int(sizes[i])
            c = open_containers.take(n)
            if c is not None:
                where[i], in_gap[i] = c, True
                continue
            w = own.take(n)
            if w is None:
                w = len(held)
                own.add(w, tiers[t] - n)
                inside.append([])
                held.append(0)
            inside[w].append(i)
            held[w] += n
        for w in sorted(range(len(held)), key=lambda w: (-held[w], w)):
            c = open_containers.take(held[w])
            if c is None:
                c, count = count, count + 1
                open_containers.add(c, capacity - held[w])
            where[inside[w]] = c
    return Packing(where, np.array(tiers)[tier], in_gap, count)


def _pack_group(group: int, items: np.ndarray, sizes: np.ndarray, capacities: list[int], per_step: int) -> pd.DataFrame:
    out = []
    for capacity in capacities:
        # an item over the capacity is cut into full containers and one rest that is packed as the others
        parts = np.maximum(-(-sizes // capacity), 1)
        row = np.repeat(np.arange(len(sizes)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(capacity, sizes[row] - part * capacity)
        packed = pack(n, capacity, capacities)
        where, count = packed.where, packed.count
        filled = np.bincount(where, weights=n, minlength=count).astype(np.int64)
        # step groups of even work: containers of each longest tier by the squares of their items, dealt to and fro
        work = np.bincount(where, weights=n.astype(float) ** 2, minlength=count)
        steps = max(1, -(-count // per_step))
        place = np.arange(count)
        lap, at = place // steps, place % steps
        step = np.empty(count, dtype=np.int64)
        longest = np.zeros(count, dtype=np.int64)
        np.maximum.at(longest, where, packed.tier)
        step[np.lexsort((place, -work, -longest))] = np.where(lap % 2 == 0, at, steps - 1 - at)
        out.append(
            pd.DataFrame(
                {
                    "capacity": np.int32(capacity),
                    "container_no": (group << 32) + where,
                    "step_no": (group << 32) + step[where],
                    "item": items[row],
                    "part_no": part.astype(np.int32),
                    "from_token": part * capacity,
                    "n_tokens": n.astype(np.int32),
                    "filled": filled[where].astype(np.int32),
                    "tier": packed.tier.astype(np.int32),
                    "in_gap": packed.in_gap,
                }
            )
        )
    return pd.concat(out)


def fill_containers(
    items: DataFrame, item: str, n_tokens: str, capacities: list[int], per_step: int = 8, group_tokens: int = 4_000_000, group_items: int = 20_000
) -> DataFrame:
    """Packs all items into containers of each capacity; one row per item, or per part of an item
    that alone exceeds the capacity, for each capacity.

    items: `item` (any type that casts to string; repeated rows are packed as often as they come)
    and `n_tokens`. Items without tokens (null, 0) need no container and give no row. Columns:
    capacity, container_no, step_no (containers to be used together, of even work), item, part_no,
    from_token, n_tokens, filled (tokens in the container), tier (the context size it was routed to:
    the capacities up to the container's own are the tiers) and in_gap (it fills a gap that longer
    windows left). Numbers are unique, not dense: the upper
    half is the group.

    Items are dealt by a hash into groups of about `group_tokens` tokens or `group_items` items, and
    each group is packed in one task, so that the groups' sizes do not grow with the data and no key
    can be hot; a group wastes at most about one container more than one packing of all.
    ValueError without a positive capacity."""
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    capacities = sorted(set(capacities))
    counted = items.select(F.col(item).cast("string").alias("item"), F.col(n_tokens).cast("long").alias("size")).where("size > 0").groupBy("item", "size").count()
    sized = written(counted.select("item", "size", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"), F.count("*").alias("items")).first()
    groups = max(1, -(-total.tokens // group_tokens), -(-total.items // group_items))

    def pack_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "item"], ascending=[False, True])
        return _pack_group(int(key[0]), frame["item"].to_numpy(), frame["size"].to_numpy(), capacities, per_step)

    group = F.pmod(F.xxhash64("item", "size", "copy"), F.lit(groups)).cast("long")
    return sized.withColumn("group", group).groupBy("group").applyInPandas(pack_group, PACKED)
