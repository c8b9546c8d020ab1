"""Parent-child links to full hierarchies: paths, depths, roots, descendants and circles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.runtime import cut_lineage, forget, written

NODE_SCHEMA = "key string, root_key string, depth int, path array<string>, n_descendants long, back_edge boolean"


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long) as (node, component), by alternating large-star
    and small-star steps; each step is a join and an aggregation with map-side combining, and the
    links shrink towards stars, until nothing changes. A step's lineage is cut in the shared folder."""
    links = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    done = -1
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: the smaller neighbours and the node itself hang on the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
            .select(F.col("x.a").alias("a"), F.col("x.m").alias("b"))
            .where("a != b")
            .distinct()
        )
        links = cut_lineage(small)
        # done when every node has one link and no centre has a link of its own
        sign = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if (sign.n, sign.s) == done:
            break
        done = (sign.n, sign.s)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _climb(links: DataFrame) -> DataFrame:
    """For each `node` with its `up` (null for a root), by pointer doubling: `jump` null and the root
    `top` at distance `dist`; or, for a node on or below a circle, `jump` on that circle. `least` is
    the least node on the way. Each round joins the unfinished nodes with where their pointers are."""
    at = links.select("node", F.col("up").alias("jump"), F.col("up").isNotNull().cast("long").alias("dist"), F.coalesce("up", "node").alias("top"), F.least("node", "up").alias("least"))
    at = written(at)
    open_before, reach = -1, 1
    while True:
        n_open = at.where("jump is not null").count()
        # without a circle each round ends some ways; on circles one goes round until the least is known
        if n_open == 0 or (n_open == open_before and reach >= n_open):
            return at
        open_before = n_open
        to = at.select(F.col("node").alias("jump"), *[F.col(c).alias(f"{c}2") for c in ("jump", "dist", "top", "least")])
        step = at.where("jump is not null").join(to, "jump").select(
            "node", F.col("jump2").alias("jump"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("top2").alias("top"), F.least("least", "least2").alias("least")
        )
        before, at = at, written(at.where("jump is null").unionByName(step))
        forget(before)
        reach *= 2


def _rings(at: DataFrame) -> DataFrame:
    """(jump, ring_least): each node on a circle, and the least node of that circle."""
    open_ = at.where("jump is not null")
    return open_.join(open_.select(F.col("jump").alias("node")).distinct(), "node").select(F.col("node").alias("jump"), F.col("least").alias("ring_least"))


def _walk(frame: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """Depth-first traversal of whole components with node colouring (0 white, 1 grey, 2 black)."""
    parent = dict(zip(frame["key"], frame["parent"]))
    children: dict[str, list[str]] = {}
    for k in sorted(parent):
        if parent[k] is not None:
            children.setdefault(parent[k], []).append(k)
    colour = dict.fromkeys(parent, 0)
    path: dict[str, list[str]] = {}
    depth: dict[str, int] = {}
    root: dict[str, str] = {}
    below = dict.fromkeys(parent, 0)
    back: set[str] = set()

    def descend(start: str, on_circle: list[str] | None) -> None:
        stack = [(start, iter(children.get(start, ())))]
        colour[start] = 1
        while stack:
            node, rest = stack[-1]
            for c in rest:
                if colour[c] == 1:  # a grey child closes a circle
                    back.add(c)
                    continue
                if colour[c] == 2:
                    continue
                colour[c] = 1
                if on_circle is None:
                    depth[c], root[c] = depth[node] + 1, root[node]
                    if paths:
                        path[c] = path[node] + [c]
                stack.append((c, iter(children.get(c, ()))))
                break
            else:
                colour[node] = 2
                stack.pop()
                if stack:
                    below[stack[-1][0]] += below[node] + 1

    for k in sorted(parent):
        if parent[k] is None:
            path[k], depth[k], root[k] = [k], 0, k
            descend(k, None)
    for k in sorted(parent):
        if colour[k] == 0:
            # what no root reaches hangs on a circle: go up to it, then walk down from its least node
            seen: dict[str, int] = {}
            at = k
            while at not in seen:
                seen[at] = len(seen)
                at = parent[at]
            ring = [x for x, i in seen.items() if i >= seen[at]]
            first = min(ring)
            descend(first, ring)
            for x in ring:
                path[x], depth[x], root[x] = [x], -1, first
            todo = [(c, x) for x in ring for c in children.get(x, ()) if depth.get(c) != -1]
            while todo:
                c, up = todo.pop()
                depth[c], root[c] = -2, first
                if paths:
                    path[c] = path[up] + [c]
                todo += [(d, c) for d in children.get(c, ())]
            for x in ring:  # each node of a circle has all the others below it
                below[x] = below[first]
    keys = list(parent)
    columns = {"key": keys, "root_key": [root[k] for k in keys], "depth": [depth[k] for k in keys]}
    if paths:
        columns["path"] = [path[k] for k in keys]
    return pd.DataFrame(columns | {"n_descendants": [below[k] for k in keys], "back_edge": [k in back for k in keys]})


def _doubled(nodes: DataFrame, paths: bool) -> DataFrame:
    """The same result for components too large for one task, by pointer doubling over the cluster."""
    at = _climb(nodes.select(F.col("key").alias("node"), F.col("parent").alias("up")))
    rings = _rings(at).withColumn("key", F.col("jump"))
    on_ring = rings.select("key", F.lit(True).alias("ring"))
    place = (
        at.withColumnRenamed("node", "key")
        .join(nodes.select("key", "parent"), "key")
        .join(on_ring, "key", "left")
        .join(rings.select("jump", "ring_least"), "jump", "left")
        .select(
            "key",
            "parent",
            F.coalesce("ring_least", "top").alias("root_key"),
            F.when(F.col("ring"), F.lit(-1)).when(F.col("jump").isNotNull(), F.lit(-2)).otherwise(F.col("dist")).alias("depth"),
        )
    )
    place = cut_lineage(place)
    # by doubling again, with the links of circles cut. n: nodes within the current reach below a node, itself
    # too; those just beyond add what is within reach of them. path: a segment above a node is put in front
    start = F.when(F.col("depth") != -1, F.col("parent")).alias("jump")
    at = written(place.select("key", start, F.lit(1).cast("long").alias("n"), *([F.array("key").alias("path")] if paths else [])))
    while at.where("jump is not null").limit(1).count():
        more = at.where("jump is not null").groupBy("jump").agg(F.sum("n").alias("more")).withColumnRenamed("jump", "key")
        up = at.select(F.col("key").alias("jump"), F.col("jump").alias("jump2"), *([F.col("path").alias("path2")] if paths else []))
        path = [F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path")] if paths else []
        step = at.join(up, "jump", "left").join(more, "key", "left").select("key", F.col("jump2").alias("jump"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), *path)
        before, at = at, written(step)
        forget(before)
    # on a circle every node has the whole hanging part below it
    whole = place.where("depth < 0").groupBy("root_key").agg((F.count("*") - 1).alias("all_below"))
    return (
        place.join(at.drop("jump"), "key")
        .join(whole, "root_key", "left")
        .select(
            "key",
            "root_key",
            F.col("depth").cast("int").alias("depth"),
            *(["path"] if paths else []),
            F.when(F.col("depth") == -1, F.col("all_below")).otherwise(F.col("n") - 1).alias("n_descendants"),
            ((F.col("depth") == -1) & (F.col("key") == F.col("root_key"))).alias("back_edge"),
        )
    )


def hierarchies(nodes: DataFrame, links: DataFrame, nodes_per_task: int = 50_000, largest: int = 200_000, paths: bool = True, longest: int = 5_000_000) -> DataFrame:
    """Path (if `paths`), depth, root and number of descendants of every node, and the nodes on circles.

    nodes: `key` string; links: `child`, `parent` string. Both may have repeats, nulls and more
    columns. Links to or from something that is no node do not count. A node without parent is a
    root (depth 0). A node on a circle has depth -1, a node below one -2; the root of both is the
    least key on that circle, the path of the first is itself, of the second starts at the circle.
    `back_edge` marks the node whose link closes the circle. Should a node have several parents,
    the least key counts. Empty tables give an empty result.

    Connected components first: as each node has one link up at most, a component is what climbs to
    the same root or circle. Each is then co-located with others in a bin of about `nodes_per_task`
    nodes and walked depth first. A component of more than `largest` nodes, or of more than `longest`
    path entries where paths are asked for, is not gathered in one task: pointer doubling over the
    whole cluster gives the same rows. Depths and counts never need paths; all paths of a chain of
    n nodes have n * n / 2 entries.
    """
    keys = nodes.select("key").where("key is not null").distinct()
    parents = (
        links.select("child", "parent")
        .where("child is not null and parent is not null")
        .join(keys.select(F.col("key").alias("parent")), "parent", "left_semi")
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )
    linked = keys.join(parents.withColumnRenamed("child", "key"), "key", "left")
    code = lambda c: F.unhex(F.md5(c))  # noqa: E731  # 16 bytes climb faster than long keys
    linked = cut_lineage(linked.select("key", "parent", code("key").alias("node"), code("parent").alias("up")))
    at = _climb(linked.select("node", "up"))
    placed = linked.join(at.select("node", "jump", "dist", "top"), "node")
    if at.where("jump is not null").limit(1).count():
        placed = placed.join(_rings(at), "jump", "left")
    else:
        placed = placed.withColumn("ring_least", F.lit(None).cast("binary"))
    placed = cut_lineage(placed.select("key", "parent", F.coalesce("ring_least", "jump", "top").alias("component"), (F.col("dist") + 1).alias("length")))
    size = placed.groupBy("component").agg(F.count("*").alias("n"), F.sum("length").alias("entries"))
    huge = size.where((F.col("n") > largest) | (F.lit(paths) & (F.col("entries") > longest) & (F.col("n") > 1))).select("component")
    total = size.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > largest, 1)), F.count(F.when(F.lit(paths) & (F.col("entries") > longest), 1))).first()
    any_huge = total[1] + total[2] > 0
    small = placed.join(huge, "component", "left_anti") if any_huge else placed
    bins = max(1, -(-total[0] // nodes_per_task))
    schema = NODE_SCHEMA if paths else NODE_SCHEMA.replace(" path array<string>,", "")
    walked = small.select("key", "parent", F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin")).groupBy("bin").applyInPandas(lambda frame: _walk(frame, paths), schema)
    if not any_huge:
        return walked
    return walked.unionByName(_doubled(cut_lineage(placed.join(huge, "component", "left_semi").select("key", "parent")), paths))


def descendants(walked: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) rows with distance over 0, from the paths; below a
    circle the ancestors start at the circle's node."""
    return walked.select(F.col("key").alias("descendant"), F.posexplode("path").alias("i", "ancestor"), F.size("path").alias("n")).where("i < n - 1").select(
        "ancestor", "descendant", (F.col("n") - 1 - F.col("i")).alias("distance")
    )
