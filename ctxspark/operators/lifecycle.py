"""Notes over time: duplicates, contradictions, compaction, patches, cascades, outcomes of ingestion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import contradicts, jaccard, word_set
from ctxspark.runtime import written


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by `order`, which must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


#: Rows of a key that are compared in one task, on each side.
BLOCK = 32_768
#: Rows of a key below which pairs of many keys are compared in one go, and pairs of such a go.
_FEW, _GO = 1024, 1 << 20


def _close_pairs(frame: pd.DataFrame, least: np.ndarray) -> pd.DataFrame:
    """(a, b): pairs of a row of side 0 and one of side 1 with the same key whose marks allow a
    similarity of least[level], for the titles or, divided by 0.8, for the longer texts.

    A mark has the parity of the words that fall on each of its bits, so that two marks differ in no
    more bits than their sets in words: for a similarity of t at most (1 - t) / (1 + t) of the words
    of both. No pair is lost."""
    frame = frame.sort_values("key", kind="stable")
    x, y = ({c: part[c].to_numpy() for c in part.columns} for part in (frame[frame["side"] == 0], frame[frame["side"] == 1]))
    marks = {s: [(x[f"{s}{i}"].view(np.uint64), y[f"{s}{i}"].view(np.uint64)) for i in (1, 2)] for s in "te"}
    share = {s: np.array([(1 - t) / (1 + t) if t <= 1 + 1e-9 else -1.0 for t in least / scale]) for s, scale in (("t", 1.0), ("e", 0.8))}

    def limits(s: str, level: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """One more than the bits that may differ; 0 where nothing is similar enough."""
        most = np.floor(share[s][level] * (n + m) + 1e-6) + 1
        return np.where((n > 0) & (m > 0), np.clip(most, 0, 255), 0).astype(np.uint8)

    def kept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        close = np.zeros(len(i), dtype=bool)
        for s in "te":
            limit = limits(s, x["level"][i], x[f"n{s}"][i], y[f"n{s}"][j])
            both = np.ones(len(i), dtype=bool)
            for own, other in marks[s]:
                both &= np.bitwise_count(own[i] ^ other[j]) < limit
            close |= both
        close &= x["h"][i] != y["h"][j]
        return close

    low, high = np.searchsorted(y["key"], x["key"], "left"), np.searchsorted(y["key"], x["key"], "right")
    n, out = high - low, []
    few = np.flatnonzero((n > 0) & (n < _FEW))
    for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(n[few]) // _GO)) + 1):
        i = np.repeat(part, n[part])
        j = np.arange(len(i)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + low[i]
        some = kept(i, j)
        out.append((i[some], j[some]))
    begun, known = -1, {}
    for i in np.flatnonzero(n >= _FEW):
        run = slice(low[i], high[i])
        if begun != low[i]:
            begun, known = low[i], {}
        close = np.zeros(n[i], dtype=bool)
        for s in "te":
            at = (s, x["level"][i], x[f"n{s}"][i])
            if at not in known:
                known[at] = limits(s, x["level"][i : i + 1], x[f"n{s}"][i : i + 1], y[f"n{s}"][run])
            own, other = marks[s][0]
            close |= np.bitwise_count(other[run] ^ own[i]) < known[at]
        j = np.flatnonzero(close) + low[i]
        to = np.full(len(j), i)
        some = kept(to, j)
        out.append((to[some], j[some]))
    i, j = (np.concatenate([np.empty(0, np.int64), *(o[k] for o in out)]) for k in (0, 1))
    return pd.DataFrame({"a": x["h"][i], "b": y["h"][j]}).drop_duplicates()


def likely_duplicates(candidates: DataFrame, nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """Existing notes that candidates of the same project may repeat.

    Both: id, project_id, kind, module_path, title, summary. Score: 0.6 max(title similarity,
    0.8 similarity of title and first 200 characters of the summary) + 0.2 same kind + 0.2 share of
    the candidate's module words in the note's; kept from `least` on, near from 0.8.

    What similarity of words a pair needs depends on what else it has in common: notes of one kind and
    module word meet under a low one, notes of one kind or one module word under a middle one, all
    others only where they share two of the first n - ceil(t n) + 2 words of their sets, the longest
    first. Within a key, all pairs are held against 64-bit marks of their words (`_close_pairs`), in
    blocks of `BLOCK` rows a side; only pairs whose marks are close enough are compared by words. So
    nothing is lost, and words that are no key are not joined."""
    if least <= 0.4:
        raise ValueError("the join on words is complete only above 0.4")
    raw = least - 0.00005  # scores are rounded to four digits
    levels = np.array([(raw - 0.4) / 0.6, (raw - 0.2) / 0.6, raw / 0.6])

    def bits(name: str, seed: int) -> Column:
        return F.aggregate(name, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w, F.lit(seed)), F.lit(64)).cast("int"))))

    def words(df: DataFrame) -> DataFrame:
        extended = F.concat_ws(" ", "title", F.substring("summary", 1, 200))
        sets = df.where("project_id is not null and id is not null").select(
            "id", "project_id", "kind", F.xxhash64("id").alias("h"), F.coalesce(word_set(F.col("title")), F.array().cast("array<string>")).alias("t"),
            word_set(extended).alias("e"), word_set(F.regexp_replace(F.coalesce("module_path", F.lit("")), r"[._/]", " ")).alias("m"),
        )
        return written(sets.select("*", *[bits(s, i).alias(f"{s}{i}") for s in "te" for i in (1, 2)]))

    def rare_pairs(name: str, t: float) -> Column:
        """Keys of which two sets of a similarity of t > 0.5 share one: pairs of words; the word of a set of one."""
        n = F.size(name)
        order = F.transform(F.array_sort(F.transform(name, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda x: x["w"])
        first = F.slice(order, F.lit(1), F.least(n, F.greatest(F.lit(0), n - F.ceil(n * t - 1e-9).cast("int") + 2)))
        pairs = F.flatten(F.transform(first, lambda w, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda v: F.xxhash64(F.lit(name), "project_id", w, v))))
        return F.when(n == 1, F.transform(name, lambda w: F.xxhash64(F.lit(name), "project_id", w))).otherwise(pairs)

    b = words(nodes)
    a = b if candidates is nodes else words(candidates)
    key = lambda level, k: F.struct(F.lit(level).alias("level"), k.alias("key"))
    none = F.array().cast("array<struct<level:int,key:bigint>>")

    def keyed(df: DataFrame, side: int) -> DataFrame:
        of_kind = F.col("kind").isNotNull()
        keys = [
            F.when(of_kind, F.transform("m", lambda w: key(0, F.xxhash64(F.lit("km"), "project_id", "kind", w)))).otherwise(none),
            F.transform("m", lambda w: key(1, F.xxhash64(F.lit("m"), "project_id", w))),
            F.when(of_kind, F.array(key(1, F.xxhash64(F.lit("k"), "project_id", "kind")))).otherwise(none),
            *[F.transform(rare_pairs(s, t), lambda k: key(2, k)) for s, t in (("t", levels[2]), ("e", levels[2] / 0.8)) if t <= 1 + 1e-9],
        ]
        every = df.select(F.explode(F.concat(*keys)).alias("k"), "h", "t1", "t2", "e1", "e2", F.size("t").alias("nt"), F.size("e").alias("ne"))
        return every.select("k.key", "k.level", F.lit(side).alias("side"), *every.columns[1:])

    left, right = keyed(a, 0), keyed(b, 1)
    spark = nodes.sparkSession
    n_rows = left.select("key").unionByName(right.select("key")).groupBy("key").agg(F.count("*").alias("n"))
    large = n_rows.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    large = spark.createDataFrame(large.collect(), "key long, blocks int")  # one row for each BLOCK rows at most
    numbers = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    own = F.pmod(F.xxhash64("h"), F.coalesce("blocks", F.lit(1))).cast("int")
    cut = lambda df, mine, theirs: df.join(F.broadcast(large), "key", "left").withColumn(mine, own).withColumn(theirs, F.explode(numbers)).drop("blocks")
    rows = cut(left, "ab", "bb").unionByName(cut(right, "bb", "ab"))
    tasks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), (a.count() + b.count()) // 20_000)
    bucket = F.pmod(F.xxhash64("key", "ab", "bb"), F.lit(tasks))
    pairs = rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda frame: _close_pairs(frame, levels), "a long, b long").distinct()

    side = lambda df, s: df.select(F.col("h").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("id", "project_id", "kind", "t", "e", "m")])
    both = pairs.join(side(a, "a"), "a").join(side(b, "b"), "b").where("project_id_a = project_id_b and id_a <> id_b")
    module = F.coalesce(F.try_divide(F.size(F.array_intersect("m_a", "m_b")), F.size("m_a")), F.lit(0.0))
    same = F.coalesce((F.col("kind_a") == F.col("kind_b")).cast("int"), F.lit(0))
    score = 0.6 * F.greatest(jaccard(F.col("t_a"), F.col("t_b")), 0.8 * jaccard(F.col("e_a"), F.col("e_b"))) + 0.2 * same + 0.2 * module
    scored = both.select("id_a", "id_b", F.round(score, 4).alias("score")).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b"))
    return scored.select("id_a", "id_b", "score", F.when(F.col("score") >= 0.8, "near").otherwise("partial").alias("band"), (best == 1).alias("best"))


def contradictions(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) whose texts (id, text) use opposing words."""
    a = texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "id_a").join(b, "id_b")
    return both.where(contradicts(F.col("text_a"), F.col("text_b"))).select("id_a", "id_b")


def compaction_groups(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Groups of active notes of one project, parent and kind (no parent is a group too): number,
    mean confidence and importance, and a title of the first five, by creation and id. Numbers are
    added up before they are exchanged, and of a group's notes only the first five are."""
    key = ["project_id", "parent_id", "kind"]
    g = nodes.groupBy(*key).agg(F.count("*").alias("n_nodes"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.avg("importance"), 4).alias("importance")).where(F.col("n_nodes") >= least)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("created_at", "id"))
    first = nodes.withColumn("_n", place).where("_n <= 5").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_n", "title"))).alias("_first"))
    same = [g[c].eqNullSafe(first[c]) for c in key]
    titles = F.array_join(F.transform("_first", lambda x: x["title"]), "; ")
    more = F.when(F.col("n_nodes") > 5, F.concat(F.lit(" (+"), (F.col("n_nodes") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    return g.join(first, same).select(*[g[c] for c in key], "n_nodes", "confidence", "importance", F.substring(F.concat(titles, more), 1, 256).alias("title"))


def patched(state: DataFrame, patches: DataFrame, key: str, columns: list[str], as_of: Column | None = None) -> DataFrame:
    """State rows with the non-null values of their patch (one per key) in place; with `as_of`, the
    `updated_at` of every row that has a patch is set to it."""
    p = patches.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = state.join(p, state[key] == p["_key"], "left")

    def value(c: str) -> Column:
        if c in columns:
            return F.coalesce(F.col(f"_{c}"), state[c]).alias(c)
        if c == "updated_at" and as_of is not None:
            return F.when(F.col("_key").isNotNull(), as_of).otherwise(state[c]).alias(c)
        return state[c]

    return joined.select(*[value(c) for c in state.columns])


def archived(state: DataFrame, keys: DataFrame, key: str, as_of: Column, reason: str) -> DataFrame:
    """State rows (status, archived_at, archived_reason) with the `keys` archived; those that are already
    keep their date and reason."""
    hit = F.col("_hit") & (F.lower(F.trim("status")) != "archived")
    marked = state.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    new = {"status": F.lit("archived"), "archived_at": as_of, "archived_reason": F.lit(reason), "updated_at": as_of}
    return marked.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in state.columns])


def restored(state: DataFrame, keys: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The archived rows among `keys` active again, without date and reason."""
    hit = F.col("_hit") & (F.lower(F.trim("status")) == "archived")
    marked = state.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    none = F.lit(None)
    new = {"status": F.lit("active"), "archived_at": none, "archived_reason": none, "updated_at": as_of}
    return marked.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in state.columns])


def staled(rows: DataFrame, document: str, changed: DataFrame, status: str = "index_status") -> DataFrame:
    """Rows with `status` stale where their document (`document` of `changed`) has changed."""
    gone = changed.select(F.col(document).alias("_gone")).distinct().withColumn("_hit", F.lit(True))
    marked = rows.join(gone, F.col(document) == F.col("_gone"), "left")
    return marked.select(*[F.when(F.col("_hit"), F.lit("stale")).otherwise(F.col(c)).alias(c) if c == status else F.col(c) for c in rows.columns])


def manifest_applied(manifest: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The manifest (keys, content_hash, index_status, revision) after changes (keys, change,
    content_hash): new and changed files are indexed at the next revision, deleted ones are marked."""
    c = changes.select(*keys, "change", F.col("content_hash").alias("_hash"))
    joined = manifest.select(*keys, "content_hash", "index_status", "revision").join(c, keys, "full_outer")
    taken = F.col("change").isin("new", "changed")
    return joined.select(
        *keys,
        F.when(taken, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(taken, "indexed").when(F.col("change") == "deleted", "deleted").otherwise(F.col("index_status")).alias("index_status"),
        (F.coalesce("revision", F.lit(0)) + F.when(taken, 1).otherwise(0)).cast("int").alias("revision"),
    )


def vector_misses(records: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Records (record_id, content_hash) whose vector must be made anew: not stored (record_id,
    content_hash, model) with the same content and model."""
    return records.join(stored.where(F.col("model") == model).select("record_id", "content_hash"), ["record_id", "content_hash"], "left_anti")


def edge_peers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, peer, relation_type, conflict): the other end of every edge (source_id, target_id,
    relation_type) of a node, where both exist; a peer that is stale or superseded is a conflict.
    nodes: id, status."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("peer"), "relation_type")
    back = edges.where("source_id <> target_id").select(F.col("target_id").alias("id"), F.col("source_id").alias("peer"), "relation_type")
    state = nodes.select(F.col("id").alias("peer"), F.lower(F.trim("status")).isin("stale", "superseded").alias("conflict"))
    known = out.unionByName(back).distinct().join(nodes.select("id"), "id", "left_semi")
    return known.join(state, "peer").select("id", "peer", "relation_type", "conflict")


def cascade_deleted(parents: DataFrame, children: DataFrame, key: str, foreign: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys in `gone` and what refers to them."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    left = parents.join(g, parents[key] == F.col("_gone"), "left_anti")
    return left, children.join(g, children[foreign] == F.col("_gone"), "left_anti")


def new_edges(edges: DataFrame, added: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, relation_type) after an insert: no loops, the older one stays."""
    every = edges.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1))).where("source_id <> target_id")
    return latest(every, ["source_id", "target_id", "relation_type"], [F.col("_new")]).drop("_new")


def ingestion_sequence(arrivals: DataFrame, key: list[str], content: str, order: list[str]) -> DataFrame:
    """Each arrival with its `outcome` against the one of the same key before it: `new` for the first,
    `duplicate` if the content is the same, else `updated`. `order` must be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    before, first = F.lag(content).over(w), F.row_number().over(w) == 1
    return arrivals.withColumn("outcome", F.when(first, "new").when(before.eqNullSafe(F.col(content)), "duplicate").otherwise("updated"))


def ingestion_outcomes(arrivals: DataFrame, state: DataFrame) -> DataFrame:
    """What becomes of arriving documents (project_id, source_path, content_hash): `new`, `updated`
    (the latest document of the same path has another hash) or `duplicate`."""
    known = state.select("project_id", "source_path", F.col("content_hash").alias("before"))
    joined = arrivals.join(known, ["project_id", "source_path"], "left")
    return joined.withColumn("outcome", F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("content_hash"), "duplicate").otherwise("updated")).drop("before")
