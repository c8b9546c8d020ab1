"""Lexical and vector search over many requests at once, fusion, and selection under a budget."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import lexical_terms, module_prefixes, request_terms, source_quality, terms
from ctxspark.runtime import written


def postings(texts: DataFrame, scope: str, id: str, text: str, words: Callable[[Column], Column] = terms) -> DataFrame:
    """(scope, id, term, tf, dl): term counts of each text and its number of terms. `words` gives a
    text's terms: those of the bag-of-words model, or `lexical_terms` for `bm25`."""
    found = texts.select(F.col(scope).alias("scope"), F.col(id).alias("id"), words(F.col(text)).alias("terms"))
    each = found.select("scope", "id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return each.groupBy("scope", "id", "dl", "term").agg(F.count("*").alias("tf"))


def _ranked(scores: DataFrame, k: int, *also: str) -> DataFrame:
    """The k best of each request (and of what else is named); ties by id, so that the order is total."""
    w = Window.partitionBy("request", *also).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(index: DataFrame, requests: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, slices: int = 16) -> DataFrame:
    """The k best texts of each request by BM25 (request, id, score, rank), any term matching.

    index: from `postings` with `lexical_terms`. requests: request, scope, text. Statistics are those
    of the request's scope; the weight of a term that more than half of the texts have is 1e-6.
    Requests without terms, or whose terms occur nowhere in the scope, give no row.

    Only postings of asked terms are shuffled to the requests, and those of a term lie in `slices`
    parts by text, so that the postings of a common term in a large scope are not one key. A request
    meets each part on its own and keeps its k best there: a text's score is whole within its part."""
    asked = requests.select("request", "scope", F.explode(request_terms(F.col("text"))).alias("term")).distinct()
    stats = index.select("scope", "id", "dl").distinct().groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = index.join(asked.select("scope", "term").distinct(), ["scope", "term"], "left_semi")
    df = wanted.groupBy("scope", "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = df.join(stats, "scope").select("scope", "term", "avgdl", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))
    terms_ = asked.join(weighed, ["scope", "term"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    sliced = wanted.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = terms_.join(sliced, ["scope", "term", "part"]).groupBy("request", "part", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    return _ranked(_ranked(scores, k, "part").select("request", "id", "score"), k)


def best_places(raw: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places that the k best of `raw` are among however scores are rounded within `slack`; of places
    with the same value, ties go to the first, so that no more than k of them are kept."""
    if len(raw) <= k:
        return np.arange(len(raw))
    some = np.flatnonzero(raw >= np.partition(raw, len(raw) - k)[len(raw) - k] - slack)
    some = some[np.argsort(-raw[some], kind="stable")]
    first = np.r_[True, np.diff(raw[some]) != 0]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))
    return some[np.arange(len(some)) - begin < k]


def bm25_texts(texts: DataFrame, requests: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, slices: int = 8) -> DataFrame:
    """As `bm25`, for the texts themselves (project_id, id, text; an id once) and any number of hits.

    Of the texts' terms only those that are asked for in the scope leave the task that reads them (the
    distinct ones, by scope, are sent to every task). A scope's texts lie in `slices` parts; a part's
    postings and requests meet in one task, which adds up scores and hands on what may be among the k best."""
    asked = requests.where("scope is not null").select("request", "scope", F.explode(request_terms(F.col("text"))).alias("term")).distinct()
    wanted = asked.select("scope", "term").union(asked.select("scope", F.lit(""))).distinct()  # "" stands for the text itself
    found = texts.select(F.col("project_id").alias("scope"), "id", lexical_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    each = found.select("scope", "id", "terms", F.size("terms").alias("dl"), F.posexplode(F.concat("terms", F.array(F.lit("")))).alias("at", "term"))
    kept = written(each.join(F.broadcast(wanted), ["scope", "term"], "left_semi").select("scope", "id", "dl", "term", ((F.col("term") == "") | (F.array_position("terms", F.col("term")) == F.col("at") + 1)).alias("once")))
    counts = kept.where("once").groupBy("scope", "term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))
    stats = counts.where("term = ''").select("scope", F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = counts.where("term <> ''").join(stats, "scope").select("scope", "term", "avgdl", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))
    left = asked.join(weighed, ["scope", "term"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = kept.where("term <> ''").select("scope", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("part"), "id", "dl", "term")

    def best(ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(rows):
            return pd.DataFrame({"request": [], "id": [], "score": []}, dtype=object)
        ids, place = np.unique(rows["id"].to_numpy(dtype=object), return_inverse=True)
        length = np.zeros(len(ids))
        length[place] = rows["dl"]
        term, names = pd.factorize(rows["term"])
        at, tf = np.unique(term.astype(np.int64) * len(ids) + place, return_counts=True)
        begin = np.searchsorted(at, np.arange(len(names) + 1) * len(ids))
        at, known = at % len(ids), {t: i for i, t in enumerate(names)}
        norm = k1 * (1 - b + b * length[at] / ask["avgdl"].iloc[0])
        weight, out = tf * (k1 + 1) / (tf + norm), []
        for request, own in ask.sort_values(["request", "term"]).groupby("request", sort=False):
            total = np.zeros(len(ids))
            for t, w in zip(own["term"], own["idf"]):
                if t in known:
                    run = slice(begin[known[t]], begin[known[t] + 1])
                    total[at[run]] += w * weight[run]
            some = np.flatnonzero(total)
            some = some[best_places(total[some], k, 2e-6)]
            out.append((request, some, total[some]))
        at = np.concatenate([x[1] for x in out])
        return pd.DataFrame({"request": np.repeat([x[0] for x in out], [len(x[1]) for x in out]), "id": pd.Series(ids[at], dtype=object), "score": np.concatenate([x[2] for x in out])})

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((requests, "request"), (texts, "id"))}
    scores = left.groupBy("scope", "part").cogroup(right.groupBy("scope", "part")).applyInPandas(best, f"request {kinds['request']}, id {kinds['id']}, score double")
    return _ranked(scores.select("request", "id", F.round("score", 6).alias("score")), k)


def cosine_terms(index: DataFrame, requests: DataFrame, k: int = 10, slices: int = 16) -> DataFrame:
    """The k best texts of each request by the cosine of term counts (request, id, score, rank).
    Texts without a common term have the score 0 and are left out. Postings lie in parts as in `bm25`."""
    asked = requests.select("request", "scope", F.explode(terms(F.col("text"))).alias("term")).groupBy("request", "scope", "term").agg(F.count("*").alias("q"))
    q_norm = asked.groupBy("request").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    d_norm = index.groupBy("scope", "id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("dn"))
    parts = asked.join(q_norm, "request").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    sliced = index.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    dots = parts.join(sliced, ["scope", "term", "part"]).groupBy("request", "scope", "part", "qn", "id").agg(F.sum(F.col("q") * F.col("tf")).alias("dot"))
    scores = dots.join(d_norm, ["scope", "id"]).select("request", "part", "id", F.round(F.col("dot") / (F.col("qn") * F.col("dn")), 6).alias("score"))
    return _ranked(_ranked(scores, k, "part").select("request", "id", "score"), k)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, id: str, vector: str, k: int = 10, block: int = 4096) -> DataFrame:
    """The k nearest vectors of each query by cosine, itself left out (request, id, score, rank).

    Exact: queries and vectors are cut into blocks of about `block` rows, each pair of blocks is one
    matrix product in one task that keeps the k best of each query, and those are ranked. Null and
    empty vectors, and those of another dimension than the query, give no row."""
    side = lambda df, name: df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(
        F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(name).alias("side"), F.size(vector).alias("dim")
    )
    ask, data = side(queries, "q"), side(vectors, "d")
    n_ask, n_data = max(1, -(-ask.count() // block)), max(1, -(-data.count() // block))
    numbers = lambda n: F.array(*[F.lit(i) for i in range(n)])
    ask = ask.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_ask)).cast("int")).withColumn("db", F.explode(numbers(n_data) if n_data < 200 else F.sequence(F.lit(0), F.lit(n_data - 1))))
    data = data.withColumn("db", F.pmod(F.xxhash64("id"), F.lit(n_data)).cast("int")).withColumn("qb", F.explode(numbers(n_ask) if n_ask < 200 else F.sequence(F.lit(0), F.lit(n_ask - 1))))
    kind = vectors.schema[id].dataType.simpleString()

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        q, d = frame[frame["side"] == "q"], frame[frame["side"] == "d"]
        if not len(q) or not len(d):
            return pd.DataFrame({"request": [], "id": [], "score": []})
        a, b = np.stack(q["v"].to_list()), np.stack(d["v"].to_list())
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b))
        score = np.round(a @ b.T, 6)
        qi, di = q["id"].to_numpy(), d["id"].to_numpy()
        score[qi[:, None] == di[None, :]] = -2
        out = []
        for i in range(len(qi)):
            top = np.lexsort((di, -score[i]))[: k + 1]
            out.append(pd.DataFrame({"request": qi[i], "id": di[top], "score": score[i][top]}))
        found = pd.concat(out)
        return found[found["score"] > -2]

    pairs = ask.unionByName(data.select(*ask.columns)).groupBy("qb", "db", "dim").applyInPandas(best, f"request {kind}, id {kind}, score double")
    return _ranked(pairs, k)


def reciprocal_ranks(*lists: DataFrame, k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (request, id, rank): sum of weight / (k + rank)."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select("request", "id", (F.lit(w) / (k + F.col("rank"))).alias("s")) for x, w in zip(lists, weights)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("request", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id")))


#: Weights of a chunk's signals; the last has the value 0.5 until evidence is linked.
CHUNK_WEIGHTS = {"vector": 0.30, "lexical": 0.25, "module": 0.15, "symbol": 0.10, "fresh": 0.10, "quality": 0.05, "evidence": 0.05}


def hybrid(lexical: DataFrame, vector: DataFrame, chunks: DataFrame, requests: DataFrame, k: int = 10, source_types: list[str] | None = None) -> DataFrame:
    """The k best chunks of each request by seven weighted signals (request, id, score, rank).

    lexical, vector: ranked hits (request, id, rank, score) of the two searches. chunks: chunk_id,
    content, source_type, index_status, module_paths, related_symbols. requests: request, files,
    symbols (arrays; null is empty). Stale chunks, chunks without content, and those of other types
    than `source_types` are dropped; of chunks that begin with the same 200 characters the best stays."""
    lex = lexical.select("request", "id", (2 / (60 + F.col("rank") - 1)).alias("lexical"))
    vec = vector.select("request", "id", F.col("score").alias("vector"))
    hits = lex.join(vec, ["request", "id"], "full_outer").na.fill(0.0, ["lexical", "vector"])
    kept = chunks.where("index_status <> 'stale' and content <> ''")
    if source_types is not None:
        kept = kept.where(F.col("source_type").isin(source_types))
    empty = F.array().cast("array<string>")
    asked = requests.select(
        "request",
        F.array_distinct(F.flatten(F.transform(F.coalesce("files", empty), module_prefixes))).alias("q_modules"),
        F.array_distinct(F.transform(F.coalesce("symbols", empty), F.lower)).alias("q_symbols"),
    )
    both = hits.join(kept.withColumnRenamed("chunk_id", "id"), "id").join(asked, "request")
    share = lambda own, theirs: F.coalesce(F.try_divide(F.size(F.array_intersect(own, theirs)), F.size(F.array_distinct(own))), F.lit(0.0))
    signals = {
        "vector": F.col("vector"),
        "lexical": F.col("lexical"),
        "module": share(F.coalesce("module_paths", empty), F.col("q_modules")),
        "symbol": share(F.transform(F.coalesce("related_symbols", empty), F.lower), F.col("q_symbols")),
        "fresh": F.when(F.col("index_status") == "indexed", 0.9).otherwise(0.2),
        "quality": source_quality(F.col("source_type")),
        "evidence": F.lit(0.5),
    }
    score: Column = F.lit(0.0)
    for name, weight in CHUNK_WEIGHTS.items():
        score = score + weight * signals[name]
    scored = both.select("request", "id", "content", F.round(score, 4).alias("score"))
    unique = first_by_prefix(scored, ["request"], "content", 200, [F.desc("score"), F.col("id")])
    return _ranked(unique.select("request", "id", "score"), k)


def normalized_scores(hits: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """Scores scaled to 0..1 within each group; 1 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(name, F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def first_by_prefix(rows: DataFrame, by: list[str], text: str, chars: int, order: list[Column]) -> DataFrame:
    """One row for each beginning of `chars` characters within a group: the first by `order`."""
    prefix = F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars)
    w = Window.partitionBy(*by, F.xxhash64(prefix), prefix).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def within_budget(rows: DataFrame, by: str, order: list[Column], tokens: str, budget: Column, rule: str) -> DataFrame:
    """Rows with `used` (tokens of the group up to the row) and `action`.

    prefix: stops before the first row that would exceed the budget; overshoot: takes rows while the
    budget is not reached before them; both are running sums."""
    run = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(tokens).over(run)
    fits = used <= budget if rule == "prefix" else used - F.col(tokens) < budget
    return rows.withColumn("used", used).withColumn("action", F.when(fits, "included").otherwise("over_budget"))


def greedy_budget(rows: DataFrame, by: list[str], order: list[str], id: str, tokens: str, budget: Column) -> DataFrame:
    """Greedy fill: in order, a row is taken if it still fits, and smaller ones after it may be.

    Not a running sum: the rows of a group are folded in order. `order` are columns, best least
    first. A group holds the candidates of one request, which the search before it has limited.
    Returns by, id, tokens, taken (boolean)."""
    items = F.array_sort(F.collect_list(F.struct(*order, id, tokens)))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))
    step = lambda acc, x: F.when(
        acc["used"] + x[tokens] <= F.col("_budget"), F.struct((acc["used"] + x[tokens]).cast("long").alias("used"), F.concat(acc["taken"], F.array(F.lit(True))).alias("taken"))
    ).otherwise(F.struct(acc["used"].alias("used"), F.concat(acc["taken"], F.array(F.lit(False))).alias("taken")))
    groups = rows.groupBy(*by).agg(items.alias("_items"), F.max(budget).alias("_budget"))
    folded = groups.withColumn("_taken", F.aggregate("_items", empty, step)["taken"])
    each = folded.select(*by, F.explode(F.arrays_zip("_items", "_taken")).alias("x"))
    return each.select(*by, F.col(f"x._items.{id}").alias(id), F.col(f"x._items.{tokens}").alias(tokens), F.col("x._taken").alias("taken"))
