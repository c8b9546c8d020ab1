"""Context for requests: ranked notes, packs under bucket budgets, search over several layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import jaccard, overlap, path_quality, token_estimate, word_set
from ctxspark.operators import search

#: Weights of a note's signals. The two similarities are one until vectors are given.
NOTE_WEIGHTS = {"lexical": 0.35, "module": 0.10, "symbol": 0.05, "affinity": 0.10, "tree": 0.15, "importance": 0.10, "confidence": 0.10, "fresh": 0.10}

#: Tokens of the kinds of notes in a pack of 6,000.
BUCKETS = {"constraint": 800, "architecture": 900, "module": 1800, "decision": 1700, "debug": 1700, "procedure": 500}

#: Worth of a layer by its place among the preferred ones, and of any other.
LAYER_WORTH, OTHER_LAYER = [1.0, 0.6, 0.3], 0.2


#: Weights of the signals of a note on a branch, and worth of its scope.
BRANCH_WEIGHTS = {"base": 0.35, "affinity": 0.20, "valid": 0.15, "working": 0.10, "fresh": 0.10, "scope": 0.10}
SCOPE_WORTH = {"current_branch": 1.0, "inherited_branch": 0.7, "mainline": 0.5, "global": 0.3, "historical": 0.2, "unknown": 0.3}

#: States of notes that no pack takes.
EXCLUDED_STATES = ["stale", "superseded", "archived"]

#: Worth of a kind of note for an intent; 0.5 for any other pair.
AFFINITY_KINDS = ["debug", "constraint", "decision", "module", "procedure", "architecture", "outcome"]
AFFINITY = {
    "bug_fix": [1.0, 0.9, 0.8, 0.7, 0.6, 0.4, 0.3],
    "test_failure": [1.0, 0.8, 0.5, 0.6, 0.9, 0.3, 0.4],
    "refactor": [0.6, 0.9, 0.85, 0.8, 0.4, 1.0, 0.3],
    "feature_implementation": [0.3, 0.85, 0.65, 1.0, 0.7, 0.8, 0.4],
    "architecture_review": [0.2, 0.6, 0.5, 0.7, 0.2, 1.0, 0.3],
    "code_explanation": [0.4, 0.6, 0.7, 1.0, 0.5, 0.9, 0.5],
    "repository_onboarding": [0.3, 0.75, 0.5, 0.8, 0.7, 1.0, 0.4],
    "workflow_question": [0.2, 0.4, 0.3, 0.5, 1.0, 0.6, 0.3],
    "trivial_edit": [0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1],
}


def affinity_table(spark: SparkSession) -> DataFrame:
    """(intent, kind, weight): the fixed table."""
    rows = [(intent, kind, w) for intent, worth in AFFINITY.items() for kind, w in zip(AFFINITY_KINDS, worth)]
    return spark.createDataFrame(rows, "intent string, kind string, weight double")


def excluded(status: Column) -> Column:
    """Why a note is left out of packs; null if it is not."""
    state = F.lower(F.trim(status))
    return F.when(state.isin(EXCLUDED_STATES), F.concat(F.lit("Memory status is "), state))


def branch_score(base: Column, branch: Column, branch_name: Column, branch_scope: Column, valid_to: Column, source_path: Column, modified: Column) -> Column:
    """The score of a note for a request on `branch`: its base score with how close its branch is,
    whether it is still valid, whether its source is among the modified files, and its scope. The
    base score itself where the request has no branch."""
    scope = F.coalesce(branch_scope, F.lit("global"))
    near = (
        F.when(branch_name.isNull() | (scope == "global"), 0.3)
        .when(branch_name == branch, 1.0)
        .when(scope == "mainline", 0.5)
        .when(scope == "inherited_branch", 0.6)
        .otherwise(0.1)
    )
    path = F.regexp_replace(source_path, "^/+", "")
    touched = F.coalesce(F.exists(F.coalesce(modified, F.array().cast("array<string>")), lambda f: (f != "") & (F.contains(f, path) | F.contains(path, f))), F.lit(False)) & (source_path != "")
    worth: Column = F.lit(0.3)
    for name, x in SCOPE_WORTH.items():
        worth = F.when(scope == name, x).otherwise(worth)
    signals = {"base": base, "affinity": near, "valid": F.when(valid_to.isNull(), 1.0).otherwise(0.0), "working": F.when(touched, 1.0).otherwise(0.0), "fresh": F.lit(0.5), "scope": worth}
    score: Column = F.lit(0.0)
    for name, weight in BRANCH_WEIGHTS.items():
        score = score + weight * signals[name]
    return F.when(branch.isNull(), base).otherwise(score)


def freshness(updated: Column, as_of: Column) -> Column:
    """Halves every 180 days, at least 0.2."""
    age = F.greatest(F.lit(0), F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / 86_400_000_000
    return F.greatest(F.lit(0.2), F.pow(F.lit(2.0), -age / 180))


def rank_notes(requests: DataFrame, notes: DataFrame, as_of: str, affinity: DataFrame | None = None, k: int = 20, slices: int = 16, branches: bool = False, digits: int = 4) -> DataFrame:
    """The k best notes of each request's project (request, id, kind, n_tokens, score, rank).

    requests: request, scope, text, files (array), and optionally intent. notes: id, project_id,
    kind, title, summary, tags, module_path, depth, importance, confidence, updated_at, and optionally status: stale,
    superseded and archived notes are left out. affinity: (intent, kind, weight), 0.5 where it has no
    row. With `branches`, requests have `branch` too, notes branch_name, branch_scope and module_path
    as their source, and the score is `branch_score`.

    Every note of the project is scored, because most signals need no common word. A project's notes
    lie in `slices` parts by id, each of which a request meets on its own and of which it keeps its k
    best, so that no project is one key; only word sets and numbers travel. Without `branches`, a part's
    requests and notes meet in one task and their pairs are never rows (`_scored_pairs`)."""
    asked = requests.select(
        "request", "scope", word_set(F.col("text")).alias("q"), F.array_distinct(F.flatten(F.transform("files", lambda f: word_set(F.regexp_replace(f, r"[/\\._-]", " "))))).alias("stems"),
        F.col("intent") if "intent" in requests.columns else F.lit("unknown").alias("intent"), *(["branch", "files"] if branches else []),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"),
    )
    shown = notes.where(excluded(F.col("status")).isNull()) if "status" in notes.columns else notes
    node = shown.select(
        F.col("project_id").alias("scope"), "id", "kind", word_set(F.concat_ws(" ", "title", "summary", F.array_join(F.coalesce("tags", F.array()), " "))).alias("w"),
        word_set(F.regexp_replace(F.coalesce("module_path", F.lit("")), r"\.", " ")).alias("m"), F.array_distinct(F.transform(F.coalesce("tags", F.array()), F.lower)).alias("t"), "depth", "importance", "confidence",
        freshness(F.col("updated_at"), F.lit(as_of)).alias("fresh"), token_estimate(F.coalesce("summary", F.lit(""))).alias("n_tokens"),
        *(["branch_name", "branch_scope", "module_path"] if branches else []), F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("part"),
    )
    if not branches:
        found = _scored_pairs(asked, node, {} if affinity is None else {(r["intent"], r["kind"]): r["weight"] for r in affinity.collect()}, k, 2 * 10.0**-digits)
        return search._ranked(found.select("request", "id", "kind", "n_tokens", F.round("raw", digits).alias("score")), k)
    both = asked.join(node, ["scope", "part"])
    if affinity is None:
        both = both.withColumn("weight", F.lit(0.5))
    else:
        both = both.join(F.broadcast(affinity), ["intent", "kind"], "left")  # intents times kinds: a fixed table
    signals = {
        "lexical": jaccard(F.col("q"), F.col("w")),
        "module": overlap(F.col("m"), F.col("stems")),
        "symbol": overlap(F.col("q"), F.col("t")),
        "affinity": F.coalesce("weight", F.lit(0.5)),
        "tree": 1 / (1 + 0.2 * F.coalesce("depth", F.lit(0))),
        "importance": F.coalesce("importance", F.lit(0.0)),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "fresh": F.coalesce("fresh", F.lit(0.2)),
    }
    score: Column = F.lit(0.0)
    for name, weight in NOTE_WEIGHTS.items():
        score = score + weight * signals[name]
    if branches:
        path = F.regexp_replace("module_path", r"\.", "/")
        score = branch_score(score, F.col("branch"), F.col("branch_name"), F.col("branch_scope"), F.lit(None), path, F.col("files"))
    scored = both.select("request", "part", "id", "kind", "n_tokens", F.round(score, digits).alias("score"))
    return search._ranked(search._ranked(scored, k, "part").drop("part", "rank"), k)


def _shared_words(rows: list, columns: list) -> np.ndarray:
    """How many words each set of `rows` has in common with each of `columns`."""
    place: dict[str, int] = {}
    for x in rows:
        for w in x:
            place.setdefault(w, len(place))

    def dense(sets: list) -> np.ndarray:
        out = np.zeros((len(sets), max(1, len(place))), dtype=np.float32)
        for i, x in enumerate(sets):
            out[i, [place[w] for w in x if w in place]] = 1
        return out

    return (dense(rows) @ dense(columns).T).astype(np.float64)


def _scored_pairs(asked: DataFrame, node: DataFrame, affinity: dict, k: int, slack: float) -> DataFrame:
    """(request, id, kind, n_tokens, raw): of each request and part, the notes that may be among its k
    best once scores are rounded. Requests are taken 256 at a time."""

    def best(ask: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        columns = ["request", "id", "kind", "n_tokens", "raw"]
        if not len(ask) or not len(notes):
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        notes = notes.sort_values("id")
        sets = lambda frame, c: [[] if x is None else x for x in frame[c]]
        size = lambda x: np.array([len(y) for y in x], dtype=np.float64)
        number = lambda c, other: notes[c].astype("float64").fillna(other).to_numpy()
        w, m, t = (sets(notes, c) for c in "wmt")
        kinds, kind_of = pd.factorize(notes["kind"], use_na_sentinel=False)
        n_w, n_m = size(w), size(m)
        ids, names, tokens = notes["id"].to_numpy(dtype=object), notes["kind"].to_numpy(dtype=object), notes["n_tokens"].to_numpy()
        out = []
        for first in range(0, len(ask), 256):
            some = ask.iloc[first : first + 256]
            q, stems = sets(some, "q"), sets(some, "stems")
            n_q, both = size(q)[:, None], _shared_words(q, w)
            weight = np.array([[affinity.get((i, x), 0.5) for x in kind_of] for i in some["intent"]])[:, kinds]
            signals = {
                "lexical": both / np.maximum(n_q + n_w - both, 1),
                "module": _shared_words(stems, m) / np.maximum(n_m, 1),
                "symbol": _shared_words(q, t) / np.maximum(n_q, 1),
                "affinity": weight,
                "tree": 1 / (1 + 0.2 * number("depth", 0)),
                "importance": number("importance", 0.0),
                "confidence": number("confidence", 0.0),
                "fresh": number("fresh", 0.2),
            }
            raw = np.zeros((len(some), len(notes)))
            for name, x in NOTE_WEIGHTS.items():
                raw = raw + x * signals[name]
            for request, row in zip(some["request"], raw):
                at = search.best_places(row, k, slack)
                out.append((request, at, row[at]))
        at = np.concatenate([x[1] for x in out])
        text = lambda x: pd.Series(x[at], dtype=object)
        return pd.DataFrame({"request": np.repeat([x[0] for x in out], [len(x[1]) for x in out]), "id": text(ids), "kind": text(names), "n_tokens": tokens[at], "raw": np.concatenate([x[2] for x in out])})

    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((asked, "request"), (node, "id"), (node, "kind"), (node, "n_tokens")))
    left, right = (df.where("scope is not null").groupBy("scope", "part") for df in (asked, node))
    return left.cogroup(right).applyInPandas(best, f"{types}, raw double")


def note_pack(ranked: DataFrame, total: int = 6000) -> DataFrame:
    """Ranked notes that fit into their kind's share of `total` tokens, greedily: a note too large is
    skipped and smaller ones after it may still be taken. Decisions and incidents share a bucket; outcomes are in no pack."""
    bucket, budget = F.lit(None).cast("string"), F.lit(0)
    for kind, tokens in BUCKETS.items():
        bucket = F.when(F.col("kind") == kind, "decision" if kind == "debug" else kind).otherwise(bucket)
        budget = F.when(F.col("kind") == kind, int(tokens * total / 6000)).otherwise(budget)
    rows = ranked.withColumn("bucket", bucket).withColumn("budget", budget).where("bucket is not null")
    filled = search.greedy_budget(rows, ["request", "bucket"], ["rank"], "id", "n_tokens", F.col("budget"))
    return filled.where("taken").drop("taken")


def evidence_fill(notes: DataFrame, evidence: DataFrame, budget: int) -> DataFrame:
    """Evidence of a pack's notes within `budget` tokens (request, note, evidence, n_tokens).

    notes: request, id, bucket, rank; those of the buckets constraint and decision take part, in that
    order and by rank. evidence: note, evidence, created_at, n_tokens. A note's evidence is taken in
    order until one piece would exceed the budget; then the next note goes on with what is left. The
    pieces of one request's pack are folded in order: a pack is bounded by its own budget, and of a
    note no more than `budget` pieces can fit, so that no more are gathered."""
    order = F.when(F.col("bucket") == "constraint", 0).when(F.col("bucket") == "decision", 1)
    mine = notes.withColumn("o", order).where("o is not null").select("request", "o", "rank", F.col("id").alias("note"))
    first = Window.partitionBy("note").orderBy("created_at", "evidence")
    some = evidence.withColumn("i", F.row_number().over(first)).where(F.col("i") <= budget)
    items = F.array_sort(F.collect_list(F.struct("o", "rank", "note", "i", "evidence", "n_tokens")))
    groups = mine.join(some, "note").groupBy("request").agg(items.alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit("").alias("closed"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        shut = acc["closed"] == x["note"]
        fits = ~shut & (acc["used"] + x["n_tokens"] <= budget)
        return F.struct(
            (acc["used"] + F.when(fits, x["n_tokens"]).otherwise(0)).cast("long").alias("used"), F.when(fits | shut, acc["closed"]).otherwise(x["note"]).alias("closed"), F.concat(acc["taken"], F.array(fits)).alias("taken")
        )

    folded = groups.select("request", F.explode(F.arrays_zip("x", F.aggregate("x", start, step)["taken"].alias("taken"))).alias("y"))
    return folded.where("y.taken").select("request", "y.x.note", "y.x.evidence", "y.x.n_tokens")


def with_parents(hits: DataFrame, links: DataFrame, summaries: DataFrame) -> DataFrame:
    """Hits (request, id, source_path) with what they belong to, once a request: `how` is `hit`, `parent`
    (the parent of a hit by links: id, parent) or `module` (the summary of a hit's path by summaries:
    source_path, id), where that is no hit itself."""
    own = hits.select("request", "id", F.lit("hit").alias("how"))
    parents = hits.select("request", "id").join(links.where("parent is not null"), "id").select("request", F.col("parent").alias("id"), F.lit("parent").alias("how"))
    modules = hits.select("request", "source_path").join(summaries, "source_path").select("request", "id", F.lit("module").alias("how"))
    more = parents.unionByName(modules).join(own.select("request", "id"), ["request", "id"], "left_anti")
    return own.distinct().unionByName(more.groupBy("request", "id").agg(F.max("how").alias("how")))


def layered_search(layers: dict[str, DataFrame], requests: DataFrame, preferred: list[str], texts: DataFrame, k: int = 10, budget: int = 600, types: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Search over several layers at once (request, layer, id, score, rank, n_tokens, and text if asked for).

    layers: texts (project_id, id, text) or postings with `lexical_terms` by name. Each layer gives its ten best texts; scores are
    scaled to 0..1 within request and layer (the best is 1), weighted with the layer's place among
    `preferred`, with whether a statement is of one of `types` (neutral for texts without a type, or
    without `types`), with the quality of the source's path, and with freshness. The 2k best are kept,
    one for each beginning of 150 characters; rows are taken while the budget is not reached.
    texts: layer, id, text, and optionally type and source_path."""
    for name in ("type", "source_path"):
        if name not in texts.columns:
            texts = texts.withColumn(name, F.lit(None).cast("string"))
    hits = None
    for name, index in layers.items():
        part = (search.bm25 if "term" in index.columns else search.bm25_texts)(index, requests).select("request", F.lit(name).alias("layer"), "id", "score")
        hits = part if hits is None else hits.unionByName(part)
    scaled = search.normalized_scores(hits, ["request", "layer"], "score", "norm").join(texts, ["layer", "id"])
    worth: Column = F.lit(OTHER_LAYER)
    for i, name in enumerate(preferred):
        worth = F.when(F.col("layer") == name, LAYER_WORTH[min(i, 2)]).otherwise(worth)
    typed = F.when(F.col("type").isNull(), 0.5).when(F.col("type").isin(types), 1.0).otherwise(0.0) if types else F.lit(0.5)
    score = 0.5 * F.col("norm") + 0.2 * worth + 0.15 * typed + 0.1 * path_quality(F.col("source_path")) + 0.05
    scored = scaled.select("request", "layer", "id", "text", F.round(score, 4).alias("score"))
    order = [F.desc("score"), F.col("layer"), F.col("id")]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(*order))).where(F.col("rank") <= 2 * k)
    full = best.withColumn("n_tokens", token_estimate(F.col("text")))
    unique = search.first_by_prefix(full, ["request"], "text", 150, order)
    taken = search.within_budget(unique, "request", order, "n_tokens", F.lit(budget), "overshoot").where("action = 'included'")
    ranked = taken.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("request", "layer", "id", "score", "rank", "n_tokens", *(["text"] if with_text else []))


def not_in_pack(hits: DataFrame, pack_texts: DataFrame, share: float = 0.7) -> DataFrame:
    """Hits (request, id, text) that repeat no text of the request's pack (request, text): those of
    which no pack text has more than `share` of its words in the hit's text."""
    pack = pack_texts.select("request", F.split(F.lower(F.substring("text", 1, 300)), r"\s+").alias("w"))
    pairs = hits.select("request", "id", F.lower("text").alias("t")).join(pack, "request")
    inside = F.size(F.filter("w", lambda x: F.contains(F.col("t"), x)))
    repeats = pairs.where(inside / F.greatest(F.size("w"), F.lit(1)) > share).select("request", "id").distinct()
    return hits.join(repeats, ["request", "id"], "left_anti")
