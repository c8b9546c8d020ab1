"""Queries that build a request's context, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.functions.text import token_estimate
from ctxspark.operators import context, search
from ctxspark.operators.lifecycle import latest
from ctxspark.plans.knowledge import _NODES, _nodes
from ctxspark.plans.retrieval import _ASK, _LEX, _QUALITY, _STATES, _chunks, _requests
from ctxspark.runtime import table, written

AS_OF = "2024-09-01"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The query set: documents whose id is divisible by 20, with their path as the open file."""
    docs = table(spark, d, "documents").where("doc_id % 20 = 0")
    intent = F.when(F.col("source_type") == "test_report", "test_failure").when(F.col("source_type") == "runtime_log", "bug_fix").when(F.col("source_type") == "git_diff", "refactor").otherwise("unknown")
    files = F.array_compact(F.array("source_path"))
    return docs.select(F.col("doc_id").alias("request"), F.col("project_id").alias("scope"), F.col("title").alias("text"), files.alias("files"), intent.alias("intent"), F.lit("main").alias("branch"))


def _ranked(spark: SparkSession, d: str, nodes: DataFrame | None = None) -> DataFrame:
    return context.rank_notes(_asked(spark, d), _nodes(spark, d) if nodes is None else nodes, AS_OF, context.affinity_table(spark))


def rank_on_branch(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best notes of each request on the branch `main`."""
    return context.rank_notes(_asked(spark, d), _nodes(spark, d), AS_OF, context.affinity_table(spark), branches=True, digits=8)


def pack_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the constraints and decisions of each pack, within 400 tokens."""
    evidence = table(spark, d, "evidence").groupBy("memory_node_id", "id").agg(F.min("created_at").alias("created_at"), F.max("content").alias("content"))
    sized = evidence.select(F.col("memory_node_id").alias("note"), F.col("id").alias("evidence"), "created_at", token_estimate(F.coalesce("content", F.lit(""))).alias("n_tokens"))
    packed = compose_pack(spark, d).join(_ranked(spark, d).select("request", "id", "rank"), ["request", "id"])
    return context.evidence_fill(packed, sized, 400)


def rank_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best notes of each request by eight weighted signals."""
    return _ranked(spark, d)


def compose_pack(spark: SparkSession, d: str) -> DataFrame:
    """The ranked notes that fit into a pack of 1,500 tokens."""
    return context.note_pack(_ranked(spark, d), 1500)


def _layers(spark: SparkSession, d: str, nodes: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The layers' texts, written once, by name and together."""
    nodes = _nodes(spark, d) if nodes is None else nodes
    owner = latest(table(spark, d, "documents").where("document_id is not null"), ["document_id"], [F.desc("created_at"), F.desc("doc_id")]).select("document_id", "project_id", "source_path")
    rows = table(spark, d, "raw_propositions").groupBy("document_id", "paragraph_index").agg(F.max("proposition_text").alias("text"), F.max("proposition_type").alias("type"))
    none = F.lit(None).cast("string")
    parts = {
        "proposition": rows.join(owner, "document_id").select(F.concat_ws("#", "document_id", F.col("paragraph_index").cast("string")).alias("id"), "project_id", "text", "type", "source_path"),
        "chunk": _chunks(spark, d).select(F.col("chunk_id").alias("id"), "project_id", F.col("content").alias("text"), none.alias("type"), "source_path"),
        "summary": nodes.select("id", "project_id", F.col("summary").alias("text"), none.alias("type"), none.alias("source_path")),
    }
    parts, texts = {name: written(part) for name, part in parts.items()}, None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("layer"), "id", "text", "type", "source_path")
        texts = row if texts is None else texts.unionByName(row)
    return parts, texts


def _layer_hits(spark: SparkSession, d: str, layers: dict[str, DataFrame], texts: DataFrame, with_text: bool = False) -> DataFrame:
    return context.layered_search(layers, _requests(spark, d), ["proposition", "chunk"], texts, types=["constraint", "decision", "security_rule"], with_text=with_text)


def layer_search(spark: SparkSession, d: str) -> DataFrame:
    """The best statements, chunks and summaries of each request under 600 tokens."""
    return _layer_hits(spark, d, *_layers(spark, d))


def expanded_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the layers with their parent statements, and with the readme of their path."""
    layers, texts = _layers(spark, d)
    hits = _layer_hits(spark, d, layers, texts).join(texts.select("layer", "id", "source_path"), ["layer", "id"])
    rows = table(spark, d, "raw_propositions").groupBy("document_id", "paragraph_index").agg(F.min("parent_paragraph_index").alias("up"))
    key = lambda i: F.concat_ws("#", "document_id", F.col(i).cast("string"))
    links = rows.where("up is not null").select(key("paragraph_index").alias("id"), key("up").alias("parent"))
    docs = table(spark, d, "documents").where("source_path is not null and document_id is not null").groupBy("source_path").agg(F.min("document_id").alias("id"))
    return context.with_parents(hits, links, docs)


def unified_pack(spark: SparkSession, d: str) -> DataFrame:
    """Notes under 60 % of 1,500 tokens, then search hits that repeat none of them under the rest."""
    wanted = ["id", "project_id", "kind", "title", "summary", "tags", "module_path", "depth", "importance", "confidence", "updated_at", "status"]
    nodes = written(_nodes(spark, d).select(*wanted))
    notes = written(context.note_pack(_ranked(spark, d, nodes), 900))
    summaries = nodes.select("id", F.col("summary").alias("text"))
    hits = written(_layer_hits(spark, d, *_layers(spark, d, nodes), with_text=True))
    fresh = context.not_in_pack(hits, notes.join(summaries, "id").select("request", "text"))
    taken = search.within_budget(fresh, "request", [F.col("rank")], "n_tokens", F.lit(600), "overshoot").where("action = 'included'")
    part = notes.select("request", F.lit("memory").alias("section"), "id", F.col("n_tokens").cast("int").alias("n_tokens"))
    return part.unionByName(taken.select("request", F.col("layer").alias("section"), "id", F.col("n_tokens").cast("int").alias("n_tokens")))


QUERIES = {"expanded_hits": expanded_hits, "rank_on_branch": rank_on_branch, "pack_evidence": pack_evidence, "rank_nodes": rank_nodes, "compose_pack": compose_pack, "layer_search": layer_search, "unified_pack": unified_pack}

_AFFINITY = ", ".join(f"('{intent}', '{kind}', {w})" for intent, worth in context.AFFINITY.items() for kind, w in zip(context.AFFINITY_KINDS, worth))
_W = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: len(x) > 2))"
_RANKED = (
    _NODES
    + rf""", q AS (SELECT doc_id AS request, project_id AS scope, {_W.format('title')} AS q, {_W.format("regexp_replace(coalesce(source_path, ''), '[/\\._-]', ' ', 'g')")} AS stems, CASE source_type WHEN 'test_report' THEN 'test_failure' WHEN 'runtime_log' THEN 'bug_fix' WHEN 'git_diff' THEN 'refactor' ELSE 'unknown' END AS intent, source_path FROM documents WHERE doc_id % 20 = 0),
aff AS (SELECT * FROM (VALUES {_AFFINITY}) t(intent, kind, weight)),
n AS (SELECT project_id AS scope, id, kind, branch_name, branch_scope, module_path, {_W.format("title || ' ' || summary || ' ' || array_to_string(coalesce(tags, []), ' ')")} AS w, {_W.format("replace(coalesce(module_path, ''), '.', ' ')")} AS m,
  list_distinct(list_transform(coalesce(tags, []), lambda x: lower(x))) AS t, depth, importance, confidence,
  greatest(0.2, pow(2.0, -(greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400000000.0) / 180)) AS fresh, greatest(1, length(summary) // 4)::INTEGER AS n_tokens FROM nodes WHERE lower(trim(status)) NOT IN ('stale', 'superseded', 'archived')),
s0 AS (SELECT request, id, n.kind, n_tokens, source_path, branch_name, branch_scope, module_path, (0.35 * coalesce(len(list_intersect(q, w)) / nullif(len(list_distinct(list_concat(q, w))), 0), 0) + 0.1 * coalesce(len(list_intersect(m, stems)) / nullif(len(m), 0), 0)
  + 0.05 * coalesce(len(list_intersect(q, t)) / nullif(len(q), 0), 0) + 0.1 * coalesce(weight, 0.5) + 0.15 * (1 / (1 + 0.2 * depth)) + 0.1 * importance + 0.1 * confidence + 0.1 * fresh)::DOUBLE AS base FROM q JOIN n USING (scope) LEFT JOIN aff ON aff.intent = q.intent AND aff.kind = n.kind),
s AS (SELECT request, id, kind, n_tokens, round(base, 4)::DOUBLE AS score FROM s0),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id)::INTEGER AS rank FROM s) WHERE rank <= 20)
"""
)
_ON_BRANCH = _RANKED.replace(
    "round(base, 4)::DOUBLE AS score FROM s0",
    """round((0.35 * base + 0.2 * CASE WHEN branch_name IS NULL OR coalesce(branch_scope, 'global') = 'global' THEN 0.3 WHEN branch_name = 'main' THEN 1.0 WHEN branch_scope = 'mainline' THEN 0.5 WHEN branch_scope = 'inherited_branch' THEN 0.6 ELSE 0.1 END
  + 0.15 + 0.1 * CASE WHEN coalesce(module_path, '') <> '' AND coalesce(source_path, '') <> '' AND (contains(source_path, ltrim(replace(module_path, '.', '/'), '/')) OR contains(ltrim(replace(module_path, '.', '/'), '/'), source_path)) THEN 1 ELSE 0 END
  + 0.05 + 0.1 * CASE coalesce(branch_scope, 'global') WHEN 'current_branch' THEN 1.0 WHEN 'inherited_branch' THEN 0.7 WHEN 'mainline' THEN 0.5 WHEN 'historical' THEN 0.2 ELSE 0.3 END)::DOUBLE, 8)::DOUBLE AS score FROM s0""",
)
_BUCKET = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{'decision' if k in ('debug', 'outcome') else k}'" for k in context.BUCKETS) + " END"
_BUDGET = "CASE kind " + " ".join(f"WHEN '{k}' THEN {int(v * 1500 / 6000)}" for k, v in context.BUCKETS.items()) + " END"
_BUDGET_900 = "CASE kind " + " ".join(f"WHEN '{k}' THEN {int(v * 900 / 6000)}" for k, v in context.BUCKETS.items()) + " END"
_BY_PATH = "CASE WHEN coalesce(source_path, '') = '' THEN 0.5 " + " ".join(f"WHEN contains(lower(source_path), '{k}') THEN {v}" for k, v in _QUALITY) + " WHEN regexp_matches(lower(source_path), '(^|[.])(py|ts|js)$') THEN 0.7 ELSE 0.6 END"
_PACK_FILL = f""", b AS (SELECT request, id, n_tokens, rank, {_BUCKET} AS bucket, {_BUDGET} AS budget, row_number() OVER (PARTITION BY request, {_BUCKET} ORDER BY rank) AS i FROM ranked WHERE {_BUCKET} IS NOT NULL),
fill AS (SELECT DISTINCT request, bucket, 0::BIGINT AS i, NULL::VARCHAR AS id, 0 AS n_tokens, 0 AS rank, 0::BIGINT AS used, false AS taken FROM b
  UNION ALL SELECT f.request, f.bucket, b.i, b.id, b.n_tokens, b.rank, CASE WHEN f.used + b.n_tokens <= b.budget THEN f.used + b.n_tokens ELSE f.used END, f.used + b.n_tokens <= b.budget
  FROM fill f JOIN b ON b.request = f.request AND b.bucket = f.bucket AND b.i = f.i + 1)"""
_LAYERS = f""", {_STATES}, docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, doc_id DESC) AS rn FROM documents WHERE document_id IS NOT NULL) WHERE rn = 1),
texts AS (
  SELECT 'proposition' AS layer, document_id || '#' || paragraph_index AS id, project_id AS scope, p.text, type, source_path FROM (SELECT document_id, paragraph_index, max(proposition_text) AS text, max(proposition_type) AS type FROM raw_propositions GROUP BY ALL) p JOIN docs USING (document_id)
  UNION ALL SELECT 'chunk', chunk_id, project_id, content, NULL, source_path FROM states WHERE index_status = 'indexed'
  UNION ALL SELECT 'summary', id, project_id, summary, NULL, NULL FROM nodes),
idx AS (SELECT layer, scope, id, dl, term, count(*) AS tf FROM (SELECT layer, scope, id, len(l) AS dl, unnest(l) AS term FROM (SELECT layer, scope, id, {_LEX.format('text')} AS l FROM texts)) GROUP BY ALL),
asked AS (SELECT doc_id AS request, project_id AS scope, unnest({_ASK.format('title')}) AS term FROM documents WHERE doc_id % 20 = 0),
stats AS (SELECT layer, scope, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT layer, scope, id, dl FROM idx) GROUP BY ALL),
df AS (SELECT layer, scope, term, count(*) AS df FROM idx GROUP BY ALL),
weighted AS (SELECT i.layer, i.scope, i.term, i.id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM idx i JOIN df USING (layer, scope, term) JOIN stats USING (layer, scope)),
bm AS (SELECT *, row_number() OVER (PARTITION BY request, layer ORDER BY score DESC, id) AS rank FROM (SELECT request, layer, id, round(sum(w), 6) AS score FROM asked JOIN weighted USING (scope, term) GROUP BY ALL)),
norm AS (SELECT *, min(score) OVER (PARTITION BY request, layer) AS lo, max(score) OVER (PARTITION BY request, layer) AS hi FROM bm WHERE rank <= 10),
ls AS (SELECT request, layer, id, text, greatest(1, length(text) // 4)::INTEGER AS n_tokens, round((0.5 * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END + 0.2 * CASE layer WHEN 'proposition' THEN 1.0 WHEN 'chunk' THEN 0.6 ELSE 0.2 END
  + 0.15 * CASE WHEN type IS NULL THEN 0.5 WHEN type IN ('constraint', 'decision', 'security_rule') THEN 1 ELSE 0 END + 0.1 * {_BY_PATH} + 0.05)::DOUBLE, 4)::DOUBLE AS score FROM norm JOIN texts USING (layer, id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, layer, id) AS r FROM ls) WHERE r <= 20),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request, left(text, 150) ORDER BY score DESC, layer, id) AS p FROM top) WHERE p = 1),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY request ORDER BY score DESC, layer, id) - n_tokens AS before FROM uniq),
layered AS (SELECT * FROM (SELECT request, layer, id, score, text, row_number() OVER (PARTITION BY request ORDER BY score DESC, layer, id)::INTEGER AS rank, n_tokens FROM run WHERE before < 600) WHERE rank <= 10)
"""

ORACLE = {
    "rank_nodes": _RANKED + "SELECT request, id, kind, n_tokens, score, rank FROM ranked",
    "rank_on_branch": _ON_BRANCH + "SELECT request, id, kind, n_tokens, score, rank FROM ranked",
    "compose_pack": _RANKED + _PACK_FILL + "SELECT request, bucket, id, n_tokens FROM fill WHERE taken",
    "pack_evidence": _RANKED
    + _PACK_FILL
    + """, ev AS (SELECT memory_node_id AS note, id AS evidence, min(created_at) AS created_at, greatest(1, length(coalesce(max(content), '')) // 4)::INTEGER AS n_tokens FROM evidence GROUP BY ALL),
pieces AS (SELECT f.request, e.note, e.evidence, e.n_tokens, row_number() OVER (PARTITION BY f.request ORDER BY CASE f.bucket WHEN 'constraint' THEN 0 ELSE 1 END, f.rank, e.note, e.created_at, e.evidence) AS j
  FROM fill f JOIN ev e ON e.note = f.id WHERE f.taken AND f.bucket IN ('constraint', 'decision')),
take AS (SELECT request, 0::BIGINT AS j, NULL::VARCHAR AS note, NULL::VARCHAR AS evidence, 0 AS n_tokens, 0::BIGINT AS used, '' AS closed, false AS taken FROM (SELECT DISTINCT request FROM pieces)
  UNION ALL SELECT t.request, p.j, p.note, p.evidence, p.n_tokens, CASE WHEN t.closed <> p.note AND t.used + p.n_tokens <= 400 THEN t.used + p.n_tokens ELSE t.used END,
    CASE WHEN t.closed <> p.note AND t.used + p.n_tokens > 400 THEN p.note ELSE t.closed END, t.closed <> p.note AND t.used + p.n_tokens <= 400 FROM take t JOIN pieces p ON p.request = t.request AND p.j = t.j + 1)
SELECT request, note, evidence, n_tokens FROM take WHERE taken""",
    "layer_search": _NODES + _LAYERS + "SELECT request, layer, id, score, rank, n_tokens FROM layered",
    "expanded_hits": _NODES
    + _LAYERS
    + """, own AS (SELECT DISTINCT request, id FROM layered),
up AS (SELECT document_id || '#' || paragraph_index AS id, document_id || '#' || min(parent_paragraph_index) AS parent FROM raw_propositions GROUP BY document_id, paragraph_index),
paths AS (SELECT source_path, min(document_id) AS id FROM documents WHERE source_path IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL),
more AS (SELECT request, parent AS id, 'parent' AS how FROM own JOIN up USING (id) WHERE parent IS NOT NULL
  UNION ALL SELECT l.request, p.id, 'module' FROM layered l JOIN texts t USING (layer, id) JOIN paths p ON p.source_path = t.source_path)
SELECT request, id, 'hit' AS how FROM own UNION ALL SELECT request, id, max(how) FROM more m WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.request = m.request AND o.id = m.id) GROUP BY ALL""",
    "unified_pack": _RANKED
    + _PACK_FILL.replace("1500", "900").replace(_BUDGET, _BUDGET_900)
    + _LAYERS
    + r""", pw AS (SELECT f.request, regexp_split_to_array(lower(left(n.summary, 300)), '\s+') AS w FROM fill f JOIN nodes n ON n.id = f.id WHERE f.taken),
repeats AS (SELECT DISTINCT l.request, l.layer, l.id FROM layered l JOIN pw USING (request) WHERE len(list_filter(w, lambda x: contains(lower(l.text), x))) / greatest(len(w), 1) > 0.7),
kept AS (SELECT l.* FROM layered l WHERE NOT EXISTS (SELECT 1 FROM repeats r WHERE r.request = l.request AND r.id = l.id)),
spent AS (SELECT *, sum(n_tokens) OVER (PARTITION BY request ORDER BY rank) - n_tokens AS before2 FROM kept)
SELECT request, 'memory' AS section, id, n_tokens FROM fill WHERE taken UNION ALL SELECT request, layer, id, n_tokens FROM spent WHERE before2 < 600""",
}
