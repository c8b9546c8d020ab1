"""Queries of ingestion, the note tree and the notes' life, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import REDACTIONS
from ctxspark.operators import chunking, lifecycle, paragraphs
from ctxspark.operators.hierarchy import descendants, hierarchies
from ctxspark.runtime import table

MARKDOWN = ["markdown", "readme", "adr", "architecture_doc", "api_spec", "manual_note", "task_artifact"]


def _docs(spark: SparkSession, d: str, kinds: list[str]) -> DataFrame:
    return table(spark, d, "documents").where(F.col("source_type").isin(kinds) & F.col("text").isNotNull()).select("doc_id", "text")


def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_chunks(_docs(spark, d, MARKDOWN), "doc_id", "text").select("doc_id", "chunk_index", "heading_path", F.md5("content").alias("content_md5"))


def chunk_code(spark: SparkSession, d: str) -> DataFrame:
    return chunking.code_chunks(_docs(spark, d, ["code_file", "code_comment"]), "doc_id", "text").select("doc_id", "chunk_index", "symbols", F.md5("content").alias("content_md5"))


def chunk_test_report(spark: SparkSession, d: str) -> DataFrame:
    return chunking.report_chunks(_docs(spark, d, ["test_report"]), "doc_id", "text").select("doc_id", "chunk_index", "symbols", F.md5("content").alias("content_md5"))


def chunk_diff(spark: SparkSession, d: str) -> DataFrame:
    return chunking.diff_chunks(_docs(spark, d, ["git_diff"]), "doc_id", "text").select("doc_id", "chunk_index", "module_path", F.md5("content").alias("content_md5"))


def chunk_log(spark: SparkSession, d: str) -> DataFrame:
    return chunking.log_windows(_docs(spark, d, ["runtime_log"]), "doc_id", "text").fillna(0, ["start_line", "end_line"]).select("doc_id", "start_line", "end_line", "part_no", F.md5("content").alias("content_md5"))


def propositions(spark: SparkSession, d: str) -> DataFrame:
    return chunking.statements(_docs(spark, d, MARKDOWN), "doc_id", "text").select("doc_id", "kind", "normalized", "confidence")


def paragraphs_code(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of code with heading, symbols and summary."""
    found = paragraphs.code_paragraphs(_docs(spark, d, ["code_file", "code_comment"]), "doc_id", "text")
    return found.select("doc_id", "paragraph_index", F.coalesce("heading", F.lit("")).alias("heading"), F.array_join("symbols", " ").alias("symbols"), F.coalesce("summary", F.lit("")).alias("summary"), F.md5("content").alias("content_md5"))


def paragraphs_text(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of texts with heading and summary."""
    found = paragraphs.markdown_paragraphs(_docs(spark, d, MARKDOWN), "doc_id", "text")
    return found.select("doc_id", "paragraph_index", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("summary", F.lit("")).alias("summary"))


def module_summaries(spark: SparkSession, d: str) -> DataFrame:
    """One summary for each code document."""
    name = F.regexp_replace(F.regexp_replace("source_path", r"^.*[/\\\\]", ""), r"\.(?:py|md|ts)$", "")
    names = table(spark, d, "documents").select("doc_id", name.alias("name"))
    found = paragraphs.code_paragraphs(_docs(spark, d, ["code_file", "code_comment"]), "doc_id", "text").join(names, "doc_id")
    return paragraphs.module_summaries(found, "doc_id", "name").select("doc_id", "summary", F.array_join("key_symbols", " ").alias("key_symbols"))


def code_propositions(spark: SparkSession, d: str) -> DataFrame:
    """Statements in docstrings, comments and raised errors."""
    return paragraphs.code_statements(_docs(spark, d, ["code_file", "code_comment", "test_report"]), "doc_id", "text").select("doc_id", "kind", "normalized", "confidence")


def proposition_spans(spark: SparkSession, d: str) -> DataFrame:
    """First and last line of each outline, and its statements by kind."""
    rows = table(spark, d, "raw_propositions").distinct()
    return rows.groupBy("document_id", "proposition_type").agg(
        F.count("*").alias("n_statements"), F.min("source_start_line").alias("first_line"), F.max(F.coalesce("source_end_line", "source_start_line")).alias("last_line")
    )


def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the same text: the first id, and how many there are."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source_path is not null")
    return lifecycle.latest(docs, ["project_id", "source_path"], [F.desc("created_at"), F.desc("doc_id")])


def latest_document(spark: SparkSession, d: str) -> DataFrame:
    """The latest document of each path."""
    return _latest(spark, d).select("project_id", "source_path", "doc_id")


def ingest_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the one of its path that arrived before it."""
    docs = table(spark, d, "documents").where("source_path is not null").select("doc_id", "project_id", "source_path", "created_at", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return lifecycle.ingestion_sequence(docs, ["project_id", "source_path"], "h", ["created_at", "doc_id"]).select("doc_id", "outcome")


def doc_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document, and how many of them are indexed."""
    chunks = table(spark, d, "knowledge_chunks").select("document_id", "chunk_id", "index_status").distinct()
    return chunks.groupBy("document_id").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct(F.when(F.col("index_status") == "indexed", F.col("chunk_id"))).alias("n_indexed"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each note."""
    return lifecycle.latest(table(spark, d, "memory_nodes"), ["id"], [F.desc("updated_at"), F.col("status"), F.desc("retrieval_count")])


def retention_counts(spark: SparkSession, d: str) -> DataFrame:
    """Notes of each project by status, in one pass."""
    status = F.lower(F.trim("status"))
    counts = [F.count_if(status == s).alias(f"n_{s}") for s in ("active", "stale", "superseded", "archived", "needs_review")]
    return _nodes(spark, d).groupBy("project_id").agg(F.count("*").alias("n_nodes"), *counts)


def status_report(spark: SparkSession, d: str) -> DataFrame:
    """Projects with their notes, documents and indexed chunks."""
    nodes = _nodes(spark, d).groupBy("project_id").agg(F.count("*").alias("n_notes"))
    docs = table(spark, d, "documents").groupBy("project_id").agg(F.countDistinct("document_id").alias("n_documents"))
    chunks = table(spark, d, "knowledge_chunks").groupBy("project_id").agg(F.countDistinct(F.when(F.col("index_status") == "indexed", F.col("chunk_id"))).alias("n_indexed"))
    base = table(spark, d, "projects").select(F.col("id").alias("project_id"), "name").distinct()
    return base.join(nodes, "project_id", "left").join(docs, "project_id", "left").join(chunks, "project_id", "left").fillna(0, ["n_notes", "n_documents", "n_indexed"])


def node_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each note with its evidence ids in order of creation."""
    ev = table(spark, d, "evidence").groupBy("memory_node_id", "id").agg(F.min("created_at").alias("created_at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x["id"])
    per = ev.groupBy("memory_node_id").agg(F.array_join(ordered, " ").alias("evidence"), F.count("*").alias("n_evidence"))
    nodes = table(spark, d, "memory_nodes").select("id").distinct()
    return nodes.join(per, nodes.id == per.memory_node_id, "left").select("id", F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def _tree(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    nodes = _nodes(spark, d)
    return hierarchies(nodes.select(F.col("id").alias("key")), nodes.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")), paths=paths)


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """True depth and root of each note by its parent, beside the depth it claims; notes on or below a circle have none."""
    claimed = _nodes(spark, d).select(F.col("id").alias("key"), F.col("depth").alias("claimed"))
    return _tree(spark, d, paths=False).where("depth >= 0").select("key", "root_key", "depth", "n_descendants").join(claimed, "key").withColumnRenamed("key", "id")


def inspect_children(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of each root down to depth two."""
    return descendants(_tree(spark, d)).join(_nodes(spark, d).where("parent_id is null").select(F.col("id").alias("ancestor")), "ancestor", "left_semi").where("distance <= 2").select(
        "ancestor", "descendant", F.col("distance").cast("int").alias("distance")
    )


def consolidated_titles(spark: SparkSession, d: str) -> DataFrame:
    """Parents with the titles of their active children, by creation."""
    children = _nodes(spark, d).where(F.col("parent_id").isNotNull() & (F.lower(F.trim("status")) == "active"))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "title"))), lambda x: x["title"])
    return children.groupBy("parent_id").agg(F.array_join(titles, "; ").alias("titles"), F.count("*").alias("n_children"))


def compaction_groups(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.compaction_groups(_nodes(spark, d).where(F.lower(F.trim("status")) == "active"))


def dedup_matches(spark: SparkSession, d: str) -> DataFrame:
    """Likely duplicates of each note among those on the same module, whatever their project: notes come
    again in other projects, so that the module is the scope here."""
    nodes = _nodes(spark, d).select("id", F.coalesce("module_path", F.lit("")).alias("project_id"), "kind", "module_path", "title", "summary")
    return lifecycle.likely_duplicates(nodes, nodes)


def conflicting_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the one of their path that arrived before, where their texts use opposing words."""
    docs = table(spark, d, "documents").where("source_path is not null and text is not null")
    before = F.lag("doc_id").over(Window.partitionBy("project_id", "source_path").orderBy("created_at", "doc_id"))
    pairs = docs.select(F.col("doc_id").alias("id_a"), before.alias("id_b")).where("id_b is not null")
    return lifecycle.contradictions(pairs, docs.select(F.col("doc_id").alias("id"), "text"))


def archived_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes after those without an update since March 2024 were archived."""
    nodes = _nodes(spark, d)
    old = nodes.where("updated_at < timestamp'2024-03-01'").select("id")
    done = lifecycle.archived(nodes, old, "id", F.lit("2024-09-01").cast("timestamp"), "no update")
    return done.select("id", "status", F.coalesce("archived_reason", F.lit("")).alias("reason"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


def stale_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by state after those of documents that came again with another text have gone stale."""
    docs = table(spark, d, "documents").where("source_path is not null").select("doc_id", "document_id", "project_id", "source_path", "created_at", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    changed = lifecycle.ingestion_sequence(docs, ["project_id", "source_path"], "h", ["created_at", "doc_id"]).where("outcome = 'updated'")
    chunks = table(spark, d, "knowledge_chunks").select("chunk_id", "document_id", "index_status").distinct()
    return lifecycle.staled(chunks, "document_id", changed).groupBy("index_status").agg(F.count("*").alias("n_chunks"))


def next_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Each project's first listed snapshot as a manifest after the changes of the one that follows."""
    rows, listed = table(spark, d, "file_manifest"), table(spark, d, "manifest_snapshots").select("project_id", "snapshot_no").distinct()
    w = Window.partitionBy("project_id").orderBy("snapshot_no")
    first = listed.withColumn("i", F.row_number().over(w)).where("i <= 2")
    order = [F.desc_nulls_last("mtime"), F.desc_nulls_last("delivered_at"), F.desc_nulls_last("content_hash"), F.desc_nulls_last("revision"), F.col("index_status")]
    state = lifecycle.latest(rows.where("rel_path is not null"), ["project_id", "snapshot_no", "rel_path"], order).join(first, ["project_id", "snapshot_no"])
    now = state.where("i = 1").select("project_id", "rel_path", "content_hash", "index_status", "revision")
    then = state.where("i = 2 and index_status <> 'deleted'").select("project_id", "rel_path", F.col("content_hash").alias("h"), F.lit(True).alias("there"))
    two = listed.groupBy("project_id").agg(F.count("*").alias("n")).where("n >= 2").select("project_id")
    both = now.where("index_status <> 'deleted'").select("project_id", "rel_path", F.col("content_hash").alias("g"), F.lit(True).alias("here")).join(then, ["project_id", "rel_path"], "full_outer").join(two, "project_id")
    change = F.when(F.col("here").isNull(), "new").when(F.col("there").isNull(), "deleted").when(~F.col("g").eqNullSafe(F.col("h")), "changed")
    changes = both.select("project_id", "rel_path", change.alias("change"), F.col("h").alias("content_hash")).where("change is not null")
    return lifecycle.manifest_applied(now, changes, ["project_id", "rel_path"])


def vectors_to_make(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose vector is missing or of another content: the latest states against the first ones
    that were embedded."""
    rows = table(spark, d, "knowledge_chunks").where("chunk_id is not null")
    now = lifecycle.latest(rows, ["chunk_id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.col("content_hash")])
    records = now.select(F.col("chunk_id").alias("record_id"), "content_hash")
    stored = rows.where("embedding_status = 'embedded'").select(F.col("chunk_id").alias("record_id"), "content_hash", F.lit("m").alias("model")).distinct()
    return lifecycle.vector_misses(records, stored, "m")


def related_notes(spark: SparkSession, d: str) -> DataFrame:
    """Peers of each note: parent and child, and a note with what it was compacted into."""
    nodes = _nodes(spark, d)
    part = lambda to, kind: nodes.where(F.col(to).isNotNull()).select(F.col("id").alias("source_id"), F.col(to).alias("target_id"), F.lit(kind).alias("relation_type"))
    edges = lifecycle.new_edges(part("parent_id", "part_of"), part("compacted_into_id", "compacted_into"))
    return lifecycle.edge_peers(edges, nodes)


def deleted_projects(spark: SparkSession, d: str) -> DataFrame:
    """What is left of notes and evidence, per project, when archived notes are deleted with theirs."""
    nodes = _nodes(spark, d)
    evidence = table(spark, d, "evidence").select("id", "memory_node_id").distinct().withColumnRenamed("id", "evidence_id")
    gone = nodes.where(F.lower(F.trim("status")) == "archived")
    left, kept = lifecycle.cascade_deleted(nodes, evidence, "id", "memory_node_id", gone.select("id"))
    per = kept.groupBy("memory_node_id").agg(F.count("*").alias("n"))
    return left.join(per, left.id == per.memory_node_id, "left").groupBy("project_id").agg(F.count("*").alias("n_notes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_evidence"))


def refreshed_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes after a patch that takes each one's status and confidence from its latest evidence's age."""
    ev = table(spark, d, "evidence").groupBy(F.col("memory_node_id").alias("id")).agg(F.max("created_at").alias("last"))
    patch = ev.select("id", F.when(F.col("last") < F.lit("2024-03-01").cast("timestamp"), "stale").alias("status"))
    done = lifecycle.patched(_nodes(spark, d), patch, "id", ["status"], F.lit("2024-09-01").cast("timestamp"))
    return done.select("id", "status", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


NAMES = "chunk_markdown chunk_code chunk_test_report chunk_diff chunk_log propositions proposition_spans exact_dedupe latest_document ingest_outcome doc_chunk_counts retention_counts status_report node_evidence tree_paths inspect_children consolidated_titles compaction_groups dedup_matches deleted_projects refreshed_notes conflicting_revisions archived_notes stale_chunks next_manifest vectors_to_make related_notes paragraphs_code paragraphs_text module_summaries code_propositions"
QUERIES = {name: globals()[name] for name in NAMES.split()}

_NODES = "WITH RECURSIVE nodes AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, status, retrieval_count DESC) AS n FROM memory_nodes) WHERE n = 1)"
_UP = _NODES + """,
up AS (SELECT a.id, b.id AS parent FROM nodes a LEFT JOIN nodes b ON b.id = a.parent_id),
walk AS (SELECT id, [id] AS path, parent AS cur FROM up UNION ALL
  SELECT w.id, list_prepend(w.cur, w.path), u.parent FROM walk w JOIN up u ON u.id = w.cur WHERE NOT list_contains(w.path, w.cur)),
ended AS (SELECT * FROM walk WHERE cur IS NULL)
"""
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source_path ORDER BY created_at DESC, doc_id DESC) AS n FROM documents WHERE source_path IS NOT NULL) WHERE n = 1)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PACK = r"""CASE WHEN greatest(1, length({x}) // 4) <= {most} THEN [{x}] ELSE
  list_filter((SELECT list_append(r.done, regexp_replace(r.now, '^\s+|\s+$', '', 'g')) FROM (SELECT list_reduce(regexp_split_to_array({x}, '\n\n+'),
   lambda a, p: CASE WHEN a.now = '' THEN {{'now': p, 'done': a.done}}
     WHEN greatest(1, length(regexp_replace(a.now || chr(10) || chr(10) || p, '^\s+|\s+$', '', 'g')) // 4) > {most} THEN {{'now': p, 'done': list_append(a.done, regexp_replace(a.now, '^\s+|\s+$', '', 'g'))}}
     ELSE {{'now': regexp_replace(a.now || chr(10) || chr(10) || p, '^\s+|\s+$', '', 'g'), 'done': a.done}} END,
   {{'now': '', 'done': []::VARCHAR[]}}) AS r)), lambda y: y <> '') END"""
_KINDS_IN = "(" + ", ".join(f"'{k}'" for k in MARKDOWN) + ")"
_CASE_KIND = "CASE " + " ".join("WHEN regexp_matches(s, '{}') THEN '{}'".format(rule.replace("'", "''"), name) for name, _, rule in chunking.STATEMENT_KINDS) + " ELSE 'implementation_detail' END"
_CASE_DELTA = "CASE " + " ".join("WHEN regexp_matches(s, '{}') THEN {}".format(rule.replace("'", "''"), delta) for _, delta, rule in chunking.STATEMENT_KINDS) + " ELSE 0 END"
_LINK_CODE = r"list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(regexp_replace(text, '(^|\n)({})', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda y: y <> '')"

_SEQUENCE = """(SELECT doc_id, document_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN lag(coalesce(text, '')) OVER w = coalesce(text, '') THEN 'duplicate' ELSE 'updated' END AS outcome
  FROM documents WHERE source_path IS NOT NULL WINDOW w AS (PARTITION BY project_id, source_path ORDER BY created_at, doc_id))"""
_DUPLICATES = r""", w AS (SELECT id, project_id, kind, list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{M}\p{N}_]+'), lambda x: len(x) > 2)) AS t,
  list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || left(summary, 200)), '[\p{L}\p{M}\p{N}_]+'), lambda x: len(x) > 2)) AS e,
  list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(coalesce(module_path, ''), '[._/]', ' ', 'g')), '[\p{L}\p{M}\p{N}_]+'), lambda x: len(x) > 2)) AS m, coalesce(module_path, '') AS scope FROM nodes),
tw AS (SELECT id, unnest(t) AS x FROM w), ew AS (SELECT id, unnest(e) AS x FROM w), mw AS (SELECT id, unnest(m) AS x FROM w),
ti AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM tw a JOIN tw b USING (x) WHERE a.id <> b.id GROUP BY ALL),
ei AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM ew a JOIN ew b USING (x) WHERE a.id <> b.id GROUP BY ALL),
mi AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM mw a JOIN mw b USING (x) WHERE a.id <> b.id GROUP BY ALL),
s AS (SELECT ei.id_a, ei.id_b, round(0.6 * greatest(coalesce(ti.c / (len(a.t) + len(b.t) - ti.c), 0), 0.8 * ei.c / (len(a.e) + len(b.e) - ei.c)) + 0.2 * coalesce((a.kind = b.kind)::INTEGER, 0) + 0.2 * coalesce(mi.c / len(a.m), 0), 4)::DOUBLE AS score
  FROM ei JOIN w a ON a.id = ei.id_a JOIN w b ON b.id = ei.id_b LEFT JOIN ti ON ti.id_a = ei.id_a AND ti.id_b = ei.id_b LEFT JOIN mi ON mi.id_a = ei.id_a AND mi.id_b = ei.id_b WHERE a.scope = b.scope),
dup AS (SELECT id_a, id_b, score, CASE WHEN score >= 0.8 THEN 'near' ELSE 'partial' END AS band, row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) = 1 AS best FROM s WHERE score >= 0.5)
"""
_SIDES = [
    (["must", "always", "required", "mandatory", "never"], ["optional", "may", "can", "allowed", "sometimes"]),
    (["synchronous", "blocking", "sequential"], ["asynchronous", "async", "concurrent", "parallel"]),
    (["immutable", "readonly", "constant"], ["mutable", "writable", "modifiable"]),
    (["deprecated", "removed", "deleted"], ["active", "current", "supported"]),
    (["atomic", "transaction", "rollback"], ["eventual", "best-effort", "idempotent"]),
]
_OPPOSED = " OR ".join(f"(list_has_any(x.l, {a}) AND list_has_any(y.l, {b})) OR (list_has_any(y.l, {a}) AND list_has_any(x.l, {b}))" for a, b in _SIDES)

_RULES = {name: rule.replace("'", "''") for name, _, rule in chunking.STATEMENT_KINDS}
_FIRST = r"trim(regexp_replace({x}, '^(.*?[.!?])\s+[A-Z].*$', '\1'))"
_UNIQUE = "list_reduce({x}, lambda a, y: CASE WHEN list_contains(list_transform(a, lambda z: lower(z)), lower(y)) THEN a ELSE list_append(a, y) END, []::VARCHAR[])"
_DOC = "regexp_extract({x}, '(?s)" + '"""(.*?)"""|' + "''" * 3 + "(.*?)" + "''" * 3 + "', {n})"
_SUMMARY = rf"""left(CASE WHEN length(regexp_replace(string_split(regexp_replace(coalesce(nullif({_DOC.format(x='c', n=1)}, ''), {_DOC.format(x='c', n=2)}), '^\s+|\s+$', '', 'g'), chr(10))[1], '^\s+|\s+$', '', 'g')) > 10
  THEN regexp_replace(string_split(regexp_replace(coalesce(nullif({_DOC.format(x='c', n=1)}, ''), {_DOC.format(x='c', n=2)}), '^\s+|\s+$', '', 'g'), chr(10))[1], '^\s+|\s+$', '', 'g')
  ELSE list_filter([CASE WHEN regexp_matches(x, '^(def |async def |class )') THEN CASE WHEN length(rtrim(x, ':')) > 5 THEN rtrim(x, ':') END WHEN length(x) > 10 THEN x END
    FOR x IN list_filter([regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN string_split(c, chr(10))], lambda z: z <> '' AND NOT regexp_matches(z, '^(@|#!|import |from |#)'))], lambda v: v IS NOT NULL)[1] END, 200)"""
_CODE_PARAGRAPHS = (
    r"WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(source_path, '^.*[/\\]', ''), '\.(py|md|ts)$', '') AS name, "
    + _LINK_CODE.format("def |class |async def ")
    + r""" AS l FROM documents WHERE source_type IN ('code_file', 'code_comment') AND text IS NOT NULL),
blocks AS (SELECT doc_id, name, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM b),
cut AS (SELECT doc_id, name, i, list_filter([regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN CASE WHEN greatest(1, length(x) // 4) > 1000 THEN regexp_split_to_array(x, '

+') ELSE [x] END], lambda z: z <> '') AS p FROM blocks),
pieces AS (SELECT doc_id, name, i, unnest(p) AS c, generate_subscripts(p, 1) AS j FROM cut),
para AS (SELECT doc_id, name, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INTEGER AS paragraph_index, c, nullif(regexp_extract(c, '^(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)', 1), '') AS heading,
  regexp_extract_all(c, '(?m)^(?:def |async def |class )\s*([A-Za-z_]\w*)', 1) AS symbols, """
    + _SUMMARY
    + " AS summary FROM pieces) "
)

ORACLE = {
    "chunk_markdown": rf"""WITH b AS (SELECT doc_id, text, string_split(regexp_replace(text, '(^|\n)(#{{1,6}}\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l0 FROM documents WHERE source_type IN {_KINDS_IN} AND text IS NOT NULL),
h AS (SELECT doc_id, text, list_filter(l0, lambda x: regexp_matches(x, '^#{{1,6}}\s')) AS l FROM b),
k AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [text] ELSE l END AS l FROM h),
r AS (SELECT doc_id, (list_reduce(l, lambda a, x: CASE WHEN regexp_matches(x, '^#{{1,6}}\s')
    THEN {{'stack': list_append(list_slice(a.stack, 1, length(regexp_extract(x, '^(#{{1,6}})', 1)) - 1), regexp_replace(regexp_extract(x, '^#{{1,6}}\s+([^\n]*)', 1), '^\s+|\s+$', '', 'g')),
      'out': list_append(a.out, {{'p': array_to_string(list_append(list_slice(a.stack, 1, length(regexp_extract(x, '^(#{{1,6}})', 1)) - 1), regexp_replace(regexp_extract(x, '^#{{1,6}}\s+([^\n]*)', 1), '^\s+|\s+$', '', 'g')), ' > '), 'c': regexp_replace(x, '^\s+|\s+$', '', 'g')}})}}
    ELSE {{'stack': []::VARCHAR[], 'out': list_append(a.out, {{'p': '', 'c': regexp_replace(x, '^\s+|\s+$', '', 'g')}})}} END,
  {{'stack': []::VARCHAR[], 'out': []::STRUCT(p VARCHAR, c VARCHAR)[]}})).out AS o FROM k),
e AS (SELECT doc_id, i, o.p AS path, o.c AS x FROM (SELECT doc_id, unnest(o) AS o, generate_subscripts(o, 1) AS i FROM r)),
q AS (SELECT doc_id, i, path, {_PACK.format(x="x", most=1200)} AS parts FROM e)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INTEGER AS chunk_index, path AS heading_path, md5(c) AS content_md5
FROM (SELECT doc_id, i, path, unnest(parts) AS c, generate_subscripts(parts, 1) AS j FROM q) WHERE c <> ''""",
    "chunk_diff": r"""WITH f AS (SELECT doc_id, unnest(l) AS f, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '(?m)^diff --git '), lambda x: trim(x, chr(10) || chr(13) || chr(9) || ' ') <> '') AS l FROM documents WHERE source_type = 'git_diff' AND text IS NOT NULL)),
h AS (SELECT doc_id, i, regexp_replace(replace(regexp_extract(f, 'b/(\S+)', 1), '/', '.'), '\.py$', '') AS m, list_filter(regexp_split_to_array(f, '(?m)^@@ '), lambda x: trim(x, chr(10) || chr(13) || chr(9) || ' ') <> '') AS l FROM f),
e AS (SELECT doc_id, i, m, unnest(l) AS h, generate_subscripts(l, 1) AS j FROM h)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INTEGER AS chunk_index, m AS module_path, md5(regexp_replace('@@ ' || h, '^\s+|\s+$', '', 'g')) AS content_md5 FROM e""",
    "tree_paths": _UP + """, claimed AS (SELECT id, depth FROM nodes)
SELECT e.id, path[1] AS root_key, (len(path) - 1)::INTEGER AS depth, (SELECT count(*) FROM ended x WHERE list_contains(x.path, e.id)) - 1 AS n_descendants, c.depth AS claimed FROM ended e JOIN claimed c USING (id)""",
    "chunk_code": "WITH b AS (SELECT doc_id, " + _LINK_CODE.format("def |class |async def ") + " AS l FROM documents WHERE source_type IN ('code_file', 'code_comment') AND text IS NOT NULL), "
    "p AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM b)), q AS (SELECT doc_id, i, " + _PACK.format(x="x", most=1000) + " AS parts FROM p), "
    "f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index, c FROM (SELECT doc_id, i, unnest(parts) AS c, generate_subscripts(parts, 1) AS j FROM q)) "
    r"SELECT doc_id, chunk_index::INTEGER AS chunk_index, array_to_string(regexp_extract_all(c, '(?m)^(?:def |async def |class )\s*([A-Za-z_]\w*)', 1), ' ') AS symbols, md5(c) AS content_md5 FROM f",
    "chunk_test_report": "WITH b AS (SELECT doc_id, " + _LINK_CODE.format("PASSED|FAILED|ERROR|test_[A-Za-z0-9_]+|={5,}|-{5,}|FAILURES") + " AS l FROM documents WHERE source_type = 'test_report' AND text IS NOT NULL) "
    "SELECT doc_id, (i - 1)::INTEGER AS chunk_index, array_to_string(regexp_extract_all(x, 'test_[A-Za-z0-9_]+'), ' ') AS symbols, md5(x) AS content_md5 FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM b)",
    "chunk_log": r"""WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS l FROM documents WHERE source_type = 'runtime_log' AND text IS NOT NULL)),
near AS (SELECT *, max(regexp_matches(line, '(?i)ERROR|WARN|CRITICAL|EXCEPTION|Traceback')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM lines),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM near WHERE near = 1),
win AS (SELECT doc_id, (min(i) + 1)::INTEGER AS start_line, (max(i) + 1)::INTEGER AS end_line, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS x FROM isl GROUP BY doc_id, island),
parts AS (SELECT doc_id, start_line, end_line, """ + _PACK.format(x="x", most=600) + r""" AS p FROM win
  UNION ALL SELECT doc_id, 0, 0, [regexp_replace(text, '^\s+|\s+$', '', 'g')] FROM documents WHERE source_type = 'runtime_log' AND text IS NOT NULL AND NOT regexp_matches(text, '(?i)ERROR|WARN|CRITICAL|EXCEPTION|Traceback'))
SELECT doc_id, start_line, end_line, (j - 1)::INTEGER AS part_no, md5(c) AS content_md5 FROM (SELECT doc_id, start_line, end_line, unnest(list_filter(p, lambda y: y <> '')) AS c, generate_subscripts(list_filter(p, lambda y: y <> ''), 1) AS j FROM parts)""",
    "propositions": rf"""WITH docs AS (SELECT doc_id, text FROM documents WHERE source_type IN {_KINDS_IN} AND text IS NOT NULL),
items AS (
  SELECT doc_id, 0.72 AS base, unnest(regexp_extract_all(text, '(?m)^[ \t]*[-*•][ \t]+([^\n]+)', 1)) AS r FROM docs
  UNION ALL SELECT doc_id, 0.70, unnest(regexp_extract_all(text, '(?m)^[ \t]*\d+[.)][ \t]+([^\n]+)', 1)) FROM docs
  UNION ALL SELECT doc_id, 0.68, r FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS r FROM docs) WHERE NOT regexp_matches(r, '^([#*•-]|$)') AND (regexp_matches(r, '{_RULES["constraint"]}') OR regexp_matches(r, '{_RULES["security_rule"]}'))),
u AS (SELECT doc_id, base, {_STRIP.format('r')} AS r FROM items),
t AS (SELECT doc_id, base, {_FIRST.format(x='r')} AS s FROM u WHERE base = 0.68 OR (length(r) BETWEEN 12 AND 350 AND NOT regexp_matches(r, '^(?:import|from)\s+\w') AND NOT regexp_matches(r, '^[\s\d.,;:!?()-]+$'))),
k AS (SELECT doc_id, {_CASE_KIND} AS kind, s, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) AS normalized, round(least((base + {_CASE_DELTA})::DOUBLE, 0.95), 2)::DOUBLE AS confidence FROM t
  WHERE length(s) BETWEEN 12 AND 350 AND NOT regexp_matches(s, '^(?:import|from)\s+\w') AND NOT regexp_matches(s, '^[\s\d.,;:!?()-]+$'))
SELECT doc_id, kind, normalized, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, normalized ORDER BY confidence DESC, s DESC, kind DESC) AS n FROM k) WHERE n = 1""",
    "paragraphs_code": _CODE_PARAGRAPHS + "SELECT doc_id, paragraph_index, coalesce(heading, '') AS heading, array_to_string(symbols, ' ') AS symbols, coalesce(summary, '') AS summary, md5(c) AS content_md5 FROM para",
    "module_summaries": _CODE_PARAGRAPHS
    + rf""", g AS (SELECT doc_id, name, list(summary ORDER BY paragraph_index)[1] AS first, {_UNIQUE.format(x="flatten(list(symbols ORDER BY paragraph_index))")} AS ks,
  list_slice({_UNIQUE.format(x="list_filter(list(heading ORDER BY paragraph_index), lambda h: h IS NOT NULL)")}, 1, 4) AS h FROM para GROUP BY doc_id, name)
SELECT doc_id, left(CASE WHEN first IS NOT NULL THEN first WHEN len(h) > 0 THEN 'Module covering: ' || array_to_string(h, ', ') WHEN len(ks) > 0 THEN 'Defines: ' || array_to_string(list_slice(ks, 1, 5), ', ') WHEN coalesce(name, '') <> '' THEN 'Source file: ' || name ELSE 'Module summary.' END
  || CASE WHEN len(ks) > 0 THEN ' Key components: ' || array_to_string(list_slice(ks, 1, 6), ', ') || '.' ELSE '' END, 800) AS summary, array_to_string(list_slice(ks, 1, 15), ' ') AS key_symbols FROM g""",
    "proposition_spans": "SELECT document_id, proposition_type, count(*) AS n_statements, min(source_start_line) AS first_line, max(coalesce(source_end_line, source_start_line)) AS last_line FROM (SELECT DISTINCT * FROM raw_propositions) GROUP BY ALL",
    "exact_dedupe": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "latest_document": f"SELECT project_id, source_path, doc_id FROM {_LATEST}",
    "ingest_outcome": f"SELECT doc_id, outcome FROM {_SEQUENCE}",
    "doc_chunk_counts": "SELECT document_id, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT CASE WHEN index_status = 'indexed' THEN chunk_id END) AS n_indexed FROM knowledge_chunks GROUP BY ALL",
    "retention_counts": _NODES + " SELECT project_id, count(*) AS n_nodes, " + ", ".join(f"count(*) FILTER (lower(trim(status)) = '{s}') AS n_{s}" for s in ("active", "stale", "superseded", "archived", "needs_review")) + " FROM nodes GROUP BY ALL",
    "status_report": _NODES
    + """ SELECT p.id AS project_id, p.name, coalesce(n.c, 0) AS n_notes, coalesce(d.c, 0) AS n_documents, coalesce(k.c, 0) AS n_indexed FROM (SELECT DISTINCT id, name FROM projects) p
LEFT JOIN (SELECT project_id, count(*) AS c FROM nodes GROUP BY ALL) n ON n.project_id = p.id LEFT JOIN (SELECT project_id, count(DISTINCT document_id) AS c FROM documents GROUP BY ALL) d ON d.project_id = p.id
LEFT JOIN (SELECT project_id, count(DISTINCT CASE WHEN index_status = 'indexed' THEN chunk_id END) AS c FROM knowledge_chunks GROUP BY ALL) k ON k.project_id = p.id""",
    "node_evidence": "SELECT n.id, coalesce(string_agg(e.id, ' ' ORDER BY e.created_at, e.id), '') AS evidence, count(e.id) AS n_evidence FROM (SELECT DISTINCT id FROM memory_nodes) n LEFT JOIN (SELECT memory_node_id, id, min(created_at) AS created_at FROM evidence GROUP BY ALL) e ON e.memory_node_id = n.id GROUP BY n.id",
    "inspect_children": _UP + " SELECT path[1] AS ancestor, id AS descendant, (len(path) - 1)::INTEGER AS distance FROM ended JOIN (SELECT id AS top FROM nodes WHERE parent_id IS NULL) ON top = path[1] WHERE len(path) BETWEEN 2 AND 3",
    "consolidated_titles": _NODES + " SELECT parent_id, string_agg(title, '; ' ORDER BY created_at, id) AS titles, count(*) AS n_children FROM nodes WHERE parent_id IS NOT NULL AND lower(trim(status)) = 'active' GROUP BY ALL",
    "compaction_groups": _NODES
    + """ SELECT project_id, parent_id, kind, n_nodes, confidence, importance, left(titles || CASE WHEN n_nodes > 5 THEN ' (+' || (n_nodes - 5) || ' more)' ELSE '' END, 256) AS title FROM (
SELECT project_id, parent_id, kind, count(*) AS n_nodes, round(avg(confidence), 4) AS confidence, round(avg(importance), 4) AS importance, string_agg(title, '; ' ORDER BY created_at, id) FILTER (rn <= 5) AS titles
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, parent_id, kind ORDER BY created_at, id) AS rn FROM nodes WHERE lower(trim(status)) = 'active') GROUP BY ALL) WHERE n_nodes >= 3""",
    "deleted_projects": _NODES
    + " SELECT project_id, count(*) AS n_notes, coalesce(sum(n), 0)::BIGINT AS n_evidence FROM nodes LEFT JOIN (SELECT memory_node_id, count(*) AS n FROM (SELECT DISTINCT id, memory_node_id FROM evidence) GROUP BY ALL) e ON e.memory_node_id = id WHERE lower(trim(status)) <> 'archived' GROUP BY ALL",
    "refreshed_notes": _NODES + " SELECT id, CASE WHEN e.last < TIMESTAMP '2024-03-01' THEN 'stale' ELSE status END AS status, CASE WHEN e.memory_node_id IS NOT NULL THEN '2024-09-01' ELSE strftime(updated_at, '%Y-%m-%d') END AS updated_on FROM nodes LEFT JOIN (SELECT memory_node_id, max(created_at) AS last FROM evidence GROUP BY ALL) e ON e.memory_node_id = id",
    "dedup_matches": _NODES + _DUPLICATES + "SELECT * FROM dup",
    "conflicting_revisions": """WITH r AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY project_id, source_path ORDER BY created_at, doc_id) AS b, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS l FROM documents WHERE source_path IS NOT NULL AND text IS NOT NULL)
SELECT x.doc_id AS id_a, y.doc_id AS id_b FROM r x JOIN r y ON y.doc_id = x.b WHERE """
    + _OPPOSED,
    "archived_notes": _NODES
    + """ SELECT id, CASE WHEN hit THEN 'archived' ELSE status END AS status, CASE WHEN hit THEN 'no update' ELSE coalesce(archived_reason, '') END AS reason, CASE WHEN hit THEN '2024-09-01' ELSE strftime(updated_at, '%Y-%m-%d') END AS updated_on
FROM (SELECT *, updated_at < TIMESTAMP '2024-03-01' AND lower(trim(status)) <> 'archived' AS hit FROM nodes)""",
    "stale_chunks": f"SELECT index_status, count(*) AS n_chunks FROM (SELECT chunk_id, CASE WHEN document_id IN (SELECT document_id FROM {_SEQUENCE} WHERE outcome = 'updated') THEN 'stale' ELSE index_status END AS index_status FROM (SELECT DISTINCT chunk_id, document_id, index_status FROM knowledge_chunks)) GROUP BY ALL",
    "next_manifest": """WITH listed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY snapshot_no) AS i, count(*) OVER (PARTITION BY project_id) AS n FROM (SELECT DISTINCT project_id, snapshot_no FROM manifest_snapshots)),
state AS (SELECT s.*, i, n FROM (SELECT *, row_number() OVER (PARTITION BY project_id, snapshot_no, rel_path ORDER BY mtime DESC NULLS LAST, delivered_at DESC NULLS LAST, content_hash DESC NULLS LAST, revision DESC NULLS LAST, index_status) AS r FROM file_manifest WHERE rel_path IS NOT NULL) s JOIN listed USING (project_id, snapshot_no) WHERE r = 1 AND i <= 2),
a AS (SELECT * FROM state WHERE i = 1), b AS (SELECT * FROM state WHERE i = 2 AND index_status <> 'deleted')
SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.rel_path, b.rel_path) AS rel_path,
  CASE WHEN b.rel_path IS NOT NULL AND (a.rel_path IS NULL OR a.index_status = 'deleted' OR a.content_hash IS DISTINCT FROM b.content_hash) THEN b.content_hash ELSE a.content_hash END AS content_hash,
  CASE WHEN b.rel_path IS NOT NULL AND (a.rel_path IS NULL OR a.index_status = 'deleted' OR a.content_hash IS DISTINCT FROM b.content_hash) THEN 'indexed' WHEN b.rel_path IS NULL AND a.n >= 2 AND a.index_status <> 'deleted' THEN 'deleted' ELSE a.index_status END AS index_status,
  (coalesce(a.revision, 0) + CASE WHEN b.rel_path IS NOT NULL AND (a.rel_path IS NULL OR a.index_status = 'deleted' OR a.content_hash IS DISTINCT FROM b.content_hash) THEN 1 ELSE 0 END)::INTEGER AS revision
FROM a FULL JOIN b ON a.project_id = b.project_id AND a.rel_path = b.rel_path""",
    "vectors_to_make": """SELECT record_id, content_hash FROM (SELECT chunk_id AS record_id, content_hash, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, content_hash) AS n FROM knowledge_chunks WHERE chunk_id IS NOT NULL) r
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM knowledge_chunks k WHERE k.embedding_status = 'embedded' AND k.chunk_id = r.record_id AND k.content_hash = r.content_hash)""",
    "related_notes": _NODES
    + """, e AS (SELECT id AS s, parent_id AS t, 'part_of' AS relation_type FROM nodes WHERE parent_id IS NOT NULL AND parent_id <> id UNION SELECT id, compacted_into_id, 'compacted_into' FROM nodes WHERE compacted_into_id IS NOT NULL AND compacted_into_id <> id),
p AS (SELECT s AS id, t AS peer, relation_type FROM e UNION SELECT t, s, relation_type FROM e)
SELECT p.id, p.peer, p.relation_type, lower(trim(n.status)) IN ('stale', 'superseded') AS conflict FROM p JOIN nodes n ON n.id = p.peer WHERE p.id IN (SELECT id FROM nodes)""",
}

_PARTS = "evidence_texts AS (SELECT DISTINCT id, content AS c0, 0 AS n0 FROM evidence)"
_NESTED = "evidence_texts"
for _i, _rule in enumerate(REDACTIONS):
    _sql = _rule.replace("'", "''")
    _NESTED = f"(SELECT id, regexp_replace(c{_i}, '{_sql}', '[REDACTED]', 'g') AS c{_i + 1}, n{_i} + len(regexp_extract_all(c{_i}, '{_sql}')) AS n{_i + 1} FROM {_NESTED})"
REDACT_SQL = f"WITH {_PARTS} SELECT id, c{len(REDACTIONS)} AS content, n{len(REDACTIONS)}::INTEGER AS n_redactions FROM {_NESTED} WHERE n{len(REDACTIONS)} > 0"
ORACLE["redact_docs"] = REDACT_SQL
