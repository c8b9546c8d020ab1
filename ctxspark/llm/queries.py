"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.llm.credentials import credentials, redacted
from ctxspark.llm.mixing import Mix, mix_sources
from ctxspark.llm.neardup import NearDuplicates, near_duplicates, similar_pairs
from ctxspark.llm.packing import fill_containers
from ctxspark.llm.splitting import split_oversized
from ctxspark.llm.stuffing import stuffing
from ctxspark.llm.tokens import token_count
from ctxspark.operators.hierarchy import components
from ctxspark.runtime import cut_lineage, table


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    part = lambda name, key, text: table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).alias("id"), F.col(text).alias("text"))
    records = part("memory_nodes", "id", "summary").union(part("knowledge_chunks", "chunk_id", "content"))
    # without repeats, weights lie between 1 and 2: a plain similarity of 0.6 is a weighted one of at least
    # 0.6 / (0.6 + 2 * 0.4) = 0.43, so that the exact check that follows finds no pair cut off
    return near_duplicates(records, "source", "id", "text", shingle_words=3, similarity=0.4, plain_similarity=0.6, min_words=12, repeats=False)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(_near(spark, sf_dir)).withColumnRenamed("source", "source_table")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups: one row per id, with its class (same text), group and number of links."""
    found = _near(spark, sf_dir)
    links = cut_lineage(found.links.select("a", "b"))
    degree = links.select(F.col("a").alias("c")).union(links.select("b")).groupBy("c").agg(F.count("*").alias("n_links"))
    placed = found.members.join(components(links).select(F.col("node").alias("c"), "component"), "c", "left").join(degree, "c", "left")
    placed = placed.select("source", "id", "class_id", F.coalesce("component", "c").alias("g"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = placed.groupBy("g").agg(F.min("class_id").alias("group_id"))
    return placed.join(names, "g").select(F.col("source").alias("source_table"), "id", "class_id", "group_id", "n_links")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = table(spark, sf_dir, "size_limits").where("profile = 'section'").first()
    # later states of a chunk have the same content: oversized rows alone are compared
    chunks = table(spark, sf_dir, "knowledge_chunks").select("chunk_id", "content", "heading_path")
    large = chunks.where(F.floor(F.length("content") / 4) > limit.max_tokens).groupBy("chunk_id", "content").agg(F.min("heading_path").alias("heading_path"))
    return split_oversized(large, "content", "heading_path", limit.max_tokens, limit.overlap_tokens)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("chunk_id", F.explode("boundaries").alias("boundary_offset")).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered pieces themselves."""
    piece = _split(spark, sf_dir).select("chunk_id", "content", F.explode("pieces").alias("p"))
    text = F.expr("substring(content, p.start_offset + 1, p.end_offset - p.start_offset)")
    return piece.select("chunk_id", "p.piece_no", "p.start_offset", "p.end_offset", "p.token_count", "p.cut", F.array_join("p.heading_path", " > ").alias("heading_path"), text.alias("content"))


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col(key).alias("record_id"), "content")
    return credentials(part("knowledge_chunks", "chunk_id").union(part("evidence", "id")), "content").where("size(spans) > 0")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _credentials(spark, sf_dir).select("source_table", "record_id", F.explode("spans").alias("x"))
    return found.select("source_table", "record_id", "x.start_pos", "x.n_chars").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold credentials, with those values replaced."""
    found = _credentials(spark, sf_dir)
    return found.select("source_table", "record_id", F.size("spans").alias("n_spans"), redacted(F.col("content"), F.col("spans")).alias("redacted")).distinct()


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of each capacity."""
    limits = table(spark, sf_dir, "size_limits").where("profile like 'container%'").select("profile", "max_tokens")
    capacities = {r.max_tokens: r.profile for r in limits.collect()}  # a fixed table of a few rows
    packed = fill_containers(_sized(spark, sf_dir), "doc_id", "n_tokens", list(capacities))
    profile = F.lit(None).cast("string")
    for size, name in capacities.items():
        profile = F.when(F.col("capacity") == size, name).otherwise(profile)
    return packed.select(
        profile.alias("profile"), "capacity", "container_no", "step_no", F.col("item").cast("long").alias("doc_id"), "part_no", "from_token", "n_tokens", "filled", "tier", "in_gap"
    )


def p6_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers and share of their space that is used, per profile."""
    packed = p6_containers(spark, sf_dir)
    return packed.groupBy("profile", "capacity").agg(
        F.countDistinct("container_no").alias("n_containers"),
        F.sum("n_tokens").alias("n_tokens"),
        F.round(F.sum("n_tokens") / F.countDistinct("container_no") / F.col("capacity"), 4).alias("filling"),
    )


def p6_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and tokens of each tier of each profile, and how many of them fill gaps of longer windows."""
    gap = lambda x: F.sum(F.when(F.col("in_gap"), x).otherwise(0))
    packed = p6_containers(spark, sf_dir)
    return packed.groupBy("profile", "capacity", "tier").agg(
        F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), gap(F.lit(1)).alias("items_in_gaps"), gap(F.col("n_tokens")).alias("tokens_in_gaps")
    )


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture, slot by slot: which tokens of which document, and in which repeat."""
    return _mix(spark, sf_dir).slots.withColumnRenamed("item", "doc_id")


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents: how often each is used at most, and with how many tokens in all."""
    slots = p7_mix(spark, sf_dir)
    return slots.groupBy("source", "doc_id").agg(F.max("repeat_no").alias("n_repeats"), F.sum("n_tokens").alias("used_tokens"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return _mix(spark, sf_dir).shares


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of links and of incoherent words in each document, and their share."""
    return stuffing(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).where("stuffed").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p6_containers": p6_containers,
    "p6_filling": p6_filling,
    "p6_tiers": p6_tiers,
    "p7_mix": p7_mix,
    "p7_documents": p7_documents,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
}

ORACLE = {
    "p1_found": r"""
WITH recs AS (SELECT DISTINCT 'memory_nodes' AS source_table, id, lower(summary) AS t FROM memory_nodes WHERE id IS NOT NULL AND summary IS NOT NULL
  UNION SELECT DISTINCT 'knowledge_chunks', chunk_id, lower(content) FROM knowledge_chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL),
words AS (SELECT source_table, t, row_number() OVER () AS tid, l FROM (SELECT DISTINCT source_table, t, regexp_extract_all(t, '[a-z0-9_]+') AS l FROM recs) WHERE len(l) >= 12),
members AS (SELECT source_table, id, tid FROM recs JOIN words USING (source_table, t)),
sh AS (SELECT DISTINCT source_table, tid, s FROM (SELECT source_table, tid, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS s FROM words)),
n AS (SELECT tid, count(*) AS n FROM sh GROUP BY tid),
shared AS (SELECT a.tid AS x, b.tid AS y, count(*) AS c FROM sh a JOIN sh b USING (source_table, s) WHERE a.tid < b.tid GROUP BY ALL),
near AS (SELECT x, y FROM shared JOIN n nx ON nx.tid = x JOIN n ny ON ny.tid = y WHERE c / (nx.n + ny.n - c) >= 0.6 UNION ALL SELECT tid, tid FROM n)
SELECT DISTINCT a.source_table, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM near JOIN members a ON a.tid = x JOIN members b ON b.tid = y WHERE a.id <> b.id""",
    "p3_found": r"""
WITH RECURSIVE big AS (SELECT DISTINCT chunk_id, content FROM knowledge_chunks WHERE length(content) // 4 > 1200),
parts AS (SELECT chunk_id, row_number() OVER () AS doc, string_split(content, chr(10)) AS l FROM big),
raw AS (SELECT chunk_id, doc, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM parts),
lines AS (
  SELECT chunk_id, doc, i, sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY i) - length(line) - 1 AS off, regexp_replace(line, '\r$', '') AS line FROM raw),
kinds AS (
  SELECT chunk_id, doc, i, off, trim(line, ' ' || chr(9)) AS bare,
    regexp_extract(line, '^ {0,3}(```|~~~)', 1) AS opens, regexp_matches(line, '^#{1,6} ') AS head FROM lines),
walk AS (
  SELECT chunk_id, doc, i, off, true AS starts, opens AS fence, opens = '' AND bare = '' AS gap FROM kinds WHERE i = 1
  UNION ALL
  SELECT k.chunk_id, k.doc, k.i, k.off,
    w.fence = '' AND k.bare <> '' AND (w.gap OR k.opens <> '' OR k.head),
    CASE WHEN w.fence <> '' THEN CASE WHEN k.bare = w.fence THEN '' ELSE w.fence END ELSE k.opens END,
    CASE WHEN w.fence <> '' THEN k.bare = w.fence ELSE k.opens = '' AND k.bare = '' END
  FROM walk w JOIN kinds k ON k.doc = w.doc AND k.i = w.i + 1)
SELECT DISTINCT chunk_id, off::INTEGER AS boundary_offset FROM walk WHERE starts""",
}
