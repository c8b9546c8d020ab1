"""Queries of search, fusion and selection, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.functions.text import (
    first_sentence,
    hashed_terms,
    keywords,
    lexical_terms,
    module_prefixes,
    normalized,
    path_quality,
    preview,
    redact,
    request_terms,
    result_title,
    snippet,
    source_quality,
    symbols,
    token_estimate,
    visible_rows,
    word_set,
)
from ctxspark.operators import search
from ctxspark.operators.lifecycle import latest
from ctxspark.runtime import table


def tok_word_set(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of each note's title."""
    return table(spark, d, "memory_nodes").select("id", F.array_join(word_set(F.col("title")), " ").alias("words")).distinct()


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_estimate(F.coalesce("text", F.lit(""))).alias("n_tokens"))


def normalize_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalized(F.col("title")).alias("query"))


def path_modules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source_path is not null")
    return docs.select("doc_id", F.array_join(module_prefixes(F.col("source_path")), " ").alias("modules"))


def request_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Names and keywords in the notes' summaries."""
    nodes = table(spark, d, "memory_nodes").select("id", "summary").distinct()
    return nodes.select("id", F.array_join(symbols(F.col("summary")), " ").alias("symbols"), F.array_join(keywords(F.col("summary")), " ").alias("keywords"))


def redact_docs(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts after the nine redactions in order, with the number of replacements."""
    text, count = redact(F.col("content"))
    found = table(spark, d, "evidence").select("id", "content").distinct().select("id", text.alias("content"), count.alias("n_redactions"))
    return found.where("n_redactions > 0")


def _chunk_states(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each chunk."""
    rows = table(spark, d, "knowledge_chunks").where("chunk_id is not null and content is not null")
    return latest(rows, ["chunk_id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.col("index_status").asc_nulls_last(), F.col("embedding_status").asc_nulls_last()])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The indexed chunks."""
    return _chunk_states(spark, d).where("index_status = 'indexed'")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """The query set: titles of the documents whose id is divisible by 20, in their own project, with
    the document's path as the open file and the names in its text."""
    docs = table(spark, d, "documents").where("doc_id % 20 = 0")
    return docs.select(
        F.col("doc_id").alias("request"), F.col("project_id").alias("scope"), F.col("title").alias("text"),
        F.array_compact(F.array("source_path")).alias("files"), symbols(F.coalesce("text", F.lit(""))).alias("symbols"),
    )


def _lexical(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return search.bm25(search.postings(_chunks(spark, d), "project_id", "chunk_id", "content", lexical_terms), _requests(spark, d), k)


def _bow(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return search.cosine_terms(search.postings(_chunk_states(spark, d).where("index_status <> 'stale'"), "project_id", "chunk_id", "content"), _requests(spark, d), k)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of each request by BM25."""
    return _lexical(spark, d)


def bow_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of each request by the cosine of term counts."""
    return _bow(spark, d)


def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each vector whose id is divisible by 20."""
    vectors = table(spark, d, "embeddings")
    return search.nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding")


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of the lexical and the term-vector hits."""
    return search.reciprocal_ranks(_lexical(spark, d), _bow(spark, d))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and vector hits merged per request and weighted with five more signals, ten rows a request."""
    return search.hybrid(_lexical(spark, d, 30), _bow(spark, d, 30), _chunk_states(spark, d), _requests(spark, d))


def hybrid_results(spark: SparkSession, d: str) -> DataFrame:
    """What a request gets: the hits under a budget of 1,200 tokens with title and preview."""
    docs = latest(table(spark, d, "documents"), ["document_id"], [F.desc("created_at"), F.desc("doc_id")]).select("document_id", F.col("title").alias("doc_title"))
    states = _chunk_states(spark, d).select(F.col("chunk_id").alias("id"), "document_id", "content", "heading_path")
    full = hybrid_search(spark, d).join(states, "id").join(docs, "document_id", "left").withColumn("n_tokens", token_estimate(F.col("content")))
    taken = search.within_budget(full, "request", [F.col("rank")], "n_tokens", F.lit(1200), "prefix").where("action = 'included'")
    return taken.select("request", "rank", "id", result_title(F.col("doc_title"), F.col("heading_path")).alias("title"), preview(F.col("content")).alias("preview"), "n_tokens")


def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Term vectors of the chunks that a request on branch `main` may see: not stale or outdated, code
    and notes only, of its branch or of all branches."""
    visible = _chunk_states(spark, d).where(visible_rows("index_status", "source_type", "branch_name", "branch_scope", ["code_file", "manual_note", "readme"], "main"))
    return search.cosine_terms(search.postings(visible, "project_id", "chunk_id", "content"), _requests(spark, d))


def lexical_terms_of(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each document's title as the lexical index has them, and as a request asks for them."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(lexical_terms(F.col("title")), " ").alias("indexed"), F.array_join(request_terms(F.col("title")), " ").alias("asked"))


def sources_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each document's source by its path and by its declared type."""
    return table(spark, d, "documents").select("doc_id", path_quality(F.col("source_path")).alias("by_path"), source_quality(F.col("source_type")).alias("by_type"))


def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of each note's summary."""
    return table(spark, d, "memory_nodes").select("id", first_sentence(F.col("summary")).alias("sentence")).distinct()


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Length and non-zero entries of the hashed term vector of each note's title."""
    v = table(spark, d, "memory_nodes").select("id", hashed_terms(F.col("title")).alias("v")).distinct()
    return v.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"), F.size(F.filter("v", lambda x: x > 0)).alias("n_entries"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Twenty words of each hit around the first that the request asks for."""
    asked = _requests(spark, d).select("request", request_terms(F.col("text")).alias("asked"))
    hits = _lexical(spark, d).join(_chunks(spark, d).select(F.col("chunk_id").alias("id"), "content"), "id").join(asked, "request")
    return hits.select("request", "id", snippet(F.col("content"), F.col("asked")).alias("snippet"))


def majority_dimension(spark: SparkSession, d: str) -> DataFrame:
    """The dimension that most vectors of each label have; the smaller one on a tie."""
    counts = table(spark, d, "embeddings").where("embedding is not null").groupBy("label", F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))
    return counts.groupBy("label").agg(F.max_by("dimension", F.struct("n", -F.col("dimension"))).alias("dimension"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    sizes = _chunks(spark, d).select(F.col("chunk_id").alias("id"), token_estimate(F.col("content")).alias("n_tokens"))
    return _lexical(spark, d).join(sizes, "id")


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a request up to the first that exceeds 600 tokens."""
    return search.within_budget(_hits(spark, d), "request", [F.col("rank")], "n_tokens", F.lit(600), "prefix").select("request", "id", "rank", "n_tokens", "used", "action")


def budget_overshoot(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a request until 600 tokens are reached."""
    return search.within_budget(_hits(spark, d), "request", [F.col("rank")], "n_tokens", F.lit(600), "overshoot").select("request", "id", "rank", "n_tokens", "used", "action")


def budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a request that fit into 600 tokens, the best first, skipping those that do not fit."""
    return search.greedy_budget(_hits(spark, d), ["request"], ["rank"], "id", "n_tokens", F.lit(600)).where("taken").select("request", "id", "n_tokens")


def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a request's hits scaled to 0..1."""
    return search.normalized_scores(_lexical(spark, d), ["request"], "score", "norm").select("request", "id", F.round("norm", 4).alias("norm"))


def prefix_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One chunk for each project and beginning of 200 characters: the latest."""
    rows = table(spark, d, "knowledge_chunks").where("content is not null").select("project_id", "chunk_id", "content", "updated_at").distinct()
    kept = search.first_by_prefix(rows, ["project_id"], "content", 200, [F.desc_nulls_last("updated_at"), F.col("chunk_id")])
    return kept.select("project_id", "chunk_id")


def vec_stats(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per label and dimension."""
    return table(spark, d, "embeddings").groupBy("label", F.size("embedding").alias("dimension")).agg(F.count("*").alias("n_vectors"))


def vec_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Evidence and outlines of notes and documents that exist in no state: what points to nothing."""
    part = lambda df, kind, key, ref: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(ref).alias("ref"))
    tables = lambda name: table(spark, d, name)
    notes, docs = tables("memory_nodes").select(F.col("id").alias("ref")), tables("documents").select(F.col("document_id").alias("ref"))
    parents = part(tables("memory_nodes").where("parent_id is not null"), "parent", "id", "parent_id").join(notes, "ref", "left_anti")
    evidence = part(tables("evidence"), "evidence", "id", "memory_node_id").join(notes, "ref", "left_anti")
    chunks = part(tables("knowledge_chunks"), "chunk", "chunk_id", "document_id").join(docs, "ref", "left_anti")
    vectors = part(tables("embeddings"), "vector", "vec_id", "vec_id").withColumn("ref", F.col("ref").cast("string")).join(tables("documents").select(F.col("doc_id").cast("string").alias("ref")), "ref", "left_anti")
    return parents.union(evidence.select(*parents.columns)).union(chunks.select(*parents.columns)).union(vectors.select(*parents.columns)).select("kind", "id", "ref").distinct()


NAMES = "tok_word_set token_estimates normalize_query path_modules request_symbols redact_docs bm25_topk bow_cosine knn_exact rrf_fuse hybrid_search budget_prefix budget_overshoot budget_greedy minmax_scores prefix_dedupe vec_stats vec_orphans hybrid_results filtered_search lexical_terms_of sources_quality first_sentences hashed_vectors snippets majority_dimension"
QUERIES = {name: globals()[name] for name in NAMES.split()}

_STOPS = (
    "'a','an','the','is','in','it','of','to','and','or','for','be','on','at','as','by','with','that','this','was','are','from','its','i','we','they','not','no','but','if','has','have','had','do','did','will',"
    "'would','should','could','been','more','into','also','when','what','which','so'"
)
_KEYWORD_STOPS = (
    "'the','and','for','that','this','with','from','have','not','are','its','was','has','been','will','can','but','what','how','does','any','add','fix','get','let','use','set','put','run','out','our','all','new'"
)
_STATES = """states AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, index_status NULLS LAST, embedding_status NULLS LAST) AS n
  FROM knowledge_chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL) WHERE n = 1)"""
_LEX = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
_ASK = r"list_distinct(regexp_extract_all(strip_accents(lower(array_to_string(list_filter(regexp_split_to_array(translate({}, '\"-:()^*~', ''), '\s+'), lambda w: lower(w) NOT IN ('and', 'or', 'not')), ' '))), '[\p{{L}}\p{{N}}]+'))".replace('\\"', '"')
_BAG = "list_filter(regexp_extract_all(lower({}), '[a-z][a-z0-9_]*'), lambda w: len(w) > 1 AND w NOT IN (" + _STOPS + "))"
_INDEX = f"""
WITH RECURSIVE {_STATES},
chunks AS (SELECT chunk_id AS id, project_id AS scope, content FROM states WHERE index_status = 'indexed'),
idx AS (SELECT scope, id, dl, term, count(*) AS tf FROM (SELECT scope, id, len(l) AS dl, unnest(l) AS term FROM (SELECT scope, id, {_LEX.format('content')} AS l FROM chunks)) GROUP BY ALL),
asked AS (SELECT doc_id AS request, project_id AS scope, unnest({_ASK.format('title')}) AS term FROM documents WHERE doc_id % 20 = 0),
stats AS (SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT scope, id, dl FROM idx) GROUP BY scope),
df AS (SELECT scope, term, count(*) AS df FROM idx GROUP BY ALL),
weighted AS (SELECT i.scope, i.term, i.id,
  CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w
  FROM idx i JOIN df USING (scope, term) JOIN stats USING (scope)),
bm AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS rank FROM (
  SELECT request, id, round(sum(w), 6) AS score FROM asked JOIN weighted USING (scope, term) GROUP BY ALL)),
bag AS (SELECT scope, id, term, count(*) AS tf FROM (SELECT project_id AS scope, chunk_id AS id, unnest({_BAG.format('content')}) AS term FROM states WHERE index_status <> 'stale') GROUP BY ALL),
wanted AS (SELECT request, scope, term, count(*) AS q FROM (SELECT doc_id AS request, project_id AS scope, unnest({_BAG.format('title')}) AS term FROM documents WHERE doc_id % 20 = 0) GROUP BY ALL),
norms AS (SELECT scope, id, sqrt(sum(tf * tf)) AS dn FROM bag GROUP BY ALL),
qnorms AS (SELECT request, sqrt(sum(q * q)) AS qn FROM wanted GROUP BY ALL),
bow AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS rank FROM (
  SELECT request, id, round(dot / (qn * dn), 6) AS score FROM (SELECT request, scope, id, sum(q * tf) AS dot FROM wanted JOIN bag USING (scope, term) GROUP BY ALL)
  JOIN qnorms USING (request) JOIN norms USING (scope, id))),
hits AS (SELECT bm.*, greatest(1, length(content) // 4)::INTEGER AS n_tokens FROM bm JOIN chunks USING (id) WHERE rank <= 10)
"""
_RUN = "SELECT request, id, rank::INTEGER AS rank, n_tokens, used, CASE WHEN {} THEN 'included' ELSE 'over_budget' END AS action FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY request ORDER BY rank)::BIGINT AS used FROM hits)"

_CAMEL = r"regexp_extract_all(summary, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b')"
_SNAKE = r"regexp_extract_all(summary, '\b[a-z]+(?:_[a-z]+)+\b')"
_KEYS = r"list_filter(regexp_extract_all(lower(summary), '\b[a-z]\w*\b'), lambda w: len(w) > 2 AND w NOT IN (" + _KEYWORD_STOPS + "))"


def _ordered(expr: str) -> str:
    """SQL of the distinct elements of a list, in order of their first places."""
    return f"list_reduce({expr}, lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, []::VARCHAR[])"


_ORDERED_ASK = _ordered(_ASK.format("title").removeprefix("list_distinct(").removesuffix(")"))
_QUALITY = [("adr", 1.0), ("architecture_doc", 0.95), ("api_spec", 0.9), ("readme", 0.85), ("code_file", 0.8), ("test_report", 0.75), ("manual_note", 0.7), ("markdown", 0.7), ("task_artifact", 0.65), ("code_comment", 0.65), ("git_diff", 0.6), ("runtime_log", 0.5)]
_CAMEL_T, _SNAKE_T = _CAMEL.replace("summary", "coalesce(text, '')"), _SNAKE.replace("summary", "coalesce(text, '')")
_HYBRID = (
    _INDEX
    + rf""", lex AS (SELECT request, id, 2.0::DOUBLE / (60 + rank - 1) AS lexical FROM bm WHERE rank <= 30), vec AS (SELECT request, id, score AS vector FROM bow WHERE rank <= 30),
merged AS (SELECT coalesce(l.request, v.request) AS request, coalesce(l.id, v.id) AS id, coalesce(lexical, 0) AS lexical, coalesce(vector, 0) AS vector FROM lex l FULL JOIN vec v ON l.request = v.request AND l.id = v.id),
req AS (SELECT doc_id AS request, list_transform(generate_series(1, len(p)), lambda n: array_to_string(list_slice(p, 1, n), '.')) AS qm, list_transform(list_concat({_CAMEL_T}, {_SNAKE_T}), lambda x: lower(x)) AS qs
  FROM (SELECT *, string_split(regexp_replace(regexp_replace(rtrim(source_path, '/'), '[/\\]', '.', 'g'), '\.py$', ''), '.') AS p FROM documents WHERE doc_id % 20 = 0)),
worth AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in _QUALITY)}) t(source_type, w)),
scored AS (SELECT request, id, content, round((0.3 * vector + 0.25 * lexical
    + 0.15 * coalesce(len(list_intersect(list_distinct(module_paths), qm)) / nullif(len(list_distinct(module_paths)), 0), 0)
    + 0.1 * coalesce(len(list_intersect(list_distinct(list_transform(related_symbols, lambda x: lower(x))), qs)) / nullif(len(list_distinct(list_transform(related_symbols, lambda x: lower(x)))), 0), 0)
    + 0.1 * CASE WHEN index_status = 'indexed' THEN 0.9 ELSE 0.2 END + 0.05 * coalesce(w, 0.5) + 0.025)::DOUBLE, 4) AS score
  FROM merged JOIN states ON chunk_id = id JOIN req USING (request) LEFT JOIN worth USING (source_type) WHERE index_status <> 'stale' AND content <> ''),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request, left(content, 200) ORDER BY score DESC, id) AS n FROM scored) WHERE n = 1),
best AS (SELECT * FROM (SELECT request, id, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, id)::INTEGER AS rank FROM uniq) WHERE rank <= 10)
"""
)

ORACLE = {
    "tok_word_set": r"SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{M}\p{N}_]+'), lambda w: len(w) > 2))), ' ') AS words FROM memory_nodes",
    "token_estimates": "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4)::INTEGER AS n_tokens FROM documents",
    "normalize_query": r"SELECT doc_id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS query FROM documents",
    "path_modules": r"SELECT doc_id, array_to_string(list_transform(generate_series(1, len(p)), lambda n: array_to_string(list_slice(p, 1, n), '.')), ' ') AS modules FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(rtrim(source_path, '/'), '[/\\]', '.', 'g'), '\.py$', ''), '.') AS p FROM documents WHERE source_path IS NOT NULL)",
    "bm25_topk": _INDEX + "SELECT request, id, score, rank::INTEGER AS rank FROM bm WHERE rank <= 10",
    "bow_cosine": _INDEX + "SELECT request, id, score, rank::INTEGER AS rank FROM bow WHERE rank <= 10",
    "knn_exact": "SELECT request, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS request, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 10",
    "rrf_fuse": _INDEX
    + "SELECT request, id, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, id)::INTEGER AS rank FROM (SELECT request, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT request, id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT request, id, rank FROM bow WHERE rank <= 10) GROUP BY ALL)",
    "request_symbols": f"""SELECT id, array_to_string(list_concat(c, list_filter(s, lambda x: NOT list_contains(c, x))), ' ') AS symbols, array_to_string(list_slice(k, 1, 20), ' ') AS keywords FROM (
  SELECT id, {_ordered(_CAMEL)} AS c, {_ordered(_SNAKE)} AS s, {_ordered(_KEYS)} AS k FROM (SELECT DISTINCT id, summary FROM memory_nodes))""",
    "hybrid_search": _HYBRID + "SELECT request, id, score, rank FROM best",
    "hybrid_results": _HYBRID
    + """, docs AS (SELECT document_id, title FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, doc_id DESC) AS n FROM documents) WHERE n = 1),
shown AS (SELECT b.request, b.rank, b.id, coalesce(d.title, 'Unknown') AS t, array_to_string(s.heading_path, ' > ') AS h, s.content, greatest(1, length(s.content) // 4)::INTEGER AS n_tokens
  FROM best b JOIN states s ON s.chunk_id = b.id LEFT JOIN docs d USING (document_id))
SELECT request, rank, id, CASE WHEN h IS NULL OR h = '' OR h = t THEN t ELSE t || ': ' || h END AS title,
  CASE WHEN length(content) > 400 THEN regexp_replace(left(content, 400), '\\s+$', '') || chr(8230) ELSE content END AS preview, n_tokens
FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY request ORDER BY rank) AS used FROM shown) WHERE used <= 1200""",
    "filtered_search": _INDEX.replace("WHERE index_status <> 'stale'", "WHERE index_status NOT IN ('stale', 'archived', 'superseded', 'deleted') AND source_type IN ('code_file', 'manual_note', 'readme') AND (branch_name IS NULL OR branch_name = 'main' OR branch_scope IS NULL OR branch_scope IN ('global', 'mainline'))")
    + "SELECT request, id, score, rank::INTEGER AS rank FROM bow WHERE rank <= 10",
    "lexical_terms_of": f"SELECT doc_id, array_to_string({_LEX.format('title')}, ' ') AS indexed, array_to_string({_ORDERED_ASK}, ' ') AS asked FROM documents",
    "sources_quality": "SELECT doc_id, CASE WHEN coalesce(source_path, '') = '' THEN 0.5 " + " ".join(f"WHEN contains(lower(source_path), '{k}') THEN {v}" for k, v in _QUALITY) + " WHEN regexp_matches(lower(source_path), '(^|[.])(py|ts|js)$') THEN 0.7 ELSE 0.6 END::DOUBLE AS by_path, CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _QUALITY) + " ELSE 0.5 END::DOUBLE AS by_type FROM documents",
    "first_sentences": r"SELECT DISTINCT id, trim(regexp_replace(t, '^(.*?[.!?])\s+[A-Z].*$', '\1')) AS sentence FROM (SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(summary, '\r?\n'), lambda x: trim(x)), lambda x: x <> ''), ' ') AS t FROM memory_nodes)",
    "majority_dimension": "SELECT label, dimension FROM (SELECT label, dimension, row_number() OVER (PARTITION BY label ORDER BY n DESC, dimension) AS r FROM (SELECT label, len(embedding)::INTEGER AS dimension, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL)) WHERE r = 1",
    "budget_prefix": _INDEX + _RUN.format("used <= 600"),
    "budget_overshoot": _INDEX + _RUN.format("used - n_tokens < 600"),
    "budget_greedy": _INDEX
    + ", fill AS (SELECT request, 0::BIGINT AS rank, NULL::VARCHAR AS id, 0 AS n_tokens, 0::BIGINT AS used, false AS taken FROM (SELECT DISTINCT request FROM hits) UNION ALL SELECT f.request, h.rank, h.id, h.n_tokens, CASE WHEN f.used + h.n_tokens <= 600 THEN f.used + h.n_tokens ELSE f.used END, f.used + h.n_tokens <= 600 FROM fill f JOIN hits h ON h.request = f.request AND h.rank = f.rank + 1) SELECT request, id, n_tokens FROM fill WHERE taken",
    "minmax_scores": _INDEX
    + "SELECT request, id, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 4)::DOUBLE AS norm FROM (SELECT *, min(score) OVER (PARTITION BY request) AS lo, max(score) OVER (PARTITION BY request) AS hi FROM bm WHERE rank <= 10)",
    "prefix_dedupe": "SELECT project_id, chunk_id FROM (SELECT project_id, chunk_id, row_number() OVER (PARTITION BY project_id, left(content, 200) ORDER BY updated_at DESC NULLS LAST, chunk_id) AS n FROM (SELECT DISTINCT project_id, chunk_id, content, updated_at FROM knowledge_chunks WHERE content IS NOT NULL)) WHERE n = 1",
    "vec_stats": "SELECT label, len(embedding)::INTEGER AS dimension, count(*) AS n_vectors FROM embeddings GROUP BY ALL",
    "vec_orphans": """SELECT DISTINCT kind, id, ref FROM (
  SELECT 'parent' AS kind, id, parent_id AS ref FROM memory_nodes m WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM memory_nodes p WHERE p.id = m.parent_id)
  UNION ALL SELECT 'evidence', id, memory_node_id FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM memory_nodes p WHERE p.id = e.memory_node_id)
  UNION ALL SELECT 'chunk', chunk_id, document_id FROM knowledge_chunks k WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.document_id = k.document_id)
  UNION ALL SELECT 'vector', vec_id::VARCHAR, vec_id::VARCHAR FROM embeddings v WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = v.vec_id))""",
}
