"""Queries of the general corpus problems (2 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.functions.paths import plain_digest, plain_path
from ctxspark.operators.hierarchy import descendants, hierarchies
from ctxspark.operators.snapshots import snapshot_changes
from ctxspark.runtime import table


def manifest_changes(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """New, changed and deleted files between each listed snapshot and the project's one before."""
    return snapshot_changes(
        rows,
        snapshots,
        "project_id",
        "snapshot_no",
        key=plain_path(F.col("rel_path")),
        compared=[plain_digest(F.col("content_hash"))],
        newest=[F.coalesce(F.when(~F.isnan("mtime"), F.col("mtime")), F.lit(float("-inf"))), F.coalesce(F.col("delivered_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))],
        absent=F.lower(F.trim("index_status")) == "deleted",
        key_name="rel_path",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_changes(table(spark, sf_dir, "file_manifest"), table(spark, sf_dir, "manifest_snapshots"))


def p2_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per project and snapshot by kind."""
    return p2_found(spark, sf_dir).groupBy("project_id", "snapshot_no", "change").agg(F.count("*").alias("n_files"))


def _forest(tree_nodes: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of both forests; keys carry the forest's name so that they cannot clash."""
    part = lambda doc, i: F.concat(F.lit("outline:"), doc, F.lit("#"), i.cast("string"))
    doc, i, up = F.col("document_id"), F.col("paragraph_index"), F.col("parent_paragraph_index")
    nodes = tree_nodes.select(F.concat(F.lit("memory:"), "node_id").alias("key")).union(outline.select(part(doc, i)))
    links = tree_nodes.select(F.concat(F.lit("memory:"), "node_id").alias("parent"), F.explode("children").alias("c")).select(
        F.concat(F.lit("memory:"), "c").alias("child"), "parent"
    )
    return nodes, links.unionByName(outline.select(part(doc, i).alias("child"), part(doc, up).alias("parent")))


def _walked(spark: SparkSession, sf_dir: str, paths: bool = True) -> DataFrame:
    return hierarchies(*_forest(table(spark, sf_dir, "tree_nodes"), table(spark, sf_dir, "raw_propositions")), paths=paths)


def _named(key: str) -> tuple:
    tree = F.substring_index(key, ":", 1)
    return tree, F.expr(f"substring({key}, locate(':', {key}) + 1)")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, node = _named("key")
    return _walked(spark, sf_dir, paths=False).select(tree.alias("tree"), node.alias("node_key"), _named("root_key")[1].alias("root_key"), "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path (keys joined by ` > `), number of descendants and the links that close circles."""
    tree, node = _named("key")
    path = F.array_join(F.transform("path", lambda k: F.regexp_replace(k, "^(memory|outline):", "")), " > ")
    return _walked(spark, sf_dir).select(tree.alias("tree"), node.alias("node_key"), path.alias("path"), "n_descendants", "back_edge")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant, distance) of the trees."""
    tree, node = _named("ancestor")
    return descendants(_walked(spark, sf_dir)).select(
        tree.alias("tree"), node.alias("ancestor"), _named("descendant")[1].alias("descendant"), F.col("distance").cast("int").alias("distance")
    )


QUERIES = {"p2_found": p2_found, "p2_change_counts": p2_change_counts, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_P2 = """
WITH listed AS (
  SELECT *, lag(snapshot_no) OVER w AS before, lead(snapshot_no) OVER w AS after
  FROM (SELECT DISTINCT project_id, snapshot_no FROM manifest_snapshots) WINDOW w AS (PARTITION BY project_id ORDER BY snapshot_no)),
spelled AS (
  SELECT project_id, snapshot_no, index_status, mtime, delivered_at,
    nfc_normalize(array_to_string(list_reduce(string_split(replace(rel_path, chr(92), '/'), '/'),
      lambda a, s: CASE WHEN s IN ('', '.') THEN a WHEN s = '..' THEN list_slice(a, 1, len(a) - 1) ELSE list_append(a, s) END,
      []::VARCHAR[]), '/')) AS rel_path,
    regexp_replace(lower(regexp_replace(content_hash, '\\s+', '', 'g')), '^[a-z0-9_-]+[:=]', '') AS digest
  FROM (SELECT * REPLACE (rel_path AS rel_path) FROM file_manifest)),
state AS (
  SELECT s.project_id, s.snapshot_no, s.rel_path, s.digest, l.before, l.after
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, snapshot_no, rel_path ORDER BY mtime DESC NULLS LAST, delivered_at DESC NULLS LAST, digest DESC) AS rn FROM spelled) s
  JOIN listed l USING (project_id, snapshot_no)
  WHERE rn = 1 AND index_status <> 'deleted' AND rel_path <> ''),
now AS (SELECT * FROM state WHERE before IS NOT NULL),
past AS (SELECT project_id, after AS snapshot_no, rel_path, digest FROM state WHERE after IS NOT NULL),
changes AS (
  SELECT coalesce(n.project_id, p.project_id) AS project_id, coalesce(n.snapshot_no, p.snapshot_no)::INTEGER AS snapshot_no, coalesce(n.rel_path, p.rel_path) AS rel_path,
    CASE WHEN p.rel_path IS NULL THEN 'new' WHEN n.rel_path IS NULL THEN 'deleted' WHEN n.digest IS DISTINCT FROM p.digest THEN 'changed' END AS change
  FROM now n FULL JOIN past p ON n.project_id = p.project_id AND n.snapshot_no = p.snapshot_no AND n.rel_path = p.rel_path)
"""

_P5 = """
WITH RECURSIVE nodes AS (
  SELECT DISTINCT 'memory' AS tree, node_id AS k FROM tree_nodes WHERE node_id IS NOT NULL
  UNION SELECT DISTINCT 'outline', document_id || '#' || paragraph_index FROM raw_propositions WHERE document_id IS NOT NULL AND paragraph_index IS NOT NULL),
raw AS (
  SELECT 'memory' AS tree, c AS child, node_id AS parent FROM (SELECT node_id, unnest(children) AS c FROM tree_nodes)
  UNION SELECT 'outline', document_id || '#' || paragraph_index, document_id || '#' || parent_paragraph_index FROM raw_propositions),
up AS (
  SELECT n.tree, n.k, (SELECT min(r.parent) FROM raw r JOIN nodes m ON m.tree = r.tree AND m.k = r.parent WHERE r.tree = n.tree AND r.child = n.k) AS parent FROM nodes n),
walk AS (
  SELECT tree, k, [k] AS path, parent AS cur FROM up
  UNION ALL
  SELECT w.tree, w.k, list_prepend(w.cur, w.path), u.parent FROM walk w JOIN up u ON u.tree = w.tree AND u.k = w.cur WHERE NOT list_contains(w.path, w.cur)),
ended AS (
  SELECT tree, k, path, cur, CASE WHEN cur IS NULL THEN NULL ELSE list_slice(path, 1, list_position(path, cur)) END AS ring
  FROM walk WHERE cur IS NULL OR list_contains(path, cur))
"""

ORACLE = {
    "p2_found": _P2 + "SELECT * FROM changes WHERE change IS NOT NULL",
    "p2_change_counts": _P2 + "SELECT project_id, snapshot_no, change, count(*) AS n_files FROM changes WHERE change IS NOT NULL GROUP BY ALL",
    "p5_found": _P5
    + """SELECT tree, k AS node_key, CASE WHEN cur IS NULL THEN path[1] ELSE list_min(ring) END AS root_key,
  (CASE WHEN cur IS NULL THEN len(path) - 1 WHEN list_contains(ring, k) THEN -1 ELSE -2 END)::INTEGER AS depth FROM ended""",
    "p5_paths": _P5
    + """, placed AS (SELECT tree, k, cur, ring, CASE WHEN cur IS NULL THEN path[1] ELSE list_min(ring) END AS root,
  CASE WHEN cur IS NULL THEN path WHEN list_contains(ring, k) THEN [k] ELSE list_slice(path, len(ring), len(path)) END AS path FROM ended)
SELECT tree, k AS node_key, array_to_string(path, ' > ') AS path,
  CASE WHEN cur IS NOT NULL AND list_contains(ring, k) THEN (SELECT count(*) FROM placed x WHERE x.tree = p.tree AND x.root = p.root AND x.cur IS NOT NULL) - 1
    ELSE (SELECT count(*) FROM placed x WHERE x.tree = p.tree AND list_contains(x.path, p.k)) - 1 END AS n_descendants,
  cur IS NOT NULL AND list_contains(ring, k) AND k = root AS back_edge FROM placed p""",
    "p5_descendants": _P5
    + """SELECT tree, anc AS ancestor, k AS descendant, (len(path) - i)::INTEGER AS distance
  FROM (SELECT tree, k, path, unnest(path) AS anc, generate_subscripts(path, 1) AS i
        FROM (SELECT tree, k, CASE WHEN cur IS NULL THEN path WHEN list_contains(ring, k) THEN [k] ELSE list_slice(path, len(ring), len(path)) END AS path FROM ended))
  WHERE i < len(path)""",
}
