import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.operators import chunking, lifecycle, search
from ctxspark.sources.files import scan_files
from ctxspark.streaming import refresh


def _one(spark, value, *exprs):
    return spark.createDataFrame([(value,)], "t string").select(*[e(F.col("t")) for e in exprs]).first()


def test_text_functions(spark):
    assert _one(spark, "Fix the FixRetry of retry_policy été", X.symbols)[0] == ["FixRetry", "retry_policy"]
    assert _one(spark, "The cat is 9 re-Runs of an été", X.word_set)[0] == ["cat", "runs", "the", "été"]
    assert _one(spark, "The Cat cat a1 9x is", X.terms)[0] == ["cat", "cat", "a1"]
    assert _one(spark, "src/a/b.py", X.module_prefixes)[0] == ["src", "src.a", "src.a.b"]
    assert _one(spark, " A  B\n", X.normalized)[0] == "a b"
    assert [_one(spark, t, X.token_estimate)[0] for t in ("", "abcd" * 5)] == [1, 5]
    assert _one(spark, None, X.word_set, X.terms, X.symbols) == (None, None, None)
    text, n = X.redact(F.col("t"))
    row = spark.createDataFrame([("password = hunter22 and postgres://u:pass1@h/x and Bearer abcdefgh12",)], "t string").select(text.alias("x"), n.alias("n")).first()
    assert row.x == "[REDACTED] and [REDACTED] and [REDACTED]" and row.n == 3
    pairs = spark.createDataFrame([("must run", "may run"), ("may run", "must run"), ("must", "never"), (None, "may")], "a string, b string")
    assert [r[0] for r in pairs.select(X.contradicts(F.col("a"), F.col("b"))).collect()] == [True, True, False, None]
    empty = spark.createDataFrame([([], [])], "a array<string>, b array<string>")
    assert empty.select(X.jaccard(F.col("a"), F.col("b")), X.overlap(F.col("a"), F.col("b"))).first() == (0.0, 0.0)


def test_bm25_and_cosine(spark):
    texts = [("p", "a", "kiln loads kiln"), ("p", "b", "kiln and ferry"), ("p", "c", "ferry waits"), ("q", "d", "kiln"), ("p", "e", None), ("p", "f", ""), ("p", "g", "silo"), ("p", "h", "dike")]
    index = search.postings(spark.createDataFrame(texts, "s string, i string, t string"), "s", "i", "t")
    asked = spark.createDataFrame([(1, "p", "the kiln"), (2, "p", "nothing"), (3, "p", None), (4, "q", "kiln"), (5, "p", "kiln kiln ferry")], "request int, scope string, text string")
    got = [(r.request, r.id, r["rank"]) for r in search.bm25(index, asked).orderBy("request", "rank").collect()]
    assert got == [(1, "a", 1), (1, "b", 2), (4, "d", 1), (5, "b", 1), (5, "a", 2), (5, "c", 3)]
    cos = {(r.request, r.id): r.score for r in search.cosine_terms(index, asked).collect()}
    assert cos[4, "d"] == 1.0 and abs(cos[1, "a"] - 2 / 5**0.5) < 1e-6 and (1, "c") not in cos
    assert len(search.bm25(index, asked, k=1).collect()) == 3
    assert search.bm25(index.limit(0), asked).collect() == []


def test_nearest_vectors_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, []), (502, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = search.nearest_vectors(df, df.where("id % 9 = 0"), "id", "v", k=3, block=20).orderBy("request", "rank").collect()
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(0, 90, 9):
        best = [j for j in np.argsort(-(u @ u[q])) if j != q][:3]
        assert [r.id for r in got if r.request == q] == best
    assert len(got) == 30


def test_budgets_and_fusion(spark):
    hits = spark.createDataFrame([(1, "a", 1, 50), (1, "b", 2, 60), (1, "c", 3, 40), (1, "d", 4, 10), (2, "e", 1, 500)], "request int, id string, rank int, n int")
    run = lambda rule: {r.id for r in search.within_budget(hits, "request", [F.col("rank")], "n", F.lit(100), rule).where("action = 'included'").collect()}
    assert run("prefix") == {"a"} and run("overshoot") == {"a", "b", "e"}
    assert {r.id for r in search.greedy_budget(hits, ["request"], ["rank"], "id", "n", F.lit(100)).where("taken").collect()} == {"a", "c", "d"}
    fused = search.reciprocal_ranks(hits, hits.where("id = 'c'").withColumn("rank", F.lit(1))).where("request = 1").orderBy("rank").collect()
    assert fused[0].id == "c"
    norm = {r.id: r.x for r in search.normalized_scores(hits, ["request"], "n", "x").collect()}
    assert norm == {"a": 0.8, "b": 1.0, "c": 0.6, "d": 0.0, "e": 1.0}
    texts = spark.createDataFrame([("p", 1, "same start A"), ("p", 2, "same start B"), ("p", 3, None), ("p", 4, "")], "p string, i int, t string")
    assert sorted(r.i for r in search.first_by_prefix(texts, ["p"], "t", 10, [F.col("i")]).collect()) == [1, 3]


def test_chunks(spark):
    md = "lost\n# A\ntext\n### C\nx\n## B\n" + "\n\n".join("word " * 300 for _ in range(8))
    rows = [(1, md), (2, "no heading"), (3, None), (4, "  \n")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id int, text string, content string")
    got = chunking.markdown_chunks(df, "id", "text").orderBy("id", "chunk_index").collect()
    assert [(r.heading_path) for r in got if r.id == 1][:3] == ["A", "A > C", "A > B"] and len([r for r in got if r.id == 1]) == 5
    assert all(len(r.content) // 4 <= 1200 for r in got) and [r.content for r in got if r.id == 2] == ["no heading"] and not [r for r in got if r.id in (3, 4)]
    code = spark.createDataFrame([(1, "import a\n\ndef f():\n  pass\nclass B:\n  def g(): pass\n")], "id int, text string")
    assert [r.symbols for r in chunking.code_chunks(code, "id", "text").orderBy("chunk_index").collect()] == ["", "f", "B"]
    diff = spark.createDataFrame([(1, "diff --git a/x/y.py b/x/y.py\nindex\n@@ -1 +1 @@\n+a\n@@ -5 +5 @@\n-b\ndiff --git a/z.md b/z.md\n@@ -1 @@\n+q")], "id int, text string")
    assert [r.module_path for r in chunking.diff_chunks(diff, "id", "text").orderBy("chunk_index").collect()] == ["x.y"] * 3 + ["z.md"] * 2
    log = spark.createDataFrame([(1, "\n".join("ERROR x" if i in (5, 20) else f"line {i}" for i in range(30)))], "id int, text string")
    assert [(r.start_line, r.end_line) for r in chunking.log_windows(log, "id", "text").orderBy("start_line").collect()] == [(3, 9), (18, 24)]
    items = spark.createDataFrame([(1, "- The worker must never block\n- short\n1. import everything now\n2. Just a plain fact here\n- the worker MUST never  block")], "id int, text string")
    assert sorted((r.kind, r.confidence) for r in chunking.statements(items, "id", "text").collect()) == [("constraint", 0.82), ("implementation_detail", 0.7)]


def test_lifecycle(spark):
    nodes = spark.createDataFrame(
        [("a", "p", "module", "x.y", "Retry policy of the ferry", "It waits"), ("b", "p", "module", "x.y", "Retry policy of the ferry", "It waits long"), ("c", "p", "debug", None, "Other words", ""), ("d", "q", "module", "x.y", "Retry policy of the ferry", "It waits")],
        "id string, project_id string, kind string, module_path string, title string, summary string",
    )
    got = lifecycle.likely_duplicates(nodes.where("id = 'a'"), nodes).collect()
    assert [(r.id_a, r.id_b, r.band, r.best) for r in got] == [("a", "b", "near", True)]
    with pytest.raises(ValueError):
        lifecycle.likely_duplicates(nodes, nodes, 0.3)
    said = lifecycle.contradictions(spark.createDataFrame([("a", "b"), ("a", "c")], "id_a string, id_b string"), spark.createDataFrame([("a", "must be atomic"), ("b", "eventual"), ("c", "x")], "id string, text string"))
    assert [tuple(r) for r in said.collect()] == [("a", "b")]
    patch = spark.createDataFrame([("a", "stale", None), ("zz", "stale", "x")], "id string, kind string, title string")
    assert {r.id: (r.kind, r.title) for r in lifecycle.patched(nodes, patch, "id", ["kind", "title"]).collect()}["a"] == ("stale", "Retry policy of the ferry")
    kids = spark.createDataFrame([("k1", "a"), ("k2", "b")], "kid string, parent string")
    left, kept = lifecycle.cascade_deleted(nodes, kids, "id", "parent", spark.createDataFrame([("a",)], "id string"))
    assert left.count() == 3 and [r.kid for r in kept.collect()] == ["k2"]
    edge = lambda rows: spark.createDataFrame(rows, "source_id string, target_id string, relation_type string, w int")
    assert sorted(tuple(r) for r in lifecycle.new_edges(edge([("a", "b", "x", 1)]), edge([("a", "b", "x", 2), ("a", "a", "x", 3), ("a", "b", "y", 4)])).collect()) == [("a", "b", "x", 1), ("a", "b", "y", 4)]


def test_scan_files(spark, tmp_path):
    for name, data in {"README.md": b"# hi \xff", "src/a.py": b"x = 1\n", "docs/adr/1.md": b"d", "build/c.txt": b"c", "k.pem": b"k", "b.txt": b"a\0b", "img.png": b"p", "secrets/x.txt": b"s"}.items():
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(data)
    rows = {r.rel_path: r for r in scan_files(spark, str(tmp_path)).collect()}
    assert {k: r.reason for k, r in rows.items()} == {"README.md": None, "src/a.py": None, "docs/adr/1.md": None, "build/c.txt": "excluded directory", "k.pem": "excluded file", "b.txt": "binary", "img.png": "binary", "secrets/x.txt": "secret directory"}
    assert rows["README.md"].source_type == "readme" and rows["docs/adr/1.md"].source_type == "adr" and rows["src/a.py"].language == "python" and rows["src/a.py"].text == "x = 1\n"
    assert rows["README.md"].text.startswith("# hi") and rows["k.pem"].text is None
    assert scan_files(spark, str(tmp_path), "*.py").count() == 1


def test_streams_agree_with_tables(spark, tmp_path):
    t = datetime(2024, 1, 1)
    docs = [("p", f"f{i % 7}", f"h{i % 5}", t + timedelta(hours=i), i) for i in range(40)]
    schema = "project_id string, source_path string, content_hash string, created_at timestamp, doc_id int"
    for k in range(4):
        spark.createDataFrame(docs[k * 10 : k * 10 + 10], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    table = spark.read.parquet(str(tmp_path / "in"))
    refresh.run_ingestion(refresh.arrivals(spark, str(tmp_path / "in"), table.schema, 1), str(tmp_path / "state"), str(tmp_path / "log"))
    versions = sorted(int(x.split("=")[1]) for x in os.listdir(tmp_path / "state"))
    last = spark.read.parquet(str(tmp_path / f"state/v={versions[-1]}"))
    expected = {f"f{i % 7}": f"h{i % 5}" for i in range(40)}
    assert versions == [0, 1, 2, 3] and {r.source_path: r.content_hash for r in last.collect()} == expected
    events = spark.createDataFrame([(i % 3, t + timedelta(minutes=50 * i * (1 + i % 2)), "a") for i in range(30)] + [(0, t + timedelta(days=30), "a")], "user int, ts timestamp, kind string")
    events.write.parquet(str(tmp_path / "events"))
    batch = {tuple(r) for r in refresh.session_counts(events, "user", "ts", "2 hours").collect()}
    stream = refresh.session_counts(refresh.arrivals(spark, str(tmp_path / "events"), events.schema), "user", "ts", "2 hours", "1 hour")
    stream.writeStream.format("memory").queryName("s").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    closed = {tuple(r) for r in spark.table("s").collect()}
    assert closed and closed <= batch and len(batch - closed) <= 3
    counted = refresh.counted_windows(spark, str(tmp_path / "events"), "ts", "kind", "1 day")
    assert counted.agg(F.sum("n_rows")).first()[0] == 31
    once = refresh.first_of_content(refresh.arrivals(spark, str(tmp_path / "in"), table.schema), ["source_path", "content_hash"], "created_at", "2 days")
    once.writeStream.format("memory").queryName("o").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("o").count() == table.select("source_path", "content_hash").distinct().count()


def test_entry_is_wired(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40
    assert e.entry(spark).count() > 0


def test_contexts(spark):
    from ctxspark.operators import context

    notes = spark.createDataFrame(
        [("a", "p", "module", "Ferry loader", "loads the ferry " * 40, ["ferry"], "ferry.loader", 1, 0.5, 0.5, datetime(2024, 8, 1)), ("b", "p", "module", "Kiln", "short", None, None, None, None, None, None), ("c", "q", "module", "Ferry", "x", [], None, 0, 0.9, 0.9, datetime(2024, 8, 1)), ("d", "p", "outcome", "Ferry", None, [], None, 0, 0.9, 0.9, datetime(2024, 8, 1))],
        "id string, project_id string, kind string, title string, summary string, tags array<string>, module_path string, depth int, importance double, confidence double, updated_at timestamp",
    )
    asked = spark.createDataFrame([(1, "p", "fix the ferry loader", ["src/ferry/loader.py"]), (2, "zz", "ferry", []), (3, "p", None, None)], "request int, scope string, text string, files array<string>")
    ranked = context.rank_notes(asked, notes, "2024-09-01")
    got = {r.id: r for r in ranked.where("request = 1").collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["rank"] == 1 and got["b"]["rank"] == 3 and ranked.where("request = 2").count() == 0
    assert {r.id for r in context.note_pack(ranked.where("request = 1"), 400).collect()} == {"b"}  # a has 160 tokens, its bucket 120
    hits = spark.createDataFrame([(1, "h1", "It loads the ferry and waits"), (1, "h2", "other words")], "request int, id string, text string")
    assert [r.id for r in context.not_in_pack(hits, spark.createDataFrame([(1, "loads the ferry")], "request int, text string")).collect()] == ["h2"]
    layer = lambda rows: search.postings(spark.createDataFrame(rows, "s string, i string, t string"), "s", "i", "t")
    texts = spark.createDataFrame([("x", "x1", "ferry loader"), ("y", "y1", "ferry loader"), ("y", "y2", "ferry kiln")], "layer string, id string, text string")
    one = context.layered_search({"x": layer([("p", "x1", "ferry loader"), ("p", "x0", "silo"), ("p", "x2", "dike")]), "y": layer([("p", "y1", "ferry loader"), ("p", "y2", "ferry kiln"), ("p", "y3", "silo"), ("p", "y4", "dike"), ("p", "y5", "weir")])}, asked, ["y", "x"], texts)
    assert [(r.layer, r.id) for r in one.orderBy("rank").collect()] == [("y", "y1"), ("y", "y2")]


def test_expiring_keys(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "k string, ts timestamp"
    spark.createDataFrame([("a", t), ("b", t)], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    spark.createDataFrame([("b", t + timedelta(hours=10))], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = refresh.arrivals(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    gone = refresh.expiring(stream, "k", "ts", 3600, "0 seconds")
    gone.writeStream.format("memory").queryName("gone").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.k, r.last_seen) for r in spark.table("gone").collect()] == [("a", t)]
