"""Small fixtures for search, contexts, paragraphs and notes: nulls, empty texts, ties, empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.operators import chunking, context, lifecycle, paragraphs, search
from ctxspark.sources import files
from ctxspark.streaming import refresh


def _one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_terms_of_the_lexical_index(spark):
    assert _one(spark, X.lexical_terms(F.col("t")), t="Café_naïve Größe Ёлка-2") == ["cafe", "naive", "große", "елка", "2"]
    assert _one(spark, X.request_terms(F.col("t")), t='foo-bar AND "Éa" or (x) not baz x') == ["foobar", "ea", "x", "baz"]
    assert _one(spark, X.request_terms(F.col("t")), t="and OR -") == [] and _one(spark, X.lexical_terms(F.col("t")), t=None) is None


def test_small_text_functions(spark):
    assert _one(spark, X.first_sentence(F.col("t")), t=" One two.\n Three four. Five") == "One two."
    assert _one(spark, X.preview(F.col("t"), 5), t="abcd efgh") == "abcd…" and _one(spark, X.preview(F.col("t"), 50), t="abc") == "abc"
    assert _one(spark, X.result_title(F.col("t"), F.col("h")), t="Doc", h=["A", "B"]) == "Doc: A > B" and _one(spark, X.result_title(F.col("t"), F.col("h")), t=None, h=[]) == "Unknown"
    assert _one(spark, X.path_quality(F.col("t")), t="docs/adr/1.md") == 1.0 and _one(spark, X.path_quality(F.col("t")), t="a/b.PY") == 0.7
    assert _one(spark, X.path_quality(F.col("t")), t=None) == 0.5 and _one(spark, X.path_quality(F.col("t")), t="a/b.md") == 0.6
    v = _one(spark, X.hashed_terms(F.col("t"), 16), t="lamp lamp door")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and set(_one(spark, X.hashed_terms(F.col("t"), 16), t="")) == {0.0}
    assert _one(spark, X.snippet(F.col("t"), F.col("w"), 4), t="a b c d Needle f g", w=["needle"]) == "c d Needle f"


def test_visible_rows(spark):
    rows = [("indexed", "code", None, None), ("stale", "code", None, None), ("indexed", "log", None, None), ("indexed", "code", "dev", "feature"), ("indexed", "code", "dev", "global"), (None, "code", "main", "x")]
    df = spark.createDataFrame(rows, "state string, kind string, branch_name string, branch_scope string")
    shown = df.where(X.visible_rows("state", "kind", "branch_name", "branch_scope", ["code"], "main"))
    assert sorted(map(str, shown.collect())) == sorted(str(df.collect()[i]) for i in (0, 4, 5))


def test_bm25_in_parts_is_the_same(spark):
    rng = random.Random(1)
    texts = [(i, "p", " ".join(rng.choice("abcdefghij") * 3 for _ in range(rng.randint(1, 30)))) for i in range(120)] + [(900, "p", None), (901, "p", "")]
    index = search.postings(spark.createDataFrame(texts, "id int, scope string, text string"), "scope", "id", "text", X.lexical_terms)
    asked = spark.createDataFrame([(1, "p", "aaa bbb aaa"), (2, "p", "zzz"), (3, "q", "aaa"), (4, "p", None)], "request int, scope string, text string")
    one, many = (sorted(map(tuple, search.bm25(index, asked, slices=n).collect())) for n in (1, 7))
    assert one == many and {r[0] for r in one} == {1} and len(one) == 10
    assert search.bm25(index.limit(0), asked).collect() == []


def test_hybrid_signals(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.4), (1, "c", 3, 0.3)], "request int, id string, rank int, score double")
    chunks = [("a", "text a", "adr", "indexed", ["m.n", "x"], ["Foo"]), ("b", "", "adr", "indexed", None, None), ("c", "text c", None, "stale", [], [])]
    df = spark.createDataFrame(chunks, "chunk_id string, content string, source_type string, index_status string, module_paths array<string>, related_symbols array<string>")
    asked = spark.createDataFrame([(1, ["m/n/o.py"], ["foo"])], "request int, files array<string>, symbols array<string>")
    got = search.hybrid(hits, hits.limit(0), df, asked).collect()
    assert [(r.id, r.score) for r in got] == [("a", round(0.25 * 2 / 60 + 0.15 * 0.5 + 0.1 + 0.09 + 0.05 + 0.025, 4))]


def test_notes_that_packs_leave_out_and_branches(spark):
    notes = [(s, "p", "module", "lamp door", "s", [], None, 0, 0.5, 0.5, "2024-01-01", s, None, None) for s in ("active", " Stale", "superseded", "archived")]
    df = spark.createDataFrame(notes, "id string, project_id string, kind string, title string, summary string, tags array<string>, module_path string, depth int, importance double, confidence double, updated_at string, status string, branch_name string, branch_scope string")
    asked = spark.createDataFrame([(1, "p", "lamp", [], "bug_fix", "main")], "request int, scope string, text string, files array<string>, intent string, branch string")
    plain = context.rank_notes(asked, df, "2024-01-01", context.affinity_table(spark)).collect()
    assert [r.id for r in plain] == ["active"]
    score = lambda *v: spark.createDataFrame([v], "b string, n string, s string, p string").select(context.branch_score(F.lit(0.6), F.col("b"), F.col("n"), F.col("s"), F.lit(None), F.col("p"), F.array(F.lit("src/a.py"))).alias("x")).first().x
    assert score(None, "x", "y", None) == 0.6
    assert abs(score("main", "main", "current_branch", "a.py") - (0.35 * 0.6 + 0.2 + 0.15 + 0.1 + 0.05 + 0.1)) < 1e-12
    assert abs(score("main", None, None, "") - (0.35 * 0.6 + 0.06 + 0.15 + 0.05 + 0.03)) < 1e-12


def test_evidence_stops_at_a_note_and_goes_on_with_the_next(spark):
    notes = spark.createDataFrame([(1, "n1", "decision", 2), (1, "n0", "constraint", 5), (1, "n2", "module", 1)], "request int, id string, bucket string, rank int")
    ev = [("n0", "e1", 1, 60), ("n0", "e2", 2, 50), ("n0", "e3", 3, 1), ("n1", "e4", 1, 40), ("n2", "e5", 1, 1)]
    got = context.evidence_fill(notes, spark.createDataFrame(ev, "note string, evidence string, created_at int, n_tokens int"), 100).collect()
    assert sorted(r.evidence for r in got) == ["e1", "e4"]


def test_paragraphs(spark):
    code = 'import os\n\ndef first(a):\n    """Say what it does, at length.\n    More."""\n    return a\n\nclass Second:\n    # note: this must never be called twice\n    raise ValueError("no way")\n'
    docs = spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "x = " + "y" * 5000)], "id int, text string")
    rows = {(r.id, r.paragraph_index): r for r in paragraphs.code_paragraphs(docs, "id", "text").collect()}
    assert rows[1, 1].heading == "first" and rows[1, 1].summary == "Say what it does, at length." and rows[1, 2].summary == "class Second" and {k[0] for k in rows} == {1, 4}
    said = {r.statement: (r.kind, r.confidence) for r in paragraphs.code_statements(docs, "id", "text").collect()}
    assert said["Raises ValueError: no way"] == ("risk", 0.8) and said["note: this must never be called twice"] == ("constraint", 0.88) and said["Say what it does, at length."][1] == 0.85
    made = paragraphs.module_summaries(paragraphs.code_paragraphs(docs, "id", "text").withColumn("name", F.lit("m")), "id", "name").collect()
    assert {r.id: r.summary for r in made}[1] == "Module covering: first, Second Key components: first, Second."
    assert _one(spark, paragraphs.distinct_first(F.col("t"), 2), t=["a", "A", "b", "c"]) == ["a", "b"]


def test_logs_without_errors_and_long_windows(spark):
    long = "\n\n".join("ERROR " + "x" * 1500 for _ in range(4))
    docs = spark.createDataFrame([(1, "all is fine\nreally"), (2, long), (3, None), (4, "  ")], "id int, text string")
    got = chunking.log_windows(docs, "id", "text").collect()
    assert [(r.start_line, r.content) for r in got if r.id == 1] == [(None, "all is fine\nreally")]
    assert sum(r.id == 2 for r in got) == 4 and not any(r.id > 2 for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_likely_duplicates_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [a + b for a in ("lam", "dor", "fen", "gri", "hol", "jas") for b in ("per", "tun", "vik", "zed")]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [(pick(4), pick(12)) for _ in range(12)]
    rows = []
    for i in range(70):
        t, s = rng.choice(base)
        rows.append((f"n{i:02d}", "p" if i % 3 else "q", rng.choice(["a", "b", None]), rng.choice([None, "core.api", "core.db"]), " ".join(w for w in t.split() if rng.random() < 0.8), s))
    df = spark.createDataFrame(rows, "id string, project_id string, kind string, module_path string, title string, summary string")
    got = {(r.id_a, r.id_b): r.score for r in lifecycle.likely_duplicates(df, df).collect()}
    w = lambda x: {y for y in re.findall(r"\w+", x.lower()) if len(y) > 2}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    true = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and a[1] == b[1]:
                m = w((a[3] or "").replace(".", " "))
                x = 0.6 * max(jac(w(a[4]), w(b[4])), 0.8 * jac(w(a[4] + " " + a[5][:200]), w(b[4] + " " + b[5][:200]))) + 0.2 * (a[2] is not None and a[2] == b[2]) + 0.2 * (len(m & w((b[3] or "").replace(".", " "))) / len(m) if m else 0)
                if x >= 0.5 - 1e-9:
                    true[a[0], b[0]] = x
    assert set(got) == set(true) and len(true) > 20 and all(abs(got[k] - true[k]) < 1e-3 for k in true)


def test_changes_of_state(spark):
    at = F.lit("2024-09-01").cast("timestamp")
    notes = spark.createDataFrame([("a", "active", None, None, None), ("b", "archived", None, "old", None)], "id string, status string, archived_at timestamp, archived_reason string, updated_at timestamp")
    both = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    done = {r.id: r for r in lifecycle.archived(notes, both, "id", at, "why").collect()}
    assert done["a"].status == "archived" and done["a"].archived_reason == "why" and done["b"].archived_reason == "old" and done["b"].updated_at is None
    back = {r.id: r for r in lifecycle.restored(notes, both, "id", at).collect()}
    assert back["b"].status == "active" and back["b"].archived_reason is None and back["a"].updated_at is None
    rows = spark.createDataFrame([("c1", "d1", "indexed"), ("c2", "d2", "indexed"), ("c3", None, "indexed")], "id string, doc string, index_status string")
    assert [r.index_status for r in lifecycle.staled(rows, "doc", spark.createDataFrame([("d1",), (None,)], "doc string")).orderBy("id").collect()] == ["stale", "indexed", "indexed"]
    stored = spark.createDataFrame([("r1", "h", "m"), ("r2", "h", "other")], "record_id string, content_hash string, model string")
    assert [r.record_id for r in lifecycle.vector_misses(spark.createDataFrame([("r1", "h"), ("r2", "h"), ("r1", "h2")], "record_id string, content_hash string"), stored, "m").orderBy("record_id").collect()] == ["r1", "r2"]
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "a", "x"), ("a", "gone", "x")], "source_id string, target_id string, relation_type string")
    peers = {(r.id, r.peer): r.conflict for r in lifecycle.edge_peers(lifecycle.new_edges(edges, edges), spark.createDataFrame([("a", "Stale"), ("b", "active")], "id string, status string")).collect()}
    assert peers == {("a", "b"): False, ("b", "a"): True}
    seq = spark.createDataFrame([(1, "p", None), (2, "p", None), (3, "p", "t"), (4, "q", "t")], "i int, k string, h string")
    assert [r.outcome for r in lifecycle.ingestion_sequence(seq, ["k"], "h", ["i"]).orderBy("i").collect()] == ["new", "duplicate", "updated", "new"]
    manifest = spark.createDataFrame([("a", "h", "indexed", 1), ("b", "h", "indexed", 2), ("c", "h", "indexed", 3)], "path string, content_hash string, index_status string, revision int")
    changes = spark.createDataFrame([("a", "changed", "h2"), ("b", "deleted", None), ("d", "new", "h")], "path string, change string, content_hash string")
    assert {tuple(r) for r in lifecycle.manifest_applied(manifest, changes, ["path"]).collect()} == {("a", "h2", "indexed", 2), ("b", "h", "deleted", 2), ("c", "h", "indexed", 3), ("d", "h", "indexed", 1)}


def test_hits_with_parents(spark):
    hits = spark.createDataFrame([(1, "a", "x.py"), (1, "b", None)], "request int, id string, source_path string")
    links = spark.createDataFrame([("a", "p"), ("b", "a"), ("p", None)], "id string, parent string")
    got = {(r.id, r.how) for r in context.with_parents(hits, links, spark.createDataFrame([("x.py", "s"), ("y.py", "t")], "source_path string, id string")).collect()}
    assert got == {("a", "hit"), ("b", "hit"), ("p", "parent"), ("s", "module")}


def test_files_of_any_name(spark, tmp_path):
    for name, data in {"src/__init__.py": b"", ".github/a.yml": b"a: 1", "_x/.y/z.md": b"# z", "docs/b.md": b"b", "docs/a.md": b"a", "README.md": b"r"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    rows = {r.rel_path: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/__init__.py", ".github/a.yml", "_x/.y/z.md", "docs/b.md", "docs/a.md", "README.md"}
    assert rows["src/__init__.py"].text == "" and rows["src/__init__.py"].reason is None and rows["_x/.y/z.md"].text == "# z"
    seeds = files.seed_files(spark.createDataFrame([(k,) for k in rows], "rel_path string"), 1).orderBy("priority").collect()
    assert [r.rel_path for r in seeds] == ["README.md", "docs/a.md"]
    (tmp_path / "none").mkdir()
    assert files.scan_files(spark, str(tmp_path / "none")).collect() == []
    assert _one(spark, files.line_range(F.col("t"), F.lit(2), F.lit(3)), t="a\npassword = hunter22\nc\nd") == "[REDACTED]\nc"
    assert _one(spark, files.line_range(F.col("t"), F.lit(9), F.lit(3)), t="a") == ""


@pytest.mark.parametrize("full_every", [2, 50])
def test_ingestion_writes_what_changed(spark, tmp_path, full_every):
    schema = "project_id string, source_path string, content_hash string, created_at timestamp, doc_id int"
    batches = [[("p", "a", "h1", 1), ("p", "b", "h1", 2)], [("p", "a", "h1", 3), ("p", "c", "h1", 4)], [("p", "b", "h2", 5)], [("p", "a", "h3", 6), ("p", "a", "h2", 5)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "project_id string, source_path string, content_hash string, doc_id int").withColumn("created_at", F.timestamp_seconds("doc_id"))
        df.select("project_id", "source_path", "content_hash", "created_at", "doc_id").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    read = spark.read.parquet(str(tmp_path / "in"))
    refresh.run_ingestion(refresh.arrivals(spark, str(tmp_path / "in"), read.schema, 1), str(tmp_path / "state"), str(tmp_path / "log"), full_every)
    state = refresh.ingestion_state(spark, str(tmp_path / "state"), read.schema, 4, full_every)
    assert {(r.source_path, r.content_hash) for r in state.collect()} == {("a", "h3"), ("b", "h2"), ("c", "h1")} and schema
    sizes = [spark.read.parquet(str(tmp_path / f"state/v={i}")).count() for i in range(4)]
    assert sizes == ([2, 1, 3, 1] if full_every == 2 else [2, 1, 1, 1])
