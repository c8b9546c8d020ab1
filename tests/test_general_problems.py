import random

import pytest
from pyspark.sql import functions as F

from ctxspark.functions.paths import plain_digest, plain_path
from ctxspark.operators.hierarchy import NODE_SCHEMA, descendants, hierarchies
from ctxspark.plans.general import manifest_changes

MANIFEST = "project_id string, snapshot_no int, rel_path string, content_hash string, size long, mtime double, index_status string, delivered_at timestamp, g string, before string"


def test_plain_path(spark):
    cases = {
        "a/b.py": "a/b.py",
        ".\\a\\b.py": "a/b.py",
        "a//./c/../b.py": "a/b.py",
        "../../a": "a",
        "/a/b/": "a/b",
        "A/b": "A/b",
        "café/x": "café/x",
        "..": "",
        "": "",
        None: None,
        "a..b/.c": "a..b/.c",
    }
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", plain_path(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in got} == cases


def test_plain_digest(spark):
    got = spark.createDataFrame([("SHA256: AB cd",), ("abcd",), ("",), (None,)], "p string").select(plain_digest(F.col("p")).alias("q")).collect()
    assert [r.q for r in got] == ["abcd", "abcd", None, None]


def _changes(spark, rows, snapshots):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = [(*r, t, "x", "y") for r in rows]
    return sorted(tuple(r) for r in manifest_changes(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(snapshots, "project_id string, snapshot_no int, h string")).collect())


def test_snapshot_changes(spark):
    rows = [
        ("p", 1, "a", "h1", 1, 1.0, "indexed"),
        ("p", 1, "b", "h1", 1, 1.0, "indexed"),
        ("p", 1, "b", "h0", 1, None, "indexed"),  # the greatest mtime counts, null is least
        ("p", 3, "./a", "H1", 1, 9.0, "indexed"),  # touched
        ("p", 3, "b", "h2", 1, 1.0, "stale"),
        ("p", 3, "b", "h2", 1, 1.0, "stale"),  # repeated
        ("p", 3, "c", "h2", None, 1.0, "indexed"),
        ("p", 4, "c", "h2", None, 1.0, "indexed"),
        ("p", 4, "c", None, None, 2.0, "deleted"),
        ("p", 2, "z", "h", 1, 1.0, "indexed"),  # not listed
        (None, 1, "a", "h", 1, 1.0, "indexed"),
        ("p", 4, None, "h", 1, 1.0, "indexed"),
        ("p", 4, "b", None, 1, 1.0, "indexed"),  # digest lost
    ]
    listed = [("p", 1, ""), ("p", 3, ""), ("p", 4, ""), ("p", 4, ""), ("p", 5, ""), ("q", 1, "")]
    assert _changes(spark, rows, listed) == [
        ("p", 3, "b", "changed"),
        ("p", 3, "c", "new"),
        ("p", 4, "a", "deleted"),
        ("p", 4, "b", "changed"),
        ("p", 4, "c", "deleted"),
        ("p", 5, "b", "deleted"),
    ]
    assert _changes(spark, [], listed) == []
    assert _changes(spark, rows, []) == []


def _expected(parents):
    out = {}
    for k in parents:
        path, at = [k], parents[k]
        while at is not None and at not in path:
            path.insert(0, at)
            at = parents[at]
        if at is None:
            out[k] = (path[0], len(path) - 1)
        else:
            ring = path[: path.index(at) + 1]
            out[k] = (min(ring), -1 if k in ring else -2)
    return out


@pytest.mark.parametrize("largest", [200_000, 3])
def test_hierarchies(spark, largest):
    rng = random.Random(7)
    parents = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(60)}
    parents |= {"c1": "c3", "c2": "c1", "c3": "c2", "d": "c2", "e": "d", "self": "self", "f": "self", "alone": None}
    parents |= {f"deep{i}": f"deep{i - 1}" if i else None for i in range(40)}
    links = [(k, v, 1) for k, v in parents.items() if v is not None]
    links += [("n5", "gone", 1), ("gone", "n5", 1), (None, "n1", 1), ("n1", None, 1)] + links[:5]
    nodes = spark.createDataFrame([(k, "x") for k in [*parents, *list(parents)[:7], None]], "key string, parent string")
    walked = hierarchies(nodes, spark.createDataFrame(links, "child string, parent string, key int"), nodes_per_task=30, largest=largest)
    rows = walked.collect()
    assert {r.key: (r.root_key, r.depth) for r in rows} == _expected(parents) and len(rows) == len(parents)
    by = {r.key: r for r in rows}
    assert by["deep39"].path == [f"deep{i}" for i in range(40)] and by["deep0"].n_descendants == 39
    assert by["e"].path == ["c2", "d", "e"] and by["d"].n_descendants == 1
    assert [by[k].n_descendants for k in ("c1", "c2", "c3", "self", "f", "alone")] == [4, 4, 4, 1, 0, 0]
    assert {r.key for r in rows if r.back_edge} == {"c1", "self"}
    assert descendants(walked).where("ancestor = 'deep10'").count() == 29


def test_hierarchies_of_nothing(spark):
    empty = spark.createDataFrame([], "key string"), spark.createDataFrame([], "child string, parent string")
    assert hierarchies(*empty).collect() == [] and NODE_SCHEMA


@pytest.mark.parametrize("largest", [200_000, 1000])
def test_a_chain_of_any_length(spark, largest):
    n = 200_000 if largest == 200_000 else 3000
    nodes = spark.range(n).selectExpr("format_string('k%07d', id) as key")
    links = spark.range(1, n).selectExpr("format_string('k%07d', id) as child", "format_string('k%07d', id - 1) as parent")
    got = hierarchies(nodes, links, largest=largest, paths=False)
    assert "path" not in got.columns
    wrong = got.where(f"root_key <> 'k0000000' or depth <> int(substring(key, 2)) or n_descendants <> {n - 1} - depth or back_edge")
    assert got.count() == n and wrong.count() == 0


def test_long_paths_are_not_gathered_in_one_task(spark):
    nodes = spark.range(300).selectExpr("format_string('k%03d', id) as key")
    links = spark.range(1, 300).selectExpr("format_string('k%03d', id) as child", "format_string('k%03d', id - 1) as parent")
    got = {r.key: r for r in hierarchies(nodes, links, longest=1000).collect()}
    assert got["k299"].path == [f"k{i:03d}" for i in range(300)] and got["k010"].n_descendants == 289 and len(got) == 300
