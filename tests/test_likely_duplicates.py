"""Many notes of one scope whose words are few: no word may be a key of its own."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.operators import lifecycle


def test_large_scope_of_common_words(spark, monkeypatch):
    rng, n, kinds = random.Random(7), 5000, "abcdefg"
    words = [a + b for a in ("lam", "dor", "fen", "gri", "hol", "jas", "kel", "mun") for b in ("per", "tun", "vik", "zed", "rao", "sil", "bex", "cot")]
    rows = [(f"n{i:04d}", "p", rng.choice(kinds), None, " ".join(rng.sample(words, 4)), " ".join(rng.sample(words, 20))) for i in range(n)]
    rows[10] = (rows[9][0] + "x", "p", "a" if rows[9][2] != "a" else "b", None, *rows[9][4:])  # a copy of another kind: found by the title alone
    monkeypatch.setattr(lifecycle, "BLOCK", 500)  # keys of several blocks
    df = spark.createDataFrame(rows, "id string, project_id string, kind string, module_path string, title string, summary string")
    began = time.time()
    got = {(r.id_a, r.id_b): r.score for r in lifecycle.likely_duplicates(df, df).collect()}
    assert time.time() - began < 90
    place, x = {w: i for i, w in enumerate(words)}, np.zeros((2, n, len(words)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[0, i, [place[w] for w in r[4].split()]] = 1
        x[1, i, [place[w] for w in f"{r[4]} {r[5][:200]}".split() if w in place]] = 1
    shared = [y @ y.T for y in x]
    t, e = (s / (y.sum(1)[:, None] + y.sum(1)[None] - s) for s, y in zip(shared, x))
    kind = np.array([r[2] for r in rows])
    score = np.round(0.6 * np.maximum(t, 0.8 * e) + 0.2 * (kind[:, None] == kind[None]), 4)
    np.fill_diagonal(score, 0)
    true = {(rows[i][0], rows[j][0]): score[i, j] for i, j in zip(*np.nonzero(score > 0.49999))}
    assert set(got) == set(true) and len(true) > 100 and all(abs(got[k] - true[k]) < 1e-4 for k in true)


def test_scores_that_are_rounded_up_to_the_bound(spark):
    title = lambda own: " ".join([f"same{i}" for i in range(2499)] + [f"{own}xx{i}" for i in range(1250 + (own == "b"))])
    df = spark.createDataFrame([("a", "p", "k", None, title("a"), ""), ("b", "p", "k", None, title("b"), "")], "id string, project_id string, kind string, module_path string, title string, summary string")
    # 2499 / 5000 words in common: 0.6 * 0.4998 + 0.2 = 0.49988, 0.4999 rounded; with a bound of 0.4999 the pair counts
    got = lifecycle.likely_duplicates(df, df.select(*df.columns).where(F.col("id") == "b"), 0.4999).collect()
    assert [(r.id_a, r.id_b, r.score) for r in got] == [("a", "b", pytest.approx(0.4999))]
