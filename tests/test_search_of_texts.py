"""Search that hands on only what may be among the best: as the search over postings; ties stay whole."""

import random

import numpy as np
from pyspark.sql import functions as F

from ctxspark.functions.text import lexical_terms
from ctxspark.operators import search


def test_places_of_the_best():
    raw = np.array([0.5, 0.9, 0.5, 0.50004, 0.1, 0.5])
    assert sorted(search.best_places(raw, 3, 1e-4).tolist()) == [0, 1, 2, 3, 5] and sorted(search.best_places(raw, 2, 1e-4).tolist()) == [0, 1, 2, 3]
    assert search.best_places(np.zeros(100), 4, 1e-4).tolist() == [0, 1, 2, 3]


def test_texts_as_postings(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(rng.choice("pq"), f"t{i:03d}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(300)] + [("p", "empty", ""), ("p", "null", None), (None, "x", "w1")]
    texts = spark.createDataFrame(rows, "project_id string, id string, text string")
    asked = spark.createDataFrame([(i, rng.choice(["p", "q", "r", None]), " ".join(rng.sample(words, 2))) for i in range(30)], "request int, scope string, text string")
    old = search.bm25(search.postings(texts, "project_id", "id", "text", lexical_terms), asked, 5)
    assert {tuple(r) for r in search.bm25_texts(texts, asked, 5).select(*old.columns).collect()} == {tuple(r) for r in old.collect()}
    assert search.bm25_texts(texts.where(F.lit(False)), asked, 5).collect() == []
