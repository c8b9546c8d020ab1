"""Near-duplicate texts: consistent weighted sampling over TF-IDF shingles, banded, then verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.runtime import cut_lineage, forget, written

#: Counters of the shingles' document frequencies; the same number at every size.
COUNTERS = 1 << 17
#: Characters that are cut into shingles in one go.
_PART = 1 << 19


def parts(texts: list[str]) -> Iterator[slice]:
    """Slices of about `_PART` characters, of one text at least."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "") + 1
        if chars >= _PART:
            yield slice(first, i + 1)
            first, chars = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


#: The characters of words, and an odd base with its inverse modulo 2**64.
_IN_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", dtype=np.uint8))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 19), base, dtype=np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts, end to end, and how many each text has. Words are
    runs of a-z, 0-9 and `_` in the lower-cased text; their hashes are differences of one prefix
    sum over all characters."""
    coded = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) + 1)
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    inside[1:] = _IN_WORD[raw]
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(raw * _power(_BASE, len(raw)), out=total[1:])
    h = (total[end] - total[begin]) * _power(_INVERSE, len(raw))[begin]
    return h, np.diff(np.searchsorted(begin, ends), prepend=0)


def shingles(texts: list[str], size: int, min_words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each `size` consecutive words of the texts, end to end with repeats, and the
    text of each; texts of fewer than `min_words` words, or of `size`, have none."""
    h, lengths = word_hashes(texts)
    if len(h) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        x = _mixed(x + h[k : k + len(x)], k + 1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    kept = (owner[: len(x)] == owner[size - 1 :]) & (lengths[owner[: len(x)]] >= min_words)
    return x[kept].view(np.int64), owner[: len(x)][kept]


def distinct_shingles(texts: list[str], size: int, min_words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, their counts, and how many each text has."""
    x, owner = shingles(texts, size, min_words)
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    first = np.ones(len(x), dtype=bool)
    first[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return x[at], np.diff(np.append(at, len(x))), np.bincount(owner[at], minlength=len(texts))


def shingle_counts(texts: DataFrame, size: int, min_words: int) -> tuple[np.ndarray, int]:
    """Document frequencies of all shingles, in `COUNTERS` counters by their hash, and the number of
    texts. Each task adds up its own counters first; all rows are counted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros(COUNTERS, dtype=np.int64), 0
        for batch in batches:
            every = batch["text"].tolist()
            for part in parts(every):
                s, _, each = distinct_shingles(every[part], size, min_words)
                counts += np.bincount(s & (COUNTERS - 1), minlength=COUNTERS)
                n += np.count_nonzero(each)
        slot = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": np.append(slot, -1).astype(np.int32), "n": np.append(counts[slot], n)})

    rows = texts.select("text").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most COUNTERS + 1 rows
    counts, slot, n = np.zeros(COUNTERS, dtype=np.int64), rows["slot"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
    counts[slot[slot >= 0]] = n[slot >= 0]
    return counts, int(n[slot < 0].sum())


class Weights:
    """TF-IDF weights of shingles: (1 + ln tf) (1 + ln(n / df) / ln n), the second between 1 and 2;
    without `repeats`, tf is 1.

    df is a shingle's counter less the mean of the others, which is what the other shingles of the
    same counter add on average: it is exact in small collections, and in large ones off by a share
    of n that falls as n grows."""

    def __init__(self, counts: np.ndarray, n_texts: int, repeats: bool = True):
        self.repeats = repeats
        others = (counts.sum() - counts) / (len(counts) - 1)
        df = np.clip(counts - others, 1, max(n_texts, 1))
        self.idf = (1 + np.log(max(n_texts, 1) / df) / math.log(max(n_texts, 2))).astype(np.float32)

    def of(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = self.idf[s & (len(self.idf) - 1)]
        return (1 + np.log(tf)) * idf if self.repeats else idf


_quantiles: list[np.ndarray] = []


def _gamma() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution in the middle of 65,536 equal parts of (0, 1)."""
    if not _quantiles:
        u = (np.arange(65_536) + 0.5) / 65_536
        x = np.sqrt(2 * u) + u**8 * 8
        for _ in range(60):
            x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - u) / np.maximum(x * np.exp(-x), 1e-12), x / 2)
        _quantiles.append(x.astype(np.float32))
    return _quantiles[0]


def samples(s: np.ndarray, weight: np.ndarray, starts: np.ndarray, n_samples: int) -> np.ndarray:
    """Improved consistent weighted samples (Ioffe 2010) of the sets that begin at `starts`: an
    n_samples x sets array of 32-bit hashes of the sampled (shingle, t). Two sets agree in a sample
    with the probability of their weighted Jaccard similarity."""
    gamma, log_w = _gamma(), np.log(weight).astype(np.float32)
    log_gamma = np.log(gamma) + np.float32(64)  # the least ln a is far above -64, so that all are positive and ordered as their bits
    low, high = s.astype(np.uint64).astype(np.uint32), (s.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    out, both = np.empty((n_samples, len(starts)), dtype=np.uint32), np.empty((len(s), 2), dtype=np.uint32)
    for k in range(n_samples):
        key = np.uint32(0x9E3779B1 * (k + 1) & 0xFFFFFFFF)
        h = (low ^ key) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h += high
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        g = (h + key) * np.uint32(0x27D4EB2F)
        g ^= g >> np.uint32(15)
        fields = h.view(np.uint16)
        r, log_c = gamma[fields[::2]], log_gamma[fields[1::2]]
        beta = g.astype(np.float32) * np.float32(2**-32)
        t = np.floor(log_w / r + beta)
        beta -= t
        beta -= 1
        beta *= r
        beta += log_c
        both[:, 1] = beta.view(np.uint32)
        np.bitwise_xor(g * np.uint32(0x165667B1), t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1), out=both[:, 0])
        out[k] = np.minimum.reduceat(both.view(np.uint64).ravel(), starts).astype(np.uint32)
    return out


@dataclass
class NearDuplicates:
    """members: source, id, c, class_id for every row with enough words (one row per id and text; c is
    the number of the text, class_id the least id that has it). links: source, a, b (numbers of two
    different texts), class_a, class_b (their class ids, the smaller first), weighted, plain."""

    members: DataFrame
    links: DataFrame


def near_duplicates(
    records: DataFrame,
    source: str,
    id: str,
    text: str,
    shingle_words: int = 5,
    similarity: float = 0.8,
    plain_similarity: float = 0.0,
    min_words: int = 12,
    bands: int = 32,
    rows: int = 3,
    bucket: int = 20,
    repeats: bool = True,
) -> NearDuplicates:
    """Pairs of different texts of the same source whose weighted Jaccard similarity over TF-IDF
    shingles is at least `similarity`, and whose plain Jaccard similarity of the shingle sets is at
    least `plain_similarity`. Without `repeats`, a shingle weighs the same however often a text has
    it: weights then lie between 1 and 2, so that a plain similarity of p is a weighted one of at
    least p / (2 - p).

    Rows with fewer than `min_words` words (null and empty texts too) are in no pair; repeated rows
    and copies form classes and only one text of each is compared. Extra columns are ignored, empty
    tables give empty results. All counts are over all rows.

    A text's `bands * rows` consistent weighted samples are cut into bands; texts that agree in a
    band are compared (at similarity s a pair is missed with (1 - s^rows)^bands). A band's bucket of
    more than `bucket` texts is not compared pair by pair: its texts are joined on the rarest
    shingles, of which two texts that are similar enough must share one (prefix filter), which loses
    none of them.
    """
    key = F.xxhash64("source", F.xxhash64("text"), F.hash("text"))  # one text of a source stands for its copies
    read = records.select(F.col(source).alias("source"), F.col(id).alias("id"), F.col(text).alias("text"))
    read = read.where("source is not null and id is not null and text is not null").withColumn("c", key)
    min_words = max(min_words, shingle_words)
    counts, n_texts = shingle_counts(read, shingle_words, min_words)
    # what every task needs of the corpus: one number for each of COUNTERS counters
    shared = records.sparkSession.sparkContext.broadcast(Weights(counts, n_texts, repeats))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def band_keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Null for a text without enough words, empty for a copy of an earlier one of the batch."""
        nothing = np.empty(0, np.int64)
        for c, batch in batches:
            first = ~c.duplicated().to_numpy()
            every, place = batch[first].tolist(), pd.factorize(c)[0]
            out: list = []
            for part in parts(every):
                s, tf, each = distinct_shingles(every[part], shingle_words, min_words)
                some = np.flatnonzero(each)
                keyed: list = [None] * len(each)
                if len(some):
                    starts = (np.cumsum(each) - each)[some]
                    sig = samples(s, shared.value.of(s, tf), starts, bands * rows).astype(np.uint64).reshape(bands, rows, -1)
                    keys = np.zeros((bands, len(some)), dtype=np.uint64)
                    for b in range(bands):
                        for r in range(rows):
                            keys[b] = _mixed(keys[b] * np.uint64(31) + sig[b, r], b * rows + r + 1)
                    for j, x in zip(some.tolist(), np.ascontiguousarray(keys.T).view(np.int64)):
                        keyed[j] = x
                out += keyed
            yield pd.Series([out[p] if f or out[p] is None else nothing for p, f in zip(place.tolist(), first.tolist())], dtype=object)

    signed = written(read.select("source", "id", "c", band_keys("c", "text").alias("keys")).where("keys is not null"))
    ids = written(signed.select("source", "id", "c").distinct())
    members = ids.join(ids.groupBy("c").agg(F.min("id").alias("class_id")), "c").select("source", "id", "c", "class_id")

    banded = signed.select("c", F.xxhash64("source").alias("x"), F.explode("keys").alias("k")).select("c", F.expr("k ^ x").alias("k")).repartition("k")
    shared_keys = written(_shared(banded))
    forget(signed)
    cool = shared_keys.where(F.col("count") <= bucket)
    any_hot = shared_keys.where(F.col("count") > bucket).limit(1).count() > 0
    pairs = cool.select("k", F.col("c").alias("a")).join(cool.select("k", F.col("c").alias("b")), "k").where("a < b").select("a", "b")
    if any_hot:
        least = max(plain_similarity, similarity / 4)  # weights lie between 1 and 2 for each count
        crowd = shared_keys.where(F.col("count") > bucket).select("c").distinct()
        pairs = pairs.union(_prefix_pairs(read.join(crowd, "c", "left_semi"), shingle_words, least))
    pairs = cut_lineage(pairs.distinct())
    forget(shared_keys)

    # texts travel instead of their shingles: they compress
    texts = read.groupBy("c").agg(F.first("source").alias("source"), F.min("id").alias("id"), F.first("text").alias("text"))
    right = pairs.join(texts.select(F.col("c").alias("a"), "source", F.col("id").alias("id_a"), F.col("text").alias("text_a")), "a")
    both = right.join(texts.select(F.col("c").alias("b"), F.col("source").alias("source_b"), F.col("id").alias("id_b"), F.col("text").alias("text_b")), "b")
    both = both.where("source = source_b")

    @F.pandas_udf(T.StructType([T.StructField("weighted", T.DoubleType()), T.StructField("plain", T.DoubleType())]))
    def compare(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np.concatenate([np.empty((0, 2)), *(compare_some(left.iloc[i : i + 300], right.iloc[i : i + 300]) for i in range(0, len(left), 300))]), columns=["weighted", "plain"])

    def compare_some(left: pd.Series, right: pd.Series) -> np.ndarray:
        n, scope = len(left), np.uint64(0xC2B2AE3D27D4EB4F)
        (x, x_tf, x_each), (y, y_tf, y_each) = distinct_shingles(left.tolist(), shingle_words), distinct_shingles(right.tolist(), shingle_words)
        x_of, y_of = np.repeat(np.arange(n), x_each), np.repeat(np.arange(n), y_each)
        wx, wy = shared.value.of(x, x_tf), shared.value.of(y, y_tf)
        own = lambda s, of: s.view(np.uint64) ^ (of.astype(np.uint64) * scope)
        _, at, to = np.intersect1d(own(x, x_of), own(y, y_of), assume_unique=True, return_indices=True)
        kept = x_of[at] == y_of[to]
        at, to = at[kept], to[kept]
        total = lambda of, w: np.bincount(of, weights=w, minlength=n)
        both, common = total(x_of[at], np.minimum(wx[at], wy[to])), np.bincount(x_of[at], minlength=n)
        weighted = both / np.maximum(total(x_of, wx) + total(y_of, wy) - both, 1e-12)
        return np.stack([weighted, common / np.maximum(x_each + y_each - common, 1)], axis=1)

    links = both.select("source", "a", "b", F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b"), compare("text_a", "text_b").alias("x"))
    links = links.select("source", "a", "b", "class_a", "class_b", "x.*")
    return NearDuplicates(members, links.where((F.col("weighted") >= similarity) & (F.col("plain") >= plain_similarity)))


def _shared(banded: DataFrame) -> DataFrame:
    """The distinct (c, k) of keys that more than one text has, and how many those are (count).

    banded: c, k, with repeats, partitioned by k; both readings share its one exchange. Most keys have
    one text: they go by the least and greatest c, in one number-only aggregate, and the few that are
    left are the built side of a hash join, so that neither sorts nor distinct rows of all keys are needed."""
    several = banded.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("k")
    left = banded.join(several.hint("shuffle_hash"), "k", "left_semi").distinct()
    return left.select("k", "c", F.count("*").over(Window.partitionBy("k")).alias("count"))


def _prefix_pairs(texts: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs of texts that may have a plain Jaccard similarity of at least `least`: each text's
    shingles are ordered from rare to common, and two such texts share one among their first
    n - ceil(least n) + 1."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = batch["text"].tolist()
            for part in parts(every):
                s, _, each = distinct_shingles(every[part], size)
                yield pd.DataFrame({"c": np.repeat(batch["c"].to_numpy()[part], each), "n": np.repeat(each, each), "s": s ^ np.repeat(batch["x"].to_numpy()[part], each)})

    once = texts.groupBy("c").agg(F.first("text").alias("text"), F.xxhash64(F.first("source")).alias("x"))
    every = written(once.mapInPandas(explode, "c long, n long, s long"))
    df = every.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.coalesce("df", F.lit(1)), "s"))
    ordered = every.join(df, "s", "left").withColumn("place", place)
    rare = cut_lineage(ordered.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & F.col("df").isNotNull()).select("c", "n", "s"))
    forget(every)
    other = rare.select(F.col("c").alias("b"), F.col("n").alias("m"), "s")
    close = (F.col("a") < F.col("b")) & (F.least("n", "m") >= least * F.greatest("n", "m"))
    return rare.withColumnRenamed("c", "a").join(other, "s").where(close).select("a", "b")


def similar_pairs(found: NearDuplicates) -> DataFrame:
    """All pairs of different ids (id_a < id_b) that are linked or have the same text."""
    x = found.members.select("source", F.col("c").alias("a"), F.col("id").alias("x"))
    y = found.members.select(F.col("c").alias("b"), F.col("id").alias("y"))
    linked = found.links.select("a", "b").join(x, "a").join(y, "b").where("x <> y").select("source", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    same = x.join(y, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("source", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return linked.union(same).distinct()
