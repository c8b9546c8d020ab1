"""Keyword-stuffed and link-list pages, by the coherence of neighbouring words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.runtime import cut_lineage, written

#: Words and pairs that make up at least one in so many of all pairs are known to every task; the
#: counts of all others are joined to the texts.
PARTS = 1 << 20
#: Characters of the texts that are looked up together.
GROUP_CHARS = 1 << 22
#: Distances at which the two words of a pair are no neighbours: what a text's words give by chance.
APART = (4, 5, 7)

_URL = re.compile(r"https?://[^\s<>\"')\]]+")
_TAG = re.compile(r"<[^<>\n]{1,300}>")
_FENCE = re.compile(r" {0,3}(?:```|~~~)")
#: Lines of logs, test reports, diffs, tables, code and settings: they say what they say in no sentences.
_FORMAL = re.compile(
    r"""\s*(?:<p>)?(?!\s*https?://)\W?(?:
    \d{4}-\d\d-\d\d[T ]\d\d:\d\d | ={3,} | tests/ | E\s{2,}\w*Error | @@\  | diff\ --git | index\ [0-9a-f]{6,} | [-+]{3}\ [ab]/ | \|.*\|
    | (?:[-+]\s*)? (?: def\  | class\  | import\  | from\ \S+\ import | return\ [\w({\["'] .*[)}\]"'\d] | raise\ \w+\( | log\.\w+\( | for\ \w+\ in\ .*: | with\ .*: | if\ .*:\s*$
        | async\ def | \w+(?:\[.*?\])?(?:,\ \w+)*\ =\  | \w+\["\w+"\] | self\. | \w+\.\w+\( )
    | [\w.-]+:\s*["\w/.-]+\s*$ | [{}] | \$\  )""",
    re.X | re.I,
)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_WORD = _LETTER.copy()
_WORD[[*range(48, 58), 95]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_CODE, _NUMBER = np.uint64(1), np.uint64(2)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(31) + b) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class Lines:
    """A text's running lines, and the characters of its formal lines and of its bare link lines."""

    running: str
    formal: int
    links: int


def read_lines(text: str) -> Lines:
    """Splits a text's characters: formal lines, lines of links without explanation (at most six
    other words a link), and the rest, without markup and addresses."""
    running, formal, links, fenced = [], 0, 0, False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            formal += len(line)
        elif fenced or _FORMAL.match(line):
            formal += len(line)
        elif "http" in line and (found := _URL.findall(line)):
            rest = _TAG.sub(" ", _URL.sub(" ", line))
            if len(re.findall(r"[^\W\d_]+", rest)) <= 6 * len(found):
                links += len(line)
            else:
                running.append(rest)
        else:
            running.append(_TAG.sub(" ", line) if "<" in line else line)
    return Lines("\n".join(running), formal, links)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, end to end, the text of each, and its characters with what
    follows. Names in code (with `_`, digits, inner dots or capitals) are one word, numbers another."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) + 1)
    upper = (raw >= 65) & (raw <= 90)
    low = raw + upper * np.uint8(32)
    inside = _WORD[low]
    dot = np.zeros(len(raw), dtype=bool)
    after = inside[2:] & ((raw[1:-1] == 46) | (raw[1:-1] == 45) & (raw[2:] >= 48) & (raw[2:] <= 57))
    dot[1:-1] = ((raw[1:-1] == 46) | (raw[1:-1] == 45)) & inside[:-2] & after
    run = inside | dot
    edge = np.diff(np.concatenate([[0], run.view(np.int8), [0]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    odd = ~_LETTER[low]
    odd[1:] |= upper[1:] & (low[:-1] == raw[:-1]) & _LETTER[low[:-1]]
    many = np.concatenate([[0], np.cumsum(odd & run)])
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(low * _power(_BASE, len(raw)), out=total[1:])
    h = (total[end] - total[begin]) * _power(_INVERSE, len(raw))[begin]
    digit = (raw[begin] >= 48) & (raw[begin] <= 57)
    h = np.where(digit, _NUMBER, np.where(many[end] > many[begin], _CODE, h))
    owner = np.searchsorted(ends, begin, side="right")
    stop = np.append(begin[1:], len(raw))
    return h, owner, np.minimum(stop, ends[owner]) - begin


def _neighbours(h: np.ndarray, owner: np.ndarray, apart: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words of the same text `apart` words apart, and the places of their first words."""
    at = np.flatnonzero(owner[apart:] == owner[:-apart]) if len(h) > apart else np.empty(0, np.int64)
    return _pair(h[at], h[at + apart]), at


def distinct_texts(texts: DataFrame) -> DataFrame:
    """One row for each distinct text: its hashes a and b, its group g of about `GROUP_CHARS`
    characters, its running lines, and the characters of formal lines, of link lines and in all."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = TaskContext.get().partitionId() << 32
        for batch in batches:
            lines = [read_lines(t) for t in batch["text"]]
            running = [x.running for x in lines]
            size = np.fromiter(map(len, running), dtype=np.int64, count=len(running))
            group = g + np.cumsum(size) // GROUP_CHARS
            links, formal = np.array([x.links for x in lines], dtype=np.int64), np.array([x.formal for x in lines], dtype=np.int64)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "g": group, "running": running, "formal": formal, "links": links, "n_chars": size + formal + links})
            g = int(group[-1]) + 1 if len(group) else g

    each = texts.select("text").distinct().select("text", *_text_key("text"))
    return written(each.mapInPandas(read, "a long, b long, g long, running string, formal long, links long, n_chars long"))


def _text_key(text: str) -> list:
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]


def corpus_counts(texts: DataFrame) -> DataFrame:
    """Counts n of the words and of the pairs of neighbours (k: their hash) over the running lines of
    all texts; k = 0 has the number of pairs. Counts are added up within each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, pairs = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in batches:
            h, owner, _ = tokens(batch["running"].tolist())
            both, _ = _neighbours(h, owner)
            pairs += len(both)
            k, n = np.unique(np.concatenate([h, both]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n])).astype(np.int64)
            if len(keys) > 1_000_000:
                yield pd.DataFrame({"k": keys.view(np.int64), "n": counts})
                keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield pd.DataFrame({"k": np.append(keys, np.uint64(0)).view(np.int64), "n": np.append(counts, pairs)})

    return texts.select("running").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


@dataclass
class Coherence:
    """What is known of the corpus: sorted keys, their counts, and the number of all pairs."""

    keys: np.ndarray
    counts: np.ndarray
    pairs: int

    @classmethod
    def made(cls, found: pd.DataFrame, pairs: int) -> Coherence:
        keys = found["k"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], found["n"].to_numpy(dtype=np.int64)[order], pairs)

    def of(self, k: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(k))
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.counts[at], 0)

    def lacks(self, k: np.ndarray) -> np.ndarray:
        return k[self.of(k) == 0]


def _asked(texts: list[str]) -> np.ndarray:
    """The words and the pairs, of neighbours and apart, whose counts the texts' windows need."""
    h, owner, _ = tokens(texts)
    return np.unique(np.concatenate([h, *(_neighbours(h, owner, apart)[0] for apart in (1, *APART))]))


def measured(texts: DataFrame, window: int) -> DataFrame:
    """The windows of each text: their coherence (delta), numbers of pairs, shares of repeated pairs
    and characters, by the counts over all texts.

    Keys that make up at least 1 / PARTS of all pairs (at most 4 * PARTS, whatever the corpus) are
    broadcast. The other keys of a group of texts are joined to the table of counts, so that no count
    is left out."""
    counted = cut_lineage(corpus_counts(texts))
    pairs = int((counted.where("k = 0").agg(F.sum("n")).first()[0]) or 0)
    least, counted = max(1, pairs // PARTS), counted.where("k <> 0")
    known = counted.where(F.col("n") >= least).toPandas()  # bounded by 4 * PARTS
    shared: Broadcast[Coherence] = texts.sparkSession.sparkContext.broadcast(Coherence.made(known, pairs))

    def measure(part: pd.DataFrame, known: Coherence) -> pd.DataFrame:
        w = windows(part["running"].tolist(), known, window)
        ends = np.cumsum(np.bincount(w.text, minlength=len(part)))[:-1]
        chars = np.bincount(w.window_of, weights=w.chars, minlength=len(w.text)).astype(np.int64)
        kept = {c: part[c].to_numpy() for c in ("a", "b", "formal", "links", "n_chars")}
        arrays = {"delta": w.delta, "pairs": w.pairs, "often": w.repeated, "chars": chars}
        return pd.DataFrame(kept | {"words": w.words, "repeated": w.often} | {k: pd.Series(np.split(x, ends), dtype=object) for k, x in arrays.items()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("g"):
                yield pd.DataFrame({"g": g, "k": shared.value.lacks(_asked(part["running"].tolist())).view(np.int64)})

    def measure_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("g"):
                yield measure(part, shared.value)

    def measure_group(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keys = _asked(part["running"].tolist()).view(np.int64)
        own = pd.DataFrame({"k": keys, "n": shared.value.of(keys.view(np.uint64))})
        return measure(part, Coherence.made(pd.concat([own[own["n"] > 0], found[["k", "n"]].drop_duplicates("k")]), pairs))

    kind = "a long, b long, formal long, links long, n_chars long, words long, repeated double, delta array<double>, pairs array<long>, often array<double>, chars array<long>"
    if least == 1:
        return written(texts.mapInPandas(measure_all, kind))
    asked = texts.select("g", "running").mapInPandas(ask, "g long, k long")
    found = asked.join(counted.where(F.col("n") < least), "k").select("g", "k", "n")
    return written(texts.groupBy("g").cogroup(found.groupBy("g")).applyInPandas(measure_group, kind))


def usual(found: DataFrame) -> tuple[float, float]:
    """The median coherence of the windows of all texts and the median share of their excessively
    repeated pairs, from a histogram."""

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 400), dtype=np.int64)
        for batch in batches:
            pairs = _joined(batch["pairs"])
            for k, x in enumerate((_joined(batch["delta"]), _joined(batch["often"]))):
                counts[k] += np.bincount(np.clip((x[pairs >= 8] + 10) * 20, 0, 399).astype(np.int64), minlength=400)
        yield pd.DataFrame({"kind": np.repeat([0, 1], 400), "bin": np.tile(np.arange(400), 2), "n": counts.ravel()})

    bins = found.select("pairs", "delta", "often").mapInPandas(histogram, "kind long, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas()  # 800 rows

    def median(kind: int, default: float) -> float:
        part = bins[bins["kind"] == kind].sort_values("bin")
        total = part["n"].cumsum()
        if not len(part) or not total.iloc[-1]:
            return default
        return float(part["bin"].iloc[int(np.searchsorted(total, total.iloc[-1] / 2))]) / 20 - 10

    return max(0.5, median(0, 3.0)), max(0.0, median(1, 0.0))


def _joined(arrays: pd.Series) -> np.ndarray:
    return np.concatenate([np.empty(0), *arrays])


@dataclass
class Windows:
    """Windows of the running texts: by window its text, coherence, number of pairs and share of
    excessively repeated pairs; by word its window, text and characters; by text its words and its
    share of repeated pairs."""

    text: np.ndarray
    delta: np.ndarray
    pairs: np.ndarray
    repeated: np.ndarray
    window_of: np.ndarray
    owner: np.ndarray
    chars: np.ndarray
    words: np.ndarray
    often: np.ndarray


def windows(texts: list[str], known: Coherence, window: int) -> Windows:
    """Cuts the texts into windows of about `window` words and measures each one's coherence: how
    much more pointwise mutual information its neighbours have than words of the text that are
    apart. A pair's information is that of the corpus without the text itself."""
    h, owner, chars = tokens(texts)
    near, at = _neighbours(h, owner)
    scope = np.uint64(0x632BE59BD9B4E019)
    own_pair, inverse, own_n = np.unique(near ^ (owner[at].astype(np.uint64) * scope), return_inverse=True, return_counts=True)
    own_word, w_at, w_n = np.unique(h ^ (owner.astype(np.uint64) * scope), return_inverse=True, return_counts=True)
    elsewhere = np.maximum(known.of(h) - w_n[w_at], 0) + 1.0

    def information(pairs: np.ndarray, at: np.ndarray, apart: int, own: np.ndarray) -> np.ndarray:
        joint = np.maximum(known.of(pairs) - own, 0) + 0.3
        return np.clip(np.log(joint * max(known.pairs, 1) / (elsewhere[at] * elsewhere[at + apart])), -6, 8)

    # windows of even length within each text
    words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(words) - words
    n_windows = np.maximum(1, np.round(words / window).astype(np.int64))
    base = np.cumsum(n_windows) - n_windows
    place = np.arange(len(h)) - first[owner]
    w = base[owner] + place * n_windows[owner] // np.maximum(words[owner], 1)
    size = int(n_windows.sum())

    def mean_by(groups: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        count = np.bincount(groups, minlength=n)
        return np.bincount(groups, weights=values, minlength=n) / np.maximum(count, 1), count

    score, n_near = mean_by(w[at], information(near, at, 1, own_n[inverse]), size)
    pairs_of = np.bincount(owner[at], minlength=len(texts))
    thrice = ((own_n[inverse] >= 3) & (own_n[inverse] >= 0.01 * pairs_of[owner[at]])).astype(float)
    repeated, _ = mean_by(w[at], thrice, size)
    often, _ = mean_by(owner[at], thrice, len(texts))
    far_values, far_at = [], []
    for apart in APART:
        far, f_at = _neighbours(h, owner, apart)
        if len(f_at):
            scoped = far ^ (owner[f_at].astype(np.uint64) * scope)
            spot = np.minimum(np.searchsorted(own_pair, scoped), len(own_pair) - 1)
            far_values.append(information(far, f_at, apart, np.where(own_pair[spot] == scoped, own_n[spot], 0)))
            far_at.append(f_at)
    values, places = np.concatenate([np.empty(0), *far_values]), np.concatenate([np.empty(0, np.int64), *far_at])
    chance, n_far = mean_by(w[places], values, size)
    whole, n_whole = mean_by(owner[places], values, len(texts))
    text_of = np.repeat(np.arange(len(texts)), n_windows)
    chance = np.where(n_far >= 12, chance, whole[text_of])
    n_near = np.where(n_whole[text_of] > 0, n_near, 0)
    return Windows(text_of, score - chance, n_near, repeated, w, owner, chars, words, often)


def stuffed_chars(part: pd.DataFrame, usual: float, usual_repeated: float, low: float, low_repeated: float) -> np.ndarray:
    """Characters of the incoherent windows of each text.

    A window is incoherent below `low` of the usual coherence, or below `low_repeated` of it if its
    share of excessively repeated pairs (three times or more and a hundredth of the text) is 0.4 over
    the usual one. Six pairs of usual coherence are added to each window, so that short texts need
    more evidence; texts of fewer than eight words have none."""
    text = np.repeat(np.arange(len(part)), part["pairs"].map(len))
    delta, pairs, often, chars = (_joined(part[c]) for c in ("delta", "pairs", "often", "chars"))
    level = (delta * pairs + usual * 6) / (pairs + 6) / usual
    bad = ((level < low) | ((often >= 0.4 + usual_repeated) & (level < low_repeated))) & (part["words"].to_numpy()[text] >= 8)
    return np.bincount(text, weights=chars * bad, minlength=len(part)).astype(np.int64)


def stuffing(documents: DataFrame, id: str, text: str, window: int = 16, low: float = 0.58, low_repeated: float = 1.2) -> DataFrame:
    """One row per document with text: id, n_chars, link_chars, stuffed_chars (of incoherent word
    windows), repeated (share of word pairs that are repeated excessively), share (of both in all characters) and stuffed (share over a half).

    Coherence is measured against counts of neighbouring words over all distinct texts: each is
    counted and judged once, whatever the number of its copies, and the verdict holds for all of
    them. Texts are read whole. Documents whose formal lines (code, logs, tables, ...) make up half of
    the characters or more cannot be stuffed for more than half. Null and empty texts give no
    row; repeated rows give repeated rows; extra columns are ignored; an empty table gives none."""
    read = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S"))
    found = measured(distinct_texts(read), window)
    usual_delta, usual_repeated = usual(found)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            whole, links = part["n_chars"].to_numpy(), part["links"].to_numpy()
            open_ = part["formal"].to_numpy() * 2 < whole
            bad = stuffed_chars(part, usual_delta, usual_repeated, low, low_repeated) * open_
            share = np.minimum((bad + links) / np.maximum(whole, 1), 1.0)
            yield pd.DataFrame({"a": part["a"], "b": part["b"], "n_chars": whole, "link_chars": links, "stuffed_chars": bad, "repeated": part["repeated"] * open_, "share": share, "stuffed": share > 0.5})

    verdict = found.mapInPandas(judge, "a long, b long, n_chars long, link_chars long, stuffed_chars long, repeated double, share double, stuffed boolean")
    return read.select("id", *_text_key("text")).join(verdict, ["a", "b"]).drop("a", "b")
