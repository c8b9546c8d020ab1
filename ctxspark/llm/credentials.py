"""Credentials in source code, configuration, logs and notes: found by a linear-chain CRF."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.llm.credential_lines import training_texts
from ctxspark.llm.crf import BEGIN, FEATURES, INSIDE, Crf

#: Made-up texts that the model is trained on, and passes over them.
TRAINING_TEXTS = 8_000
PASSES = 6

_KEY_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
_KEY_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_KEY_BODY = re.compile(r"(?:(?:\\n|\r?\n)[ \t>+-]*[A-Za-z0-9+/=]{16,})*")
#: Stands for each character of a key block while a text is cut into tokens.
_IN_KEY = "\ue000"
_LEX = re.compile(
    r"""(?P<pem>\ue000+)
    |(?P<pieces>(?<!")"[^"\n]*"(?:[ \t]*\\?\+?[ \t]*\r?\n[+-]?[ \t]*\+?[ \t]*"[^"\n]*")+|(?<!')'[^'\n]*'(?:[ \t]*\\?\+?[ \t]*\r?\n[+-]?[ \t]*\+?[ \t]*'[^'\n]*')+)
    |"(?P<double>(?![^"\s]*://)[^"\s\ue000]+)"|'(?P<single>(?![^'\s]*://)[^'\s\ue000]+)'
    |(?P<sign>[-+](?=\ue000))
    |(?:(?<=:)//|(?<![\w/.@-]))[\w.+-]*:(?P<user>(?!//)[^\s@"']+)@(?=[\w-]+\.[\w.-])
    |(?P<word>[^\s"'`<>=:;,&(){}\[\]|\ue000]*[^\s"'`<>=:;,&(){}\[\]|.\ue000]={1,2}(?=[\s"'`<;,&]|$)|[^\s"'`<>=:;,&(){}\[\]|\ue000]*[^\s"'`<>=:;,&(){}\[\]|.\ue000])
    |(?P<mark>\S)""",
    re.X,
)
_NAME = re.compile(r"pass(?!ed|es\b|ing|ive|age)|pwd|(?:^|_)pw$|secret|token|(?:api|access|signing|licen[cs]e|private|encryption|client|auth|master|service|storage|account)[._-]?key|kennwort|contrase|clave|senha|parola|has[lł]o|wachtwoord|l[öo]senord|heslo|şifre|jelsz[óo]|пароль|密码|密碼|パスワード|비밀번호|credential|bearer|^basic$|^sig(?:nature)?$|[?&]key$|[?&]sig$|_key$|^identified$|auth(?:$|[._-])", re.I)
_OTHER_NAME = re.compile(r"tokens|token_?(?:count|bucket|type|limit)|bucket|length|min_|max_|cache_?key|public|sha\d|etag|integrity|digest|checksum|commit|(?:^|_)id$|revision|fingerprint|^reset_|primary_key|foreign|partition|sort_key|expir|_url$|_path$|_file$|_name$|rotat", re.I)
_PLACEHOLDER = re.compile(r"^(?:<.*>?|\$.*|%\w+%?|\{.*|x{3,}|X{3,}|\*{3,}|\.{3,}|•+|change[_-]?me|todo|fixme|example\w*|null|none|nil|true|false|undefined|your[_-].*|dummy|placeholder|redacted|masked|test|secret|password|os\.environ.*|os\.getenv.*|process\.env.*|read_\w+|vault\w*|env|getenv)$", re.I)
_SHAPES = {
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "jwt": r"eyJ[\w-]+\.[\w-]+(?:\.[\w-]+)?",
    "issued": r"AKIA[A-Z0-9]{12,}|gh[pousr]_\w{8,}|glpat-[\w-]{8,}|xox[abprs]-[\w-]+|[a-z]{2,5}_(?:live|prod|test)_\w{8,}|AIza[\w-]{20,}|npm_\w{20,}|hf_\w{20,}|pypi-[\w-]{20,}|dop_v1_\w{20,}|SG\.[\w.-]{20,}",
    "version": r"v?\d+(?:\.\d+)+",
    "number": r"[\d.,_-]+",
    "hex40": r"(?=.*\d)[0-9a-fA-F]{32,}",
    "hex": r"(?=.*\d)[0-9a-fA-F]{7,31}",
    "hashed": r"sha\d+-.*",
    "words1": r"[a-z]+(?:-[a-z]+)+-\d+",
    "lower1": r"[a-z]+\d{2,}",
    "strong": r"(?=.*[A-Za-z])(?=.*\d)(?=.*[!?%#+@$^*~])[\w!?%#+@$^*~./-]{6,}",
    "strong0": r"(?=.*[A-Za-z])(?=.*[!?%#+$^*~])[\w!?%#+@$^*~./-]{6,}",
    "dashed": r"[a-z]+(?:-[a-z]+)+",
    "lower": r"[a-zà-ÿ]+",
    "upper": r"[A-Z]+",
    "title": r"[A-Z][a-z]+",
    "name": r"[A-Za-z]+(?:_[A-Za-z]+)+",
    "dotted": r"[A-Za-z_]+(?:\.[A-Za-z_]+)+",
    "base64": r"[A-Za-z0-9+/]{8,}={1,2}",
    "mixed": r"(?=.*[a-z])(?=.*[A-Z])(?=.*\d)[A-Za-z0-9._+/-]+",
    "camel": r"(?:[A-Z][a-z]+){2,}",
    "letters": r"[A-Za-z]+",
    "digits1": r"(?=.*\d)(?=.*[A-Za-z])[\w.+/-]+",
    "path": r"[\w.-]*/[\w./-]*",
}
_SHAPE = re.compile("|".join(f"(?P<{name}>(?:{rule})$)" for name, rule in _SHAPES.items()))
_RUNS = re.compile(r"[a-z]+|[A-Z]+|\d+|[^a-zA-Z\d]+")
_KINDS = {k: i - 1 for k, i in _LEX.groupindex.items()}
_NONE, _SECRET, _OTHER, _PLAIN, _ABOVE = range(5)
#: Parts of names that ask for a secret, in several languages.
_ASKING = [
    "pass", "pwd", "pw", "secret", "token", "key", "kennwort", "contrase", "clave", "senha", "parola", "haslo", "hasło", "wachtwoord", "losenord", "lösenord", "heslo", "şifre", "jelsz", "пароль", "密码", "密碼", "パスワード", "비밀번호", "credential",
    "bearer", "basic", "sig=", "sig:", 'sig"', "signature", "identified", "auth",
]
#: Classes of characters: other, lower, upper, digit, sign, joiner, beyond ASCII.
_CLASS = np.zeros(129, dtype=np.uint16)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[ord(c) for c in "!?#%$^*+~@"]], _CLASS[[ord(c) for c in "-_."]], _CLASS[128] = 1, 2, 3, 4, 5, 6
#: Three characters in a row that no plain word or number has: letters next to digits, mixed case, a sign inside.
_ODD = np.zeros(512, dtype=bool)
for _a, _b, _c in np.ndindex(8, 8, 8):
    _letter, _word = (1, 2, 6), (1, 2, 3, 5, 6)
    _ODD[_a * 64 + _b * 8 + _c] = (
        (_a in _letter and _b == 3) or (_a == 3 and _b in _letter) or (_a == 1 and _b == 2) or (_a in _word and _b == 4 and (_c in _word or _c == 4)) or (_a in _letter and _b == 5 and _c == 3)
    )
_PART = 1 << 20  # characters that are looked at in one go


def open_lines(texts: list[str]) -> list[list[int]]:
    """Where the lines begin that may hold a credential: those with letters next to digits, mixed
    case or a sign inside a word, a key block, or part of a name that asks for a secret. All other
    lines are plain words and numbers that nothing asks for."""
    joined = "\n".join(texts) + "\n"
    small = joined.lower()
    if len(small) != len(joined):
        small = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
    hits, breaks = [], []
    for at in range(0, len(joined), _PART):
        part = np.frombuffer(joined[at : at + _PART + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = _CLASS[np.minimum(part, 128)]
        hits.append(at + np.flatnonzero(_ODD[c[:-2] * 64 + c[1:-1] * 8 + c[2:]]))
        breaks.append(at + np.flatnonzero(part[:_PART] == 10))
    for name in (*_ASKING, _IN_KEY):
        found, at = [], small.find(name)
        while at >= 0:
            found.append(at)
            at = small.find("\n", at)  # once a line
            at = small.find(name, at) if at >= 0 else -1
        hits.append(np.array(found, dtype=np.int64))
    newline = np.concatenate(breaks)
    line = np.unique(np.searchsorted(newline, np.concatenate(hits)))
    starts = np.where(line > 0, newline[np.maximum(line, 1) - 1] + 1, 0)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(first, starts, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    local = starts - first[owner]
    return [local[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def shape(token: str) -> str:
    if _PLACEHOLDER.match(token):
        return "placeholder"
    found = _SHAPE.match(token)
    return found.lastgroup if found else "other"


@lru_cache(maxsize=1 << 16)
def _about(kind: int, word: str) -> tuple[int, int, int, int, int, int, int]:
    """Shape, lower-cased word or shape, role, size, changes of character class, mark and leading
    dash of a token: numbers that its features are made of."""
    if kind == _KINDS["mark"] or kind == _KINDS["sign"]:
        s = low = zlib.crc32(word.encode("utf-8", "replace"))
        return s, low, _NONE, 0, 0, s & 0xFFFF, 0
    if kind == _KINDS["pem"]:
        name = "public" if re.match(r"-----BEGIN (?:[A-Z0-9 ]*PUBLIC KEY|CERTIFICATE)", word) else "private"
    elif kind == _KINDS["pieces"]:
        name = "pieces:" + shape(re.sub(r"[\"'].*?[\"']", "", word, flags=re.S))
    else:
        name = shape(word)
    s = zlib.crc32(name.encode())
    low = zlib.crc32(word.lower().encode("utf-8", "replace")) if len(word) < 20 and word.isalpha() else s
    role = _NONE
    if _OTHER_NAME.search(word):
        role = _OTHER
    elif len(word) < 60 and _NAME.search(word) and name not in ("issued", "jwt", "base64", "mixed"):
        role = _SECRET
    elif name in ("name", "dotted"):
        role = _PLAIN  # if a sign of assignment follows
    n = len(word)
    changes = len(_RUNS.findall(word, 0, 64)) - 1
    size = 1 if n < 4 else 2 if n < 8 else 3 if n < 16 else 4 if n < 32 else 5
    return s, low, role, size, min(changes, 3) if changes < 8 else 4, 119, int(word.startswith("-"))


def _masked(text: str) -> tuple[str, dict[int, tuple[int, str]]]:
    """The text with key blocks blotted out, and each block's end and first characters by its start.

    A block goes from its first to its last dash, whatever its length; one that is not closed before
    the next begins, or at all, goes on over the lines of its body. One pass, each search goes on
    where the last one stopped."""
    if "-----BEGIN " not in text:
        return text, {}
    out, blocks, done, closing = [], {}, 0, _KEY_END.finditer(text)
    end = next(closing, None)
    heads = list(_KEY_HEAD.finditer(text))
    for i, head in enumerate(heads):
        if head.start() < done:
            continue
        while end is not None and end.start() < head.end():
            end = next(closing, None)
        following = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        if end is not None and end.start() < following:
            stop = end.end()
        else:
            stop = _KEY_BODY.match(text, head.end()).end()
        out += [text[done : head.start()], _IN_KEY * (stop - head.start())]
        blocks[head.start()] = (stop, head[0])
        done = stop
    return "".join(out) + text[done:], blocks


def _waits(text: str, kinds: list[int], starts: list[int], ends: list[int]) -> bool:
    """Whether a line of at most four words ends in a name that asks for a secret, so that its value
    may stand in the next line."""
    words = [i for i, k in enumerate(kinds) if k != _KINDS["mark"]]
    if not 1 <= len(words) <= 4 or kinds[words[-1]] == _KINDS["pem"]:
        return False
    if _about(kinds[words[-1]], text[starts[words[-1]] : ends[words[-1]]])[2] != _SECRET:
        return False
    return text[starts[words[-1]]] not in "$<{*%" and all(text[a] in ":\"'>=,`" for a in starts[words[-1] + 1 :])


@dataclass
class Tokens:
    """Tokens of the decoded lines of some texts, end to end: text, kind, start and end, what
    `_about` says of each; by line its number of tokens, and whether a name above waits for a value,
    a password is piped in, curl is called, a netrc machine is named."""

    text: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    about: np.ndarray
    lengths: np.ndarray
    line: np.ndarray


def read_tokens(texts: list[str | None], every_line: bool = False) -> Tokens:
    """Cuts the texts' lines into tokens. A key block or a value in adjacent string pieces is one
    token and may go over several lines. Lines that are plain words (see `open_lines`) are left out
    unless a name in the line above waits for its value."""
    owner, kinds, starts, ends, about, lengths, lines = [], [], [], [], [], [], []
    seen: dict[tuple[int, str], int] = {}  # kinds and words of these texts, by number
    pem, pieces = _KINDS["pem"], _KINDS["pieces"]
    masked = [_masked(t or "") for t in texts]
    lines_of = None if every_line else open_lines([t for t, _ in masked])
    for i, (text, blocks) in enumerate(masked):
        done, waits, size = 0, -1, len(text)
        todo = iter(() if every_line else lines_of[i])
        while done < size:
            start = done
            if not every_line and waits != done:
                start = next((x for x in todo if x >= done), size)
                if start >= size:
                    break
            stop = text.find("\n", start)
            stop = size if stop < 0 else stop
            while stop < size and text[max(start, stop - 40) : stop].rstrip("\r \t").endswith(("\\", "(", " =")):  # goes on in the next line
                following = text.find("\n", stop + 1)
                stop = size if following < 0 else following
            before = len(kinds)
            for m in _LEX.finditer(text, start):
                if m.start() >= stop:
                    break
                kind = m.lastindex - 1  # the groups are in the order of the kinds
                a, b = m.span(kind + 1)
                if kind == pieces:
                    a, b = a + 1, b - 1
                if kind == pem:
                    b, word = blocks.get(a, (b, ""))
                else:
                    word = text[a:b]
                kinds.append(kind)
                starts.append(a)
                ends.append(b)
                about.append(seen.setdefault((kind, word), len(seen)))
            n = len(kinds) - before
            if n:
                stop = max(stop, ends[-1])
                line = text[start:stop]
                bare = line.lstrip("-+ ")
                lines.append((waits == start, "-stdin" in line, bare.startswith("curl"), "machine" in line))
                lengths.append(n)
                owner += [i] * n
                open_end = n <= 12 and _waits(text, kinds[before:], starts[before:], ends[before:])
            else:
                open_end = waits == start
            done = stop + 1
            waits = done if open_end else -1
    table = np.array([_about(*x) for x in seen], dtype=np.int64).reshape(-1, 7)
    return Tokens(
        np.array(owner, dtype=np.int64), np.array(kinds, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64),
        table[np.array(about, dtype=np.int64)], np.array(lengths, dtype=np.int64), np.array(lines, dtype=np.int64).reshape(-1, 4),
    )


def features(t: Tokens) -> Iterator[np.ndarray]:
    """Hashed shape and context features of the tokens: one array a feature."""
    n = len(t.kind)
    line = np.repeat(np.arange(len(t.lengths)), t.lengths)
    first = np.repeat(np.cumsum(t.lengths) - t.lengths, t.lengths)
    last = first + t.lengths[line] - 1
    here = np.arange(n)
    shape_, low, role, size, changes, mark, dash = t.about.T
    above, stdin, curl, machine = (x[line] for x in t.line.T)

    def beside(values: np.ndarray, by: int, outside: int) -> np.ndarray:
        at = here + by
        inside = (at >= first) & (at <= last)
        return np.where(inside, values[np.where(inside, at, 0)], outside)

    b0, b1, b2, a0, a1 = (beside(low, k, 1 if k < 0 else 2) for k in (-1, -2, -3, 1, 2))
    equals, colon = zlib.crc32(b"="), zlib.crc32(b":")
    is_mark = (t.kind == _KINDS["mark"]) | (t.kind == _KINDS["sign"])
    role = np.where((role == _PLAIN) & ~np.isin(beside(np.where(is_mark, shape_, 0), 1, 0), (equals, colon)), _NONE, role)
    # the last name before each token of its line, and what stands between
    place = np.maximum.accumulate(np.where(role != _NONE, here, -1)) if n else here
    named = np.where(here > 0, place[here - 1], -1) if n else here
    named = np.where(named >= first, named, -1)
    name = np.where(named >= 0, role[named], np.where(above == 1, _ABOVE, _NONE))
    since = np.minimum(np.where(named >= 0, here - named - 1, np.where(above == 1, here - first, 9)), 6)
    marks = np.zeros(n, dtype=np.int64)
    for k in (3, 2, 1):
        at = here - k
        marks = np.where(at > np.maximum(named, first - 1), marks * 31 + mark[np.maximum(at, 0)], marks)
    secret = np.maximum.accumulate(np.where(role == _SECRET, here, -1)) if n else here
    secret = np.where(here > 0, secret[here - 1], -1) if n else here
    flag = np.where(secret >= first, dash[secret], 0)
    quoted = np.isin(t.kind, (_KINDS["double"], _KINDS["single"]))
    is_dash, final = b0 == zlib.crc32(b"-"), here == last
    s, k, near = shape_, t.kind, name * 8 + since
    columns = [
        (s,), (k,), (s, size), (k, s), (b0,), (a0,), (b0, s), (a0, s), (b1, b0), (b1, b0, s), (b2, b1, b0), (a0, a1), (near,), (near, s), (name, marks), (name, marks, s), (name, k, s), (quoted, s, size),
        (stdin, quoted, s), (curl, s, b0), (machine, s, b0), (flag, s), (is_dash, final, s), (changes, size), (changes, size, near), (changes, s, b0), (final, here == first, s, size),
    ]
    for i, parts in enumerate(columns):
        h = np.full(n, (i + 1) * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for p in parts:
            h = (h ^ p.astype(np.uint32)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        yield (h & np.uint32(FEATURES - 1)).astype(np.int32)


@lru_cache(maxsize=1)
def trained(n: int = TRAINING_TEXTS) -> Crf:
    made = training_texts(n)
    t = read_tokens([text for text, _ in made], every_line=True)
    labels = np.zeros(len(t.kind), dtype=np.int64)
    bounds = np.searchsorted(t.text, np.arange(len(made) + 1))
    for i, (_, spans) in enumerate(made):
        at = slice(bounds[i], bounds[i + 1])
        for a, b in spans:
            hit = bounds[i] + np.flatnonzero((t.start[at] < b) & (t.end[at] > a))
            labels[hit], labels[hit[:1]] = INSIDE, BEGIN
    return Crf.fit(np.stack(list(features(t)), axis=1), labels, t.lengths, PASSES)


def spans(texts: list[str | None], model: Crf) -> list[list[tuple[int, int]]]:
    """(start, end) of the credentials of each text."""
    t = read_tokens(texts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(t.kind):
        return out
    labels = model.decode(model.emissions(list(features(t))), t.lengths)
    line = np.repeat(np.arange(len(t.lengths)), t.lengths)
    before = -1
    for j in np.flatnonzero(labels).tolist():
        found = out[t.text[j]]
        if labels[j] == INSIDE and before == line[j] and found:
            found[-1] = (found[-1][0], int(t.end[j]))
        else:
            found.append((int(t.start[j]), int(t.end[j])))
        before = line[j]
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("n_chars", T.IntegerType())]))


def credential_spans(text: Column, model: Crf) -> Column:
    """Places of the literal credentials of a text, each with 0-based offset and length in
    characters; an empty list for null, empty and harmless texts. Whole texts are read."""

    @F.pandas_udf(_SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            out: list = []
            for at in range(0, len(part), 500):
                found = spans(part.iloc[at : at + 500].tolist(), model)
                out += [[{"start_pos": a, "n_chars": b - a} for a, b in x] for x in found]
            yield pd.Series(out, dtype=object)

    return find.asNondeterministic()(text)  # not to be run again for a filter on its result


def redacted(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span replaced by `mark` and every other character kept."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    walk = F.aggregate(
        found,
        start,
        lambda acc, x: F.struct(
            F.concat(acc["done"], F.substring(text, acc["at"] + 1, x["start_pos"] - acc["at"]), F.lit(mark)).alias("done"), (x["start_pos"] + x["n_chars"]).alias("at")
        ),
    )
    return F.when(F.size(found) == 0, text).otherwise(F.concat(walk["done"], F.substring(text, walk["at"] + 1, F.length(text))))


def credentials(records: DataFrame, text: str, training: int = TRAINING_TEXTS) -> DataFrame:
    """`records` with `spans`: the places of the credentials in `text`.

    The CRF is trained on `training` made-up texts (a fixed bound, the same at every size) on the
    driver and sent to the tasks. Rows, nulls and other columns are kept as they are."""
    return records.withColumn("spans", credential_spans(F.col(text), trained(training)))
