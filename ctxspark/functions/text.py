"""Text expressions of the engine: words, terms, symbols, overlaps, token estimates, redaction."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no terms of the bag-of-words model.
STOP_WORDS = [
    "a", "an", "the", "is", "in", "it", "of", "to", "and", "or", "for", "be", "on", "at", "as", "by", "with", "that", "this", "was", "are", "from", "its", "i", "we", "they", "not", "no", "but", "if", "has",
    "have", "had", "do", "did", "will", "would", "should", "could", "been", "more", "into", "also", "when", "what", "which", "so",
]

#: Words that are no keywords of a request.
KEYWORD_STOPS = [
    "the", "and", "for", "that", "this", "with", "from", "have", "not", "are", "its", "was", "has", "been", "will", "can", "but", "what", "how", "does", "any", "add", "fix", "get", "let", "use", "set", "put", "run", "out", "our", "all", "new",
]

#: The ordered patterns of redaction (Java syntax, applied one after another).
REDACTIONS = [
    r"(?s)-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |)(?:PRIVATE KEY|CERTIFICATE)-----.*?-----END[^-]+-----",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"\b(ghp|ghs|gho|ghu|github_pat|glpat)_[A-Za-z0-9_]{20,}\b",
    r"\b(AKIA|ASIA|AROA|AIPA|ANPA|ANVA|APKA)[A-Z0-9]{16}\b",
    r"(?i)(?:aws_secret_access_key|aws_session_token)\s*[=:]\s*\S+",
    r"(?i)(?:Bearer|Authorization:?\s*(?:Bearer|Basic|Token))\s+[A-Za-z0-9_.+/=\-]{8,}",
    r"[a-zA-Z][a-zA-Z0-9+\-.]*://[^:@\s]+:[^@\s]{4,}@[^\s]+",
    r"""(?i)(?:password|passwd|secret|api[_\-]?key|auth[_\-]?token|access[_\-]?token|private[_\-]?key)\s*[=:]\s*['"]?([^\s'"]{6,})""",
    r"\b[0-9a-fA-F]{40,}\b",
]

#: Opposing words; texts on both sides of a row contradict each other.
OPPOSITES = [
    (["must", "always", "required", "mandatory", "never"], ["optional", "may", "can", "allowed", "sometimes"]),
    (["synchronous", "blocking", "sequential"], ["asynchronous", "async", "concurrent", "parallel"]),
    (["immutable", "readonly", "constant"], ["mutable", "writable", "modifiable"]),
    (["deprecated", "removed", "deleted"], ["active", "current", "supported"]),
    (["atomic", "transaction", "rollback"], ["eventual", "best-effort", "idempotent"]),
]


def word_set(text: Column, longer_than: int = 2) -> Column:
    """Distinct lower-cased words (Unicode) of more than `longer_than` characters; null for null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than)))


def terms(text: Column) -> Column:
    """Terms of the bag-of-words model, with repeats: `[a-z][a-z0-9_]*`, no stop words, two or more characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9_]*)"), 1)
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def _accents() -> tuple[str, str]:
    """Letters with accents and the letters without, by canonical decomposition: Latin, Greek, Cyrillic."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()

#: Characters that a search request drops, and words that are its operators.
REQUEST_DROPS, REQUEST_OPERATORS = '"-:()^*~', ["and", "or", "not"]


def folded(text: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"[\u0300-\u036f]", "")


def lexical_terms(text: Column) -> Column:
    """Terms of the lexical index, with repeats: runs of letters and digits of any script, lower case
    and without accents; `_` parts words. Terms are not stemmed."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def request_terms(text: Column) -> Column:
    """Terms that a request asks for, any of which may match: its words without the characters of the
    query language, less its operators."""
    words = F.split(F.translate(text, REQUEST_DROPS, ""), r"\s+")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(REQUEST_OPERATORS))
    return F.array_distinct(lexical_terms(F.array_join(kept, " ")))


def snippet(text: Column, wanted: Column, words: int = 20) -> Column:
    """`words` words of the text around the first that contains a wanted term; the beginning if none does."""
    each = F.split(F.trim(text), r"\s+")
    at = F.coalesce(F.array_min(F.filter(F.transform(wanted, lambda t: F.array_position(F.transform(each, lambda w: F.try_element_at(lexical_terms(w), F.lit(1))), t)), lambda p: p > 0)), F.lit(1))
    return F.array_join(F.slice(each, F.greatest(at.cast("int") - words // 2, F.lit(1)), words), " ")


def first_sentence(text: Column) -> Column:
    """The text's stripped lines on one line, up to a sentence's end before a capital."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: x != "")
    return F.trim(F.element_at(F.split(F.array_join(lines, " "), r"(?<=[.!?])\s+(?=[A-Z])", 2), 1))


def hashed_terms(text: Column, buckets: int = 384) -> Column:
    """A vector of `buckets` numbers: counts of the text's terms by hash, of length 1 (all 0 for none)."""
    slots = F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  # evaluates `value` once
    counted = lambda found: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.size(F.filter(found, lambda x: x == i)).cast("double"))
    norm = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda counts: once(norm(counts), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return once(slots, lambda found: once(counted(found), scaled))


#: How reliable a kind of source is; a path that has the name of one counts as it.
SOURCE_QUALITY = {"adr": 1.0, "architecture_doc": 0.95, "api_spec": 0.9, "readme": 0.85, "code_file": 0.8, "test_report": 0.75, "manual_note": 0.7, "markdown": 0.7, "task_artifact": 0.65, "code_comment": 0.65, "git_diff": 0.6, "runtime_log": 0.5}


def source_quality(kind: Column) -> Column:
    """Quality of a kind of source, 0.5 if unknown."""
    worth: Column = F.lit(0.5)
    for name, x in SOURCE_QUALITY.items():
        worth = F.when(kind == name, x).otherwise(worth)
    return worth


def path_quality(path: Column) -> Column:
    """Quality of a source by the first kind its path names, else 0.7 for code and 0.6; 0.5 without a path."""
    worth: Column = F.when(F.lower(F.regexp_extract(path, r"([^.]*)$", 1)).isin("py", "ts", "js"), 0.7).otherwise(0.6)
    for name, x in reversed(SOURCE_QUALITY.items()):
        worth = F.when(F.contains(F.lower(path), F.lit(name)), x).otherwise(worth)
    return F.when(F.coalesce(path, F.lit("")) == "", 0.5).otherwise(worth)


def keywords(text: Column, most: int = 20) -> Column:
    """The first `most` distinct keywords of a request, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\b[a-z]\w*\b)"), 1)
    return F.slice(F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(KEYWORD_STOPS))), 1, most)


def symbols(text: Column) -> Column:
    """Distinct CamelCase and snake_case names, the former first."""
    camel = F.regexp_extract_all(text, F.lit(r"(\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b)"), 1)
    snake = F.regexp_extract_all(text, F.lit(r"(\b[a-z]+(?:_[a-z]+)+\b)"), 1)
    return F.array_distinct(F.concat(camel, snake))


def normalized(text: Column) -> Column:
    """Trimmed, lower case, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def token_estimate(text: Column) -> Column:
    """Four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def module_prefixes(path: Column) -> Column:
    """Dotted module of a path and all its prefixes, shortest first."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"[/\\]", "."), r"\.py$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Share of the first set that is in the second; 0 if either is empty or null."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def redact(text: Column) -> tuple[Column, Column]:
    """The text after all redactions in order, and the number of replacements."""
    count: Column = F.lit(0)
    for rule in REDACTIONS:
        count = count + F.regexp_count(text, F.lit(rule))
        text = F.regexp_replace(text, rule, "[REDACTED]")
    return text, count


def contradicts(a: Column, b: Column) -> Column:
    """Whether one text has a word of one side of an opposition and the other text one of its other side."""
    x, y = word_set(a, 0), word_set(b, 0)
    has = lambda words, side: F.arrays_overlap(words, F.array(*[F.lit(w) for w in side]))
    either: Column = F.lit(False)
    for one, other in OPPOSITES:
        either = either | (has(x, one) & has(y, other)) | (has(y, one) & has(x, other))
    return either


#: States that a search leaves out unless it asks for them, and scopes that all branches see.
HIDDEN_STATES, SHARED_SCOPES = ["stale", "archived", "superseded", "deleted"], ["global", "mainline"]


def visible_rows(state: str, kind: str, branch_name: str, branch_scope: str, kinds: list[str] | None = None, branch: str | None = None, states: list[str] | None = None) -> Column:
    """Whether a search may see a row: its state is one of `states` (any but the hidden ones if null),
    its kind one of `kinds` (any if null), and, where a branch is given, the row belongs to that
    branch, to none, or to all."""
    shown = F.col(state).isin(states) if states is not None else F.coalesce(~F.col(state).isin(HIDDEN_STATES), F.lit(True))
    if kinds is not None:
        shown = shown & F.col(kind).isin(kinds)
    if branch is not None:
        shown = shown & (F.col(branch_name).isNull() | (F.col(branch_name) == branch) | F.col(branch_scope).isNull() | F.col(branch_scope).isin(SHARED_SCOPES))
    return shown


def preview(text: Column, chars: int = 400) -> Column:
    """The text's first characters, with a mark if there are more."""
    return F.when(F.length(text) > chars, F.concat(F.regexp_replace(F.substring(text, 1, chars), r"\s+$", ""), F.lit("\u2026"))).otherwise(text)


def result_title(title: Column, headings: Column) -> Column:
    """A hit's title: its document's (`Unknown` without one), and the headings above it if they say more."""
    doc, path = F.coalesce(title, F.lit("Unknown")), F.coalesce(F.array_join(headings, " > "), F.lit(""))
    return F.when((path == "") | (path == doc), doc).otherwise(F.concat(doc, F.lit(": "), path))
