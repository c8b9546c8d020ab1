"""Chunks, propositions and log windows of documents, as expressions over each row's whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import first_sentence, normalized

#: Most tokens of a section, a code block and a log window.
SECTION_TOKENS, CODE_TOKENS, LOG_TOKENS = 1200, 1000, 600

#: Kinds of statements, in order, with what each adds to the confidence.
STATEMENT_KINDS = [
    ("security_rule", 0.15, r"(?i)shell\s*=\s*False|allowlist|blocklist|deny.?list|sanitiz|redact|credential|secret|token|auth(?:entication|orization)|permission|injection|XSS|SQL.inject|CSRF|path.traversal|symlink"),
    ("constraint", 0.10, r"(?i)\b(?:must(?:\s+not)?|cannot|can't|never|always|required|forbidden|prohibited|shall(?:\s+not)?|do\s+not|don't)\b"),
    ("architecture", 0.05, r"(?i)\b(?:architect(?:ure)?|design\s+pattern|separation|interface|abstraction|layer|boundary|contract|invariant|schema|protocol)\b"),
    ("decision", 0.05, r"(?i)\b(?:decided?|chose?|using\s+\w+\s+instead|replaced?|migrat(?:ed?|ing)|rationale|reason\s+(?:for|we)|prefer(?:red?)?)\b"),
    ("risk", 0.05, r"(?i)\braises?\b|\bthrows?\b|\bexcept(?:ion)?\b|\bfails?\b|\bpanic\b|\bdegrade\b|\bfall.?back\b"),
    ("test_evidence", 0.0, r"(?i)\bassert\b|\bverif(?:y|ies|ied)\b|\btest\b|\bexpect(?:ed)?\b|\bshould\b"),
    ("procedure", 0.0, r"(?i)\bstep\s+\d|how\s+to\b|\bworkflow\b|\bprocedure\b|\bprocess\b|first\s*,?\s*then|\brun\b|\bexecute\b|\binvoke\b"),
]

_BLANK = r"^[\s\u0085  ]*$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def packed(text: Column, most: int) -> Column:
    """Parts of a text of at most `most` tokens where its paragraphs allow it: paragraphs (split at
    blank lines) are joined in order while they fit."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))
    joined = lambda acc, p: stripped(F.concat(acc["now"], F.lit("\n\n"), p))
    walk = F.aggregate(
        F.split(text, r"\n\n+"),
        start,
        lambda acc, p: F.when(acc["now"] == "", F.struct(p.alias("now"), acc["done"].alias("done")))
        .when(tokens(joined(acc, p)) > most, F.struct(p.alias("now"), F.concat(acc["done"], F.array(stripped(acc["now"]))).alias("done")))
        .otherwise(F.struct(joined(acc, p).alias("now"), acc["done"].alias("done"))),
        lambda acc: F.filter(F.concat(acc["done"], F.array(stripped(acc["now"]))), lambda x: x != ""),
    )
    return F.when(tokens(text) <= most, F.array(text)).otherwise(walk)


def _numbered(rows: DataFrame, id: str, parts: Column) -> DataFrame:
    return rows.select(id, F.posexplode(F.filter(parts, lambda x: x != "")).alias("chunk_index", "content"))


def markdown_chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, chunk_index, heading_path, content): one chunk a heading section, large ones packed by
    paragraphs. Text before the first heading is dropped; a text without headings is one section.
    Null and blank texts give no row."""
    sections = F.split(F.col(text), r"(?md)(?=^#{1,6}\s)")
    headed = lambda x: x.rlike(r"^#{1,6}\s")
    kept = F.when(F.exists(sections, headed), F.filter(sections, headed)).otherwise(F.array(F.col(text)))
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})", 1))
    title = lambda x: stripped(F.regexp_extract(x, r"^#{1,6}\s+([^\n]*)", 1))
    part = lambda path, x: F.transform(packed(stripped(x), SECTION_TOKENS), lambda c: F.struct(path.alias("path"), c.alias("content")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("stack"), F.array().cast("array<struct<path:array<string>,content:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stack = F.when(headed(x), F.concat(F.slice(acc["stack"], 1, level(x) - 1), F.array(title(x)))).otherwise(none)
        return F.struct(stack.alias("stack"), F.concat(acc["out"], part(stack, x)).alias("out"))

    parts = F.aggregate(kept, start, step, lambda acc: F.filter(acc["out"], lambda y: y["content"] != ""))
    found = docs.where(F.col(text).isNotNull()).select(id, F.posexplode(parts).alias("chunk_index", "x"))
    return found.select(id, "chunk_index", F.array_join("x.path", " > ").alias("heading_path"), F.col("x.content").alias("content"))


def code_chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, chunk_index, symbols, content): a chunk for what precedes the first top-level definition
    and for each of them, large ones packed."""
    blocks = F.split(F.col(text), r"(?md)(?=^(?:def |class |async def ))")
    parts = F.flatten(F.transform(blocks, lambda x: packed(stripped(x), CODE_TOKENS)))
    found = _numbered(docs.where(F.col(text).isNotNull()), id, parts)
    names = F.regexp_extract_all("content", F.lit(r"(?m)^(?:def |async def |class )\s*([A-Za-z_]\w*)"), 1)
    return found.select(id, "chunk_index", F.array_join(names, " ").alias("symbols"), "content")


def report_chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, chunk_index, symbols, content): sections of a test report, begun by a result or rule line."""
    marks = r"(?md)(?=^(?:PASSED|FAILED|ERROR|test_[A-Za-z0-9_]+|={5,}|-{5,}|FAILURES))"
    found = _numbered(docs.where(F.col(text).isNotNull()), id, F.transform(F.split(F.col(text), marks), stripped))
    return found.select(id, "chunk_index", F.array_join(F.regexp_extract_all("content", F.lit(r"(test_[A-Za-z0-9_]+)"), 1), " ").alias("symbols"), "content")


def diff_chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, chunk_index, module_path, content): the hunks of each file of a diff."""
    files = F.filter(F.split(F.col(text), r"(?md)^diff --git "), lambda x: ~x.rlike(_BLANK))
    module = lambda f: F.regexp_replace(F.regexp_replace(F.regexp_extract(f, r"b/(\S+)", 1), "/", "."), r"\.py$", "")
    hunks = F.flatten(
        F.transform(files, lambda f: F.transform(F.filter(F.split(f, r"(?md)^@@ "), lambda h: ~h.rlike(_BLANK)), lambda h: F.struct(module(f).alias("m"), stripped(F.concat(F.lit("@@ "), h)).alias("c"))))
    )
    found = docs.where(F.col(text).isNotNull()).select(id, F.posexplode(hunks).alias("chunk_index", "x"))
    return found.select(id, "chunk_index", F.col("x.m").alias("module_path"), F.col("x.c").alias("content"))


def log_windows(docs: DataFrame, id: str, text: str, around: int = 3) -> DataFrame:
    """(id, start_line, end_line, part_no, content): stretches of lines within `around` lines of an
    error or warning, those of more than 600 tokens cut at their blank lines. A log without any is one
    piece without line numbers; null and blank texts give no row."""
    known = docs.where(F.col(text).isNotNull())
    lines = known.select(id, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("i", "line"))
    error = F.col("line").rlike(r"(?i)ERROR|WARN|CRITICAL|EXCEPTION|Traceback").cast("int")
    near = F.max(error).over(Window.partitionBy(id).orderBy("i").rowsBetween(-around, around))
    kept = lines.withColumn("near", near).where("near = 1")
    island = kept.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy(id).orderBy("i")))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    windows = island.groupBy(id, "island").agg((F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), text_of.alias("content"))
    quiet = known.where(~F.col(text).rlike(r"(?i)ERROR|WARN|CRITICAL|EXCEPTION|Traceback"))
    none = F.lit(None).cast("int")
    every = windows.select(id, "start_line", "end_line", "content").unionByName(quiet.select(id, none.alias("start_line"), none.alias("end_line"), F.col(text).alias("content")))
    # only windows are cut: a log without any stays whole
    pieces = F.when(F.col("start_line").isNull(), F.array(stripped(F.col("content")))).otherwise(packed(stripped(F.col("content")), LOG_TOKENS))
    return every.select(id, "start_line", "end_line", F.posexplode(F.filter(pieces, lambda x: x != "")).alias("part_no", "content"))


def _worthless(text: Column) -> Column:
    return ~F.length(text).between(12, 350) | text.rlike(r"^(?:import|from)\s+\w") | text.rlike(r"^[\s\d.,;:!?()-]+$")


def classified(each: DataFrame, id: str, cap: float) -> DataFrame:
    """(id, kind, statement, normalized, confidence) of (id, s, base, fixed): what says nothing is
    dropped, the rest is classified by the first matching kind unless it has a fixed one; one row per
    document and normalized text, the surest."""
    kind, delta = F.lit("implementation_detail"), F.lit(0.0)
    for name, more, rule in reversed(STATEMENT_KINDS):
        hit = F.col("s").rlike(rule)
        kind, delta = F.when(hit, name).otherwise(kind), F.when(hit, more).otherwise(delta)
    sure = F.when(F.col("fixed").isNotNull(), F.col("base")).otherwise(F.least(F.col("base") + delta, F.lit(cap)))
    named = each.where(~_worthless(F.col("s"))).select(id, F.coalesce("fixed", kind).alias("kind"), F.col("s").alias("statement"), normalized(F.col("s")).alias("normalized"), F.round(sure, 2).alias("confidence"))
    best = F.max_by(F.struct("kind", "statement", "confidence"), F.struct("confidence", "statement", "kind"))
    return named.groupBy(id, "normalized").agg(best.alias("b")).select(id, "b.kind", "b.statement", "normalized", "b.confidence")


def statements(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, kind, statement, normalized, confidence): first sentences of bullets (0.72), of numbered
    items (0.70) and of other lines that forbid, demand or protect something (0.68); one row per
    document and normalized text.

    Items too short (under 12) or too long (over 350 characters), imports, and items of punctuation
    and numbers alone are dropped."""
    items = lambda rule, base: F.transform(F.regexp_extract_all(F.col(text), F.lit(rule), 1), lambda x: F.struct(stripped(x).alias("s"), F.lit(base).alias("base")))
    rules = {name: rule for name, _, rule in STATEMENT_KINDS}
    lines = F.filter(F.transform(F.split(F.col(text), r"\r?\n"), stripped), lambda x: ~x.rlike(r"^(?:[#*•-]|$)") & (x.rlike(rules["constraint"]) | x.rlike(rules["security_rule"])))
    prose = F.transform(lines, lambda x: F.struct(x.alias("s"), F.lit(0.68).alias("base")))
    every = F.concat(items(r"(?md)^[ \t]*[-*•][ \t]+([^\n]+)", 0.72), items(r"(?md)^[ \t]*\d+[.)][ \t]+([^\n]+)", 0.70), prose)
    each = docs.where(F.col(text).isNotNull()).select(id, F.explode(every).alias("x")).select(id, "x.s", "x.base")
    kept = each.where((F.col("base") == 0.68) | ~_worthless(F.col("s")))
    return classified(kept.select(id, first_sentence(F.col("s")).alias("s"), "base", F.lit(None).cast("string").alias("fixed")), id, 0.95)
