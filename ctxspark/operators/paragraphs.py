"""Paragraphs of documents, statements in code, and summaries of modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.functions.text import first_sentence
from ctxspark.operators.chunking import CODE_TOKENS, classified, markdown_chunks, stripped, tokens

#: What makes a comment worth keeping, and what no comment worth keeping begins with.
HIGH_VALUE = r"(?i)shell\s*=\s*False|allowlist|blocklist|must\s+not|never|always|invariant|constraint|security|important|critical|note:"
COMMENT_SKIPS = r"(?i)^(?:type:\s*ignore|noqa|copyright|#!|coding:)"

#: Endings of the names of classes that others work with.
PARTNERS = r"\b([A-Z][a-zA-Z0-9]+(?:Service|Manager|Resolver|Index|Engine|Store|Cache|Repository|Coordinator|Adapter|Handler))\b"

_DOCSTRING = r"""(?s)\"\"\"(.*?)\"\"\"|'''(.*?)'''"""


def paragraph_summary(text: Column) -> Column:
    """The first line of the first docstring if it has more than 10 characters; else the first line that
    is no decorator, import or comment: a signature without its colon, or more than 10 characters. At
    most 200 characters; null if there is none."""
    inside = F.coalesce(F.nullif(F.regexp_extract(text, _DOCSTRING, 1), F.lit("")), F.regexp_extract(text, _DOCSTRING, 2))
    doc = stripped(F.split(stripped(inside), r"\r?\n")[0])
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), stripped), lambda x: (x != "") & ~x.rlike(r"^(?:@|#!|import |from |#)"))
    said = F.transform(
        lines,
        lambda x: F.when(x.rlike(r"^(?:def |async def |class )"), F.when(F.length(F.regexp_replace(x, ":+$", "")) > 5, F.regexp_replace(x, ":+$", ""))).when(F.length(x) > 10, x),
    )
    return F.substring(F.when(F.length(doc) > 10, doc).otherwise(F.try_element_at(F.filter(said, lambda x: x.isNotNull()), F.lit(1))), 1, 200)


def code_paragraphs(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, paragraph_index, heading, symbols, summary, content): what precedes the first top-level
    definition, and each definition; those of more than 1,000 tokens are cut at blank lines. Null
    texts give no row."""
    blocks = F.transform(F.split(F.col(text), r"(?md)(?=^(?:def |class |async def ))"), stripped)
    parts = F.flatten(F.transform(blocks, lambda x: F.when(tokens(x) > CODE_TOKENS, F.transform(F.split(x, r"\n{2,}"), stripped)).otherwise(F.array(x))))
    found = docs.where(F.col(text).isNotNull()).select(id, F.posexplode(F.filter(parts, lambda x: x != "")).alias("paragraph_index", "content"))
    heading = F.nullif(F.regexp_extract("content", r"^(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)", 1), F.lit(""))
    names = F.regexp_extract_all("content", F.lit(r"(?m)^(?:def |async def |class )\s*([A-Za-z_]\w*)"), 1)
    return found.select(id, "paragraph_index", heading.alias("heading"), names.alias("symbols"), paragraph_summary(F.col("content")).alias("summary"), "content")


def markdown_paragraphs(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, paragraph_index, heading, symbols, summary, content): the sections of a text, large ones cut."""
    found = markdown_chunks(docs, id, text)
    heading = F.nullif(F.regexp_extract("heading_path", r"(?:^|.* > )(.*)$", 1), F.lit(""))
    return found.select(id, F.col("chunk_index").alias("paragraph_index"), heading.alias("heading"), F.array().cast("array<string>").alias("symbols"), paragraph_summary(F.col("content")).alias("summary"), "content")


def code_statements(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, kind, statement, normalized, confidence): first sentences of docstrings (0.85), comments
    that say something important (0.78), and raised errors (0.80, always a risk)."""
    all_of = lambda rule, group=0: F.regexp_extract_all(F.col(text), F.lit(rule), group)
    say = lambda xs, base, kind=None: F.transform(xs, lambda x: F.struct(x.alias("s"), F.lit(base).alias("base"), F.lit(kind).cast("string").alias("fixed")))
    docstrings = F.transform(all_of(_DOCSTRING), lambda x: first_sentence(stripped(F.substring(x, F.lit(4), F.length(x) - 6))))
    comments = F.filter(F.transform(all_of(r"(?md)^[ \t]*#[ \t]*([^\n]+)", 1), stripped), lambda x: x.rlike(HIGH_VALUE) & ~x.rlike(COMMENT_SKIPS))
    message = lambda x: F.substring(F.regexp_replace(stripped(F.regexp_extract(x, r"\(([^)]*)\)", 1)), "^[\"']+|[\"']+$", ""), 1, 120)
    name = lambda x: F.regexp_extract(x, r"raise\s+(\w+)", 1)
    raises = F.transform(
        all_of(r"(?md)^[ \t]*raise[ \t]+\w+[ \t]*\([^)]*\)"),
        lambda x: F.when(message(x) != "", F.concat(F.lit("Raises "), name(x), F.lit(": "), message(x))).otherwise(F.concat(F.lit("Raises "), name(x))),
    )
    each = docs.where(F.col(text).isNotNull()).select(id, F.explode(F.concat(say(docstrings, 0.85), say(comments, 0.78), say(raises, 0.80, "risk"))).alias("x")).select(id, "x.*")
    return classified(each, id, 0.99)


def distinct_first(items: Column, most: int) -> Column:
    """The first `most` items of a list that differ, whatever their case, in order."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(items, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(kept, 1, most)


def module_summaries(paragraphs: DataFrame, id: str, name: str) -> DataFrame:
    """(id, summary, key_symbols, partners): one summary for each document from its paragraphs.

    `name` is a column with the module's name. The purpose is the first paragraph's summary, else the
    first headings, else the first symbols, else the name; the first six symbols follow. All of a
    document's paragraphs together are no longer than its text."""
    rows = F.array_sort(F.collect_list(F.struct("paragraph_index", "symbols", "heading", "summary", "content")))
    g = paragraphs.groupBy(id, name).agg(rows.alias("p"))
    symbols = distinct_first(F.flatten(F.transform("p", lambda x: x["symbols"])), 15)
    headings = distinct_first(F.filter(F.transform("p", lambda x: x["heading"]), lambda h: h.isNotNull()), 4)
    partners = distinct_first(F.regexp_extract_all(F.array_join(F.transform("p", lambda x: x["content"]), "\n\n"), F.lit(PARTNERS), 1), 8)
    made = g.select(id, name, F.col("p")[0]["summary"].alias("first"), symbols.alias("key_symbols"), headings.alias("h"), partners.alias("partners"))
    purpose = (
        F.when(F.col("first").isNotNull(), F.col("first"))
        .when(F.size("h") > 0, F.concat(F.lit("Module covering: "), F.array_join("h", ", ")))
        .when(F.size("key_symbols") > 0, F.concat(F.lit("Defines: "), F.array_join(F.slice("key_symbols", 1, 5), ", ")))
        .when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit("Source file: "), F.col(name)))
        .otherwise("Module summary.")
    )
    parts = F.when(F.size("key_symbols") > 0, F.concat(F.lit(" Key components: "), F.array_join(F.slice("key_symbols", 1, 6), ", "), F.lit("."))).otherwise("")
    return made.select(id, F.substring(F.concat(purpose, parts), 1, 800).alias("summary"), "key_symbols", "partners")
