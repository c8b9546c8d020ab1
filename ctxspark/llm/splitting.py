"""Splitting oversized texts at block boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as one token, by the engine's own estimate.
CHARS_PER_TOKEN = 4

_HEADING = re.compile(r"(#{1,6}) (.*)")
_FENCE = re.compile(r" {0,3}(```|~~~)")

PIECES = T.StructType(
    [
        T.StructField("boundaries", T.ArrayType(T.IntegerType())),
        T.StructField(
            "pieces",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("piece_no", T.IntegerType()),
                        T.StructField("start_offset", T.IntegerType()),
                        T.StructField("end_offset", T.IntegerType()),
                        T.StructField("token_count", T.IntegerType()),
                        T.StructField("cut", T.StringType()),
                        T.StructField("heading_path", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def outline(text: str) -> tuple[list[int], list[int], list[tuple[int, int, str]]]:
    """Offsets of the lines that begin a block, of all lines, and the headings (offset, level, text).

    A block begins at offset 0, at a heading, at a line that opens a fence, and at a non-blank line
    after a blank one or after a closing fence; nothing begins inside a fence."""
    blocks, lines, headings = [0], [], []
    offset, fence, after_gap = 0, "", False
    for line in text.split("\n"):
        at, offset = offset, offset + len(line) + 1
        lines.append(at)
        line = line[:-1] if line.endswith("\r") else line
        bare = line.strip(" \t")
        if fence:
            if bare == fence:
                fence, after_gap = "", True
            continue
        opened, head = _FENCE.match(line), _HEADING.match(line)
        if at and bare and (after_gap or opened or head):
            blocks.append(at)
        if head:
            headings.append((at, len(head[1]), head[2].strip()))
        fence, after_gap = opened[1] if opened else "", not bare
    return blocks, lines, headings


def cuts(length: int, blocks: list[int], lines: list[int], max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of the pieces of a text of `length` characters.

    Token offsets are a prefix sum: `CHARS_PER_TOKEN` characters a token. A piece ends at the last
    block boundary under the limit (binary search), else at the last line, else hard at the limit;
    the next one starts `overlap_tokens` before that cut. A cut must leave more than the overlap."""
    most, back = CHARS_PER_TOKEN * max_tokens + CHARS_PER_TOKEN - 1, CHARS_PER_TOKEN * overlap_tokens
    out, start = [], 0
    while length - start > most:
        limit = start + most
        end, kind = limit, "hard"
        for name, offsets in (("block", blocks), ("line", lines)):
            found = offsets[bisect_right(offsets, limit) - 1]
            if found > start + back:
                end, kind = found, name
                break
        out.append((start, end, kind))
        start = end - back
    return [*out, (start, length, "end")]


def _split_one(text: str, base: list[str] | None, max_tokens: int, overlap_tokens: int) -> dict:
    blocks, lines, headings = outline(text)
    pieces, path, h = [], [] if base is None else [x for x in base if x is not None], 0
    for i, (start, end, kind) in enumerate(cuts(len(text), blocks, lines, max_tokens, overlap_tokens)):
        while h < len(headings) and headings[h][0] <= start:
            path = [*path[: headings[h][1] - 1], headings[h][2]]
            h += 1
        tokens = max(1, (end - start) // CHARS_PER_TOKEN)
        pieces.append({"piece_no": i, "start_offset": start, "end_offset": end, "token_count": tokens, "cut": kind, "heading_path": path})
    return {"boundaries": blocks, "pieces": pieces}


def split_oversized(df: DataFrame, text: str, headings: str, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """The rows of `df` whose text has more than `max_tokens` tokens, with `boundaries` (offsets of
    the lines that begin a block) and `pieces` (number, offsets, tokens, kind of cut, heading path).

    Each piece has at most `max_tokens` tokens and starts `overlap_tokens` before the end of the one
    before it; the heading path is the row's own, carried on by the headings before the piece's
    start. Null and short texts give no row, all other columns and repeated rows are kept. Only
    oversized rows reach Python, whole. ValueError if the overlap is not below the limit."""
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap must be under the limit")

    @F.pandas_udf(PIECES)
    def split(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_split_one(t, p, max_tokens, overlap_tokens) for t, p in zip(texts, paths)], columns=["boundaries", "pieces"])

    large = df.where(F.floor(F.length(text) / CHARS_PER_TOKEN) > max_tokens)
    return large.withColumn("_split", split(F.col(text), F.col(headings))).select(*df.columns, "_split.boundaries", "_split.pieces")
