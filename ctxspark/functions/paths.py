"""Path and digest expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Composed (NFC) form. Only texts with a non-ASCII character are sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def plain_path(path: Column) -> Column:
    """Spelling of a path below the project root: `/` between segments, no empty, `.` or `..`
    segment, NFC characters; `..` above the root stays at the root. Letter case is kept."""
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(F.regexp_replace(path, r"\\", "/"), "/"),
        start,
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(start))
        .otherwise(F.concat(acc, F.array(s))),
    )
    # most paths are plain already and skip the fold
    spelled = F.when(path.rlike(r"\\|//|(^|/)\.{0,2}(/|$)"), F.array_join(kept, "/")).otherwise(path)
    return nfc(spelled)


def plain_digest(digest: Column) -> Column:
    """Value of a digest: no blanks, no algorithm label (`sha256:`), lower case; blank is null."""
    value = F.regexp_replace(F.lower(F.regexp_replace(digest, r"\s+", "")), r"^[a-z0-9_-]+[:=]", "")
    return F.when(value != "", value)
