"""Files of a source tree as rows: what may be indexed, of what type and language, and the text."""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import redact
from ctxspark.runtime import written

#: Directories and files that are never indexed, and the largest file.
SKIPPED_DIRS = [".git", "node_modules", ".venv", "venv", "env", "dist", "build", "target", "coverage", ".coverage", "vendor", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs"]
SECRET_DIRS = [".aws", ".gcp", ".azure", "secrets", "private", ".ssh", "credentials"]
SECRET_FILES = [".env", ".env.local", ".env.production", ".env.staging", "id_rsa", "id_ed25519", "id_ecdsa", "secrets.json", "credentials.json", "service_account.json", ".DS_Store", "Thumbs.db"]
SECRET_ENDINGS = ["pem", "key", "p12", "pfx"]
BINARY_ENDINGS = [
    "pyc", "pyo", "pyd", "so", "dll", "dylib", "a", "lib", "o", "obj", "class", "jar", "war", "ear", "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "mp3", "mp4", "avi", "mov", "mkv", "wav", "ttf", "otf", "woff", "woff2", "db", "sqlite", "sqlite3", "lock",
]
LARGEST = 5 * 1024 * 1024

#: Source type and language by file ending.
SOURCE_TYPES = {
    "md": "markdown", "rst": "markdown", "txt": "manual_note", "py": "code_file", "ts": "code_file", "tsx": "code_file", "js": "code_file", "jsx": "code_file", "go": "code_file",
    "rs": "code_file", "java": "code_file", "rb": "code_file", "sh": "code_file", "yaml": "api_spec", "yml": "api_spec", "json": "api_spec", "toml": "api_spec", "log": "runtime_log",
    "diff": "git_diff", "patch": "git_diff",
}
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "rb": "ruby",
    "sh": "bash", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "md": "markdown",
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ending(path: Column) -> Column:
    """Lower-cased file ending without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def _looked_up(key: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def source_type(path: Column) -> Column:
    """readme, then adr, then architecture_doc by name, else by ending, else manual_note."""
    name = F.lower(file_name(path))
    return (
        F.when(name.isin("readme.md", "readme.rst", "readme.txt", "readme"), "readme")
        .when(F.lower(path).contains("adr"), "adr")
        .when(name.contains("architecture") | (name == "arch.md"), "architecture_doc")
        .otherwise(_looked_up(ending(path), SOURCE_TYPES, "manual_note"))
    )


def language(path: Column) -> Column:
    return F.when(path.isNull(), "unknown").otherwise(_looked_up(ending(path), LANGUAGES, "unknown"))


def refusal(path: Column, length: Column, head: Column) -> Column:
    """Why a file is not indexed, or null. `head` is the beginning of its bytes, in hexadecimal."""
    parts = F.split(path, "/")
    within = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    zero = F.regexp_like(head, F.lit("^(?:..)*?00"))
    return (
        F.when(path.rlike(r"(^|/)\.\.(/|$)") | path.contains("\0"), "outside")
        .when(within(SKIPPED_DIRS) | path.rlike(r"(^|/)[^/]*\.egg-info(/|$)"), "excluded directory")
        .when(within(SECRET_DIRS), "secret directory")
        .when(file_name(path).isin(SECRET_FILES) | ending(path).isin(SECRET_ENDINGS), "excluded file")
        .when(length > LARGEST, "too large")
        .when(ending(path).isin(BINARY_ENDINGS) | zero, "binary")
    )


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if re.match(r"[a-z][a-z0-9+.-]*:/", root) else (fs.LocalFileSystem(), root)


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all files below `root`, whatever their names, empty ones too.

    Directories are listed in tasks, level by level, so that no names go through the driver."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, _ = _file_system(root)
        for batch in batches:
            for folder in batch["path"]:
                found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                rows = [(x.path, x.size or 0, x.mtime, x.type == fs.FileType.Directory) for x in found if x.type in (fs.FileType.File, fs.FileType.Directory)]
                yield pd.DataFrame(rows, columns=["path", "size", "mtime", "folder"]).astype({"size": "int64", "folder": bool})

    level = spark.createDataFrame([(_file_system(root)[1].rstrip("/"),)], "path string")
    levels = []
    while True:
        found = written(level.mapInPandas(entries, "path string, size long, mtime timestamp, folder boolean"))
        levels.append(found.where("not folder").drop("folder"))
        level = found.where("folder").select("path")
        n = level.count()
        if n == 0:
            return reduce(DataFrame.unionByName, levels)
        level = level.repartition(min(n, 200))


def scan_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """All files below `root`: rel_path, size, mtime, reason (null if indexable), source_type,
    language, content_hash (SHA-256 of the bytes) and text (UTF-8, undecodable bytes replaced; null
    if not indexable). `pattern` is a glob of file names. Empty
    files and names that begin with a dot or an underscore count as any other. Each file is read in a
    task, one at a time."""
    base = _file_system(root)[1].rstrip("/")
    files = listed_files(spark, root).withColumn("rel_path", F.expr(f"substring(path, {len(base) + 2})"))
    if pattern:
        files = files.where(file_name(F.col("path")).rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _file_system(root)
        for batch in batches:
            for row in batch.itertuples(index=False):
                digest, kept = hashlib.sha256(), []
                with system.open_input_stream(row.path) as f:
                    while part := f.read(1 << 20):
                        digest.update(part)
                        if row.size <= LARGEST or not kept:
                            kept.append(part)
                whole = b"".join(kept)
                text = whole.decode("utf-8", "replace") if row.size <= LARGEST else None
                yield pd.DataFrame([(row.rel_path, row.size, row.mtime, whole[:512].hex(), digest.hexdigest(), text)], columns=["rel_path", "size", "mtime", "head", "content_hash", "text"])

    found = files.repartition("path").mapInPandas(read, "rel_path string, size long, mtime timestamp, head string, content_hash string, text string")
    judged = found.withColumn("reason", refusal(F.col("rel_path"), F.col("size"), F.col("head")))
    return judged.select(
        "rel_path", "size", "mtime", "reason", source_type(F.col("rel_path")).alias("source_type"), language(F.col("rel_path")).alias("language"), "content_hash", F.when(F.col("reason").isNull(), F.col("text")).alias("text")
    )


#: Files that say most about a repository, and folders of such files.
SEED_FILES = ["README.md", "ARCHITECTURE.md", "CONTRIBUTING.md", "pyproject.toml", "package.json", "go.mod", "Cargo.toml"]
SEED_FOLDERS = ["docs", "adr", "rfcs"]


def seed_files(files: DataFrame, each: int = 50) -> DataFrame:
    """(rel_path, priority): the fixed files first, then the first `each` markdown files of each of the
    fixed folders, by name. files: rel_path."""
    fixed = F.array_position(F.array(*[F.lit(n) for n in SEED_FILES]), F.col("rel_path"))
    folder = F.array_position(F.array(*[F.lit(n) for n in SEED_FOLDERS]), F.regexp_extract("rel_path", r"^([^/]+)/[^/]+\.md$", 1))
    named = files.select("rel_path", fixed.alias("a"), folder.alias("b")).where("a > 0 or b > 0").distinct()
    place = F.row_number().over(Window.partitionBy("b").orderBy("rel_path"))
    return named.withColumn("n", place).where(f"a > 0 or n <= {int(each)}").select("rel_path", F.when(F.col("a") > 0, F.col("a")).otherwise(len(SEED_FILES) + F.col("b")).cast("int").alias("priority"))


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines `first` to `last` of a text (from 1), redacted; empty if there are none."""
    start = F.greatest(first, F.lit(1))
    lines = F.slice(F.split(text, r"\r?\n"), start, F.greatest(last - start + 1, F.lit(0)))
    return redact(F.array_join(lines, "\n"))[0]
