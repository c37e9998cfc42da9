"""File trees: listing on the driver, reading and sniffing on the executors."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import binary_bytes

# Directories that listings leave out, and readme names by precedence.
EXCLUDED = (".git", "__pycache__", "node_modules", "build", "dist", ".venv", "venv")
EXCLUDED_RICH = (*EXCLUDED, ".env")
READMES = ("README.md", "README.rst", "README.txt", "README", "readme.md")
LISTING = "path string, relative_path string, size bigint, extension string"


def _suffix(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def walk(root: str, extensions: set[str] | None = None, excluded: tuple[str, ...] | None = EXCLUDED, hidden: bool = False) -> Iterator[tuple[str, str, int, str]]:
    """(path, relative path, size, lower-cased suffix) of files; excluded and dot directories are not entered, dot files not listed unless ``hidden``."""
    for at, dirs, names in os.walk(root):
        if not hidden:
            dirs[:] = [d for d in dirs if d not in (excluded or ()) and not d.startswith(".")]
        for name in names:
            if (hidden or not name.startswith(".")) and (not extensions or _suffix(name) in extensions):
                path = os.path.join(at, name)
                try:
                    yield path, os.path.relpath(path, root), os.stat(path).st_size, _suffix(name)
                except OSError:
                    continue


def list_files(spark: SparkSession, root: str, extensions: set[str] | None = None, excluded: tuple[str, ...] | None = None, rich_metadata: bool = False, skip_binary: bool = True, hidden: bool = False) -> DataFrame:
    """Files under ``root``, sorted by path. With ``rich_metadata`` also ``is_binary``; binary files are left out if ``skip_binary``.

    Spark's own readers pass over names that start with an underscore, so the tree is walked here.
    """
    excluded = excluded if excluded is not None else EXCLUDED_RICH if rich_metadata else EXCLUDED
    rows = sorted(walk(root, extensions, excluded, hidden), key=lambda r: r[1].split(os.sep))
    found = spark.createDataFrame(rows, LISTING)
    if not rich_metadata:
        return found
    if not skip_binary:
        return found.withColumn("is_binary", F.lit(None).cast("boolean"))
    return read_files(found, 1024).withColumn("is_binary", binary_bytes("content")).where("not is_binary").drop("content")


def read_files(files: DataFrame, most: int | None = None) -> DataFrame:
    """``files`` with ``content``; null where a file cannot be read. Paths are dealt evenly first, not by directory."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(path: str) -> bytes | None:
            try:
                with open(path, "rb") as f:
                    return f.read(most) if most else f.read()
            except OSError:
                return None

        for part in parts:
            for a in range(0, len(part), 100):
                some = part.iloc[a : a + 100]
                yield some.assign(content=[one(p) for p in some["path"]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", content binary"
    return files.repartition("path").mapInPandas(read, schema)


def readme(files: DataFrame) -> DataFrame:
    """One row at most: the first 5,000 characters of the first readme by precedence among ``files(relative_path, text)``; unreadable (null) ones are passed over."""
    names = F.array(*map(F.lit, READMES))
    ranked = files.withColumn("p", F.array_position(names, F.col("relative_path"))).where("p > 0 and text is not null")
    return ranked.agg(F.min_by("text", "p").alias("text")).where("text is not null").select(F.substring("text", 1, 5000).alias("readme"))
