"""Deterministic identifiers: a prefix and the first eight hex digits of a SHA-256."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def content_id(prefix: str | Column, content: Column | str) -> Column:
    """Id of a content alone; equal contents share it."""
    content = F.col(content) if isinstance(content, str) else content
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("_"), F.substring(F.sha2(content, 256), 1, 8))


def text_id(content: Column, index: Column) -> Column:
    return content_id("text", F.concat(content, F.lit("_"), index.cast("string")))


def _shown(c: Column) -> Column:
    """Null is written as the word None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def id_payload(path: Column, kind: Column, name: Column, parent: Column, start: Column, end: Column, code: Column, stripped: Callable[[Column], Column] = strip) -> Column:
    """What the id of a chunk hashes: nine fields on lines indented by four, the two byte fields always None, ``stripped`` at both ends."""
    none = F.lit(None).cast("string")
    return stripped(F.concat_ws("\n    ", *(_shown(c) for c in (path, kind, name, parent, start, end, none, none, code))))


def chunk_id(path: Column, kind: Column, name: Column, parent: Column, start: Column, end: Column, code: Column, prefix: str = "primary", stripped: Callable[[Column], Column] = strip) -> Column:
    return content_id(prefix, id_payload(path, kind, name, parent, start, end, code, stripped))


def full_id(*fields: Column) -> Column:
    """An unabridged key for joins: short ids collide from tens of thousands of chunks on."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(f.cast("string"), F.lit("\u0000")) for f in fields)), 256)
