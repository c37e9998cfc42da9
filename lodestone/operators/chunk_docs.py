"""Chunks of documentation: prose and code blocks under their headings, all within the row of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..functions.text import is_actual_code, looks_executable, looks_like_code_block, mentions_prose, splitlines, strip

HEADING = r"(?U)^(#{2,6})\s+(.*)"
CHUNK = "chunk_id, source, source_name, source_url, language, chunk_type, content, chunk_index, heading, heading_level, heading_path, line_start, line_end, inferred_block, fenced_block, was_fenced_block, looks_executable"


def _positions(lines: Column, test) -> Column:
    """0-based places of the lines that pass."""
    found = F.transform(lines, lambda x, i: F.when(test(x), i))
    return F.filter(found, lambda x: x.isNotNull())


def _before(places: Column, at: Column) -> Column:
    return F.size(F.filter(places, lambda p: p < at))


def segments(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``lines`` and ``parts``: runs of lines between headings and fences, with their heading.

    A line whose stripped form starts with three backticks always opens or closes a block, so a place is
    in code where an odd number of them stand before it; headings count outside code only.
    """
    d = docs.withColumn("lines", splitlines(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumn("fences", _positions(F.col("lines"), lambda x: strip(x).startswith("```")))
    heads = _positions(F.col("lines"), lambda x: x.rlike(HEADING))
    d = d.withColumn("heads", F.filter(heads, lambda p: _before(F.col("fences"), p) % 2 == 0))
    # Titles with the path that each leaves: the stack cut to level - 2, and the title.
    title = F.transform("heads", lambda p: F.struct(p.alias("at"), F.length(F.regexp_extract(F.get("lines", p), HEADING, 1)).alias("level"), strip(F.regexp_extract(F.get("lines", p), HEADING, 2)).alias("title")))
    none = F.expr("array(named_struct('at', -1, 'level', cast(null as int), 'title', cast(null as string), 'path', cast(array() as array<string>)))")

    def step(acc: Column, h: Column) -> Column:
        path = F.element_at(acc, -1)["path"]
        return F.array_append(acc, F.struct(h["at"].alias("at"), h["level"].alias("level"), h["title"].alias("title"), F.concat(F.slice(path, F.lit(1), h["level"] - 2), F.array(h["title"])).alias("path")))

    d = d.withColumn("stack", F.aggregate(title, none, step))
    edges = F.array_sort(F.concat(F.array(F.lit(-1)), "fences", "heads", F.array(F.size("lines"))))
    d = d.withColumn("edges", edges)
    spans = F.transform(F.slice("edges", F.lit(1), F.size("edges") - 1), lambda a, i: F.struct((a + 1).alias("s"), F.get("edges", i + 1).alias("e"), (_before(F.col("fences"), a + 1) % 2 == 1).alias("in_code"), F.element_at("stack", F.size(F.filter("stack", lambda h: h["at"] <= a))).alias("head")))
    return d.withColumn("parts", F.filter(spans, lambda x: x["e"] > x["s"]))


def doc_chunks(docs: DataFrame, text: str = "text", name: Column | None = None, url: Column | None = None) -> DataFrame:
    """One row per chunk with the columns of ``docs`` (but the text) and those of ``CHUNK``; ``chunk_index`` counts from 0 in each document.

    Prose is stripped and dropped where empty; it is taken for code only where it is very clearly code and
    no common word occurs in it. Fenced blocks are verbatim; those that look formatted are text. A null text has no chunks.
    """
    d = segments(docs, text)
    keep = [c for c in docs.columns if c != text]

    def body(x: Column) -> Column:
        raw = F.array_join(F.slice("lines", x["s"] + 1, x["e"] - x["s"]), "\n")
        fence = F.get("lines", x["s"] - 1)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["in_code"].alias("in_code"), x["head"].alias("head"), F.when(x["in_code"], raw).otherwise(strip(raw)).alias("content"), F.when(x["in_code"], strip(F.regexp_replace(strip(fence), "```", ""))).alias("tag"))

    d = d.withColumn("parts", F.filter(F.transform("parts", body), lambda x: x["in_code"] | (x["content"] != "")))
    # Outer, as the size test that Spark infers for a plain explode would work out every part again below the scan.
    d = d.select(*keep, F.posexplode_outer("parts").alias("chunk_index", "p")).where("chunk_index is not null")
    content = F.col("p.content")
    coded = F.when(F.col("p.in_code"), is_actual_code(content)).otherwise(looks_like_code_block(F.array_join(splitlines(content), "\n")) & ~mentions_prose(content))
    d = d.withColumn("coded", coded)
    fenced = F.col("p.in_code")
    columns = {
        "chunk_id": content_id(F.when(F.col("coded"), "doc_code").otherwise("doc_text"), content),
        "source": F.lit("documentation"),
        "source_name": name if name is not None else F.lit(None).cast("string"),
        "source_url": url if url is not None else F.lit(None).cast("string"),
        "language": F.when(~F.col("coded"), "markdown").when(~fenced, "python").otherwise(F.coalesce(F.when(F.col("p.tag") != "", F.col("p.tag")), F.lit("unknown"))),
        "chunk_type": F.when(F.col("coded"), "code").otherwise("text"),
        "content": content,
        "chunk_index": F.col("chunk_index"),
        "heading": F.col("p.head.title"),
        "heading_level": F.col("p.head.level"),
        "heading_path": F.when(F.size("p.head.path") > 0, F.array_join("p.head.path", " > ")),
        "line_start": (F.col("p.s") + 1).cast("bigint"),
        "line_end": F.col("p.e").cast("bigint"),
        "inferred_block": F.when(F.col("coded") & ~fenced, True),
        "fenced_block": F.when(F.col("coded") & fenced, True),
        "was_fenced_block": F.when(~F.col("coded") & fenced, True),
        "looks_executable": F.when(F.col("coded") & fenced, looks_executable(content)),
    }
    return d.select(*[c for c in keep if c not in columns], *(v.alias(k) for k, v in columns.items()))


def as_chunks(chunks: DataFrame) -> DataFrame:
    """Doc chunks as plain chunks named by their heading, under its path, marked extracted."""
    return chunks.select(
        "chunk_id",
        F.col("source_name").alias("file_path"),
        "language",
        F.lit("documentation").alias("chunk_type"),
        F.col("content").alias("code"),
        F.lit("documentation").alias("symbol_type"),
        F.col("heading").alias("name"),
        F.col("heading_path").alias("parent"),
        F.col("line_start").alias("start_line"),
        F.col("line_end").alias("end_line"),
        F.lit(True).alias("is_primary"),
        F.lit(True).alias("is_extracted"),
    )
