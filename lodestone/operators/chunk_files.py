"""Chunks of any file: a route by name, and the chunks of each route."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import content_id, text_id
from ..functions.paths import file_name, requirements, suffix
from ..functions.text import binary_text, split_newlines
from ..schemas import CHUNKS
from .chunk_docs import doc_chunks
from .chunk_python import SMALL_TEXT, TEXT_WINDOW, chunk_python

# Routes in the order in which they are tried.
ROUTES = (
    ("python", (".py",), ()),
    ("markdown", (".md", ".mdx", ".rst"), ()),
    ("json", (".json",), ()),
    ("config", (".yaml", ".yml", ".toml"), ()),
    ("special", (), ("requirements.txt", "dockerfile", "docker-compose.yml")),
    ("text", (".txt", ".cfg", ".ini", ".conf"), ()),
    ("readme", (), ("readme", "readme.md", "license", "license.txt", "license.md")),
)


def route(path: Column) -> Column:
    """The first route whose suffixes or names the path has; else other."""
    end, name = F.lower(suffix(path)), F.lower(file_name(path))
    out = None
    for r, ends, names in ROUTES:
        out = (F.when if out is None else out.when)(end.isin(*ends) if ends else name.isin(*names), r)
    return out.otherwise("other")


@F.pandas_udf(T.StringType())
def lossy_text(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8 text without the invalid ones, line ends made newlines."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))


@F.pandas_udf(T.StructType().add("code", T.StringType()).add("config_keys", T.ArrayType(T.StringType())))
def pretty_json(text: pd.Series) -> pd.DataFrame:
    """Indented JSON and its top-level keys; nulls where the text is no JSON."""

    def one(t: str | None) -> tuple[str | None, list[str] | None]:
        try:
            data = json.loads(t)
            return json.dumps(data, indent=2), list(data) if isinstance(data, dict) else []
        except (TypeError, ValueError, RecursionError):
            return None, None

    return pd.DataFrame([one(t) for t in text], columns=["code", "config_keys"])


def text_parts(text: Column, small: int = SMALL_TEXT, window: int = TEXT_WINDOW) -> Column:
    """Texts of a file's chunks: itself up to ``small`` lines, else every ``window`` lines. An empty text is one empty chunk."""
    lines = split_newlines(text)
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(window))
    return F.when(F.size(lines) <= small, F.array(text)).otherwise(F.transform(starts, lambda a: F.array_join(F.slice(lines, a + 1, F.lit(window)), "\n")))


def text_chunks(files: DataFrame, text: str = "text", small: int = SMALL_TEXT, window: int = TEXT_WINDOW) -> DataFrame:
    """Columns of ``files`` but the text, with chunk_index, chunk_id, code and lines of each text chunk."""
    keep = [c for c in files.columns if c != text]
    parts = files.where(F.col(text).isNotNull()).select(*keep, F.posexplode(text_parts(F.col(text), small, window)).alias("chunk_index", "code"))
    return parts.withColumn("chunk_id", text_id(F.col("code"), F.col("chunk_index"))).withColumn("lines", F.size(split_newlines("code")).cast("bigint"))


def as_rows(df: DataFrame, repo_info: Column | None = None) -> DataFrame:
    """Flat columns as rows of the chunk schema; a flat column that is missing is null."""

    def nested(kind: str, **fixed: Column) -> Column:
        parts = []
        for f in T.StructType.fromDDL(CHUNKS)[kind].dataType.fields:
            v = fixed.get(f.name)
            v = v if v is not None else F.col(f.name) if f.name in df.columns else F.lit(None)
            parts.append(v.cast(f.dataType).alias(f.name))
        return F.struct(*parts)

    none = F.array().cast("array<string>")
    info = repo_info if repo_info is not None else F.lit(None).cast("map<string,string>")
    return df.select(
        "chunk_id",
        "file_path",
        "language",
        "chunk_type",
        "code",
        nested("ast", symbol_type=F.col("chunk_type"), name=file_name(F.col("file_path")), decorators=none, imports=none).alias("ast"),
        nested("span").alias("span"),
        nested("hierarchy", children_ids=none, lineage=none, depth=F.lit(0), is_primary=F.lit(True), is_extracted=F.lit(False), sibling_index=F.lit(0)).alias("hierarchy"),
        nested("metadata", repo_info=info).alias("metadata"),
    )


def _text_rows(files: DataFrame) -> DataFrame:
    t = text_chunks(files.select(F.col("path").alias("file_path"), "text"))
    return t.select("chunk_id", "file_path", F.lit("text").alias("language"), F.lit("text").alias("chunk_type"), "code", F.lit(1).alias("start_line"), F.col("lines").alias("end_line"), F.lit("text").alias("file_type"), "chunk_index", F.col("lines").alias("total_lines"))


def _whole(files: DataFrame, prefix: Column | str, language: Column, kind: Column, **more: Column) -> DataFrame:
    return files.select(content_id(prefix, "text").alias("chunk_id"), F.col("path").alias("file_path"), language.alias("language"), kind.alias("chunk_type"), F.col("text").alias("code"), F.lit(1).alias("start_line"), F.size(split_newlines("text")).alias("end_line"), *(v.alias(k) for k, v in more.items()))


def chunk_files(files: DataFrame, repo_info: Column | None = None) -> DataFrame:
    """Chunks of ``files(path, content)`` by route; binary files of no other route have none, nor have nulls.

    Invalid UTF-8 is dropped outside Python sources; JSON that does not parse is text.
    """
    routed = files.where("path is not null and content is not null").withColumn("route", route(F.col("path")))
    python = chunk_python(routed.where("route = 'python'"))
    if repo_info is not None:
        python = python.withColumn("metadata", F.col("metadata").withField("repo_info", repo_info))
    texts = routed.where("route <> 'python'").select("path", "route", lossy_text("content").alias("text"))

    def of(r: str) -> DataFrame:
        return texts.where(F.col("route") == r)

    name = F.lower(file_name(F.col("path")))
    docs = doc_chunks(of("markdown"), name=file_name(F.col("path")), url=F.concat(F.lit("file://"), F.col("path")))
    docs = docs.select("chunk_id", F.col("path").alias("file_path"), "language", F.lit("documentation").alias("chunk_type"), F.col("content").alias("code"), F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"), F.col("chunk_type").alias("doc_chunk_type"), "heading", "heading_level", "heading_path", "line_start", "line_end", "inferred_block", "fenced_block", "was_fenced_block", "looks_executable")
    parsed = of("json").withColumn("j", pretty_json("text"))
    good = parsed.where("j.code is not null").select("path", F.col("j.code").alias("text"), F.col("j.config_keys").alias("config_keys"))
    config = F.lit("configuration")
    language = F.when(F.lower(suffix(F.col("path"))) == ".toml", "toml").otherwise("yaml")
    wants = name.contains("requirements")
    parts = [
        docs,
        _whole(good, "config", F.lit("json"), config, file_type=F.lit("json_config"), config_keys=F.col("config_keys")),
        _whole(of("config"), "config", language, config, file_type=F.concat(language, F.lit("_config"))),
        _whole(of("special"), F.when(wants, "config").otherwise("script"), F.when(wants, "requirements").otherwise("dockerfile"), F.when(wants, config).otherwise("script"), file_type=name, dependencies=F.when(wants, requirements(F.col("text"))).otherwise(F.array().cast("array<string>"))),
        _whole(of("readme"), F.when(name.contains("readme"), "doc").otherwise("license"), F.when(suffix(F.col("path")).isin(".md", ".mdx"), "markdown").otherwise("text"), F.lit("documentation"), file_type=F.lit("readme_license"), is_readme=name.contains("readme"), is_license=name.contains("license")),
        _text_rows(of("text").unionByName(of("other").where(~binary_text("text"))).select("path", "text").union(parsed.where("j.code is null").select("path", "text"))),
    ]
    out = python
    for p in parts:
        out = out.unionByName(as_rows(p, repo_info))
    return out
