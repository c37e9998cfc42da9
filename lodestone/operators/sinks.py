"""Sinks: JSON lines, JSON arrays, CSV and TREC files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.paths import language
from ..functions.text import without_nul
from ..schemas import EXPORTED_AST, EXPORTED_HIERARCHY, EXPORTED_SPAN
from .context import cross_file_context
from .stats import dataset_metadata, repo_stats


def narrow(chunks: DataFrame, clean: bool = True) -> DataFrame:
    """Chunks as they are exported: narrower records; ``clean`` takes NULs out of code and docstring and fills in languages."""
    symbol = F.col("ast")
    if clean:
        symbol = symbol.withField("docstring", without_nul(F.col("ast.docstring")))
    cols = {"ast": (symbol, EXPORTED_AST), "span": (F.col("span"), EXPORTED_SPAN), "hierarchy": (F.col("hierarchy"), EXPORTED_HIERARCHY)}

    def cut(c: Column, kind: str) -> Column:
        kinds = StructType.fromDDL(f"c {kind}")["c"].dataType
        return F.struct(*(c[f.name].alias(f.name) for f in kinds.fields))

    out = chunks
    for name, (c, kind) in cols.items():
        out = out.withColumn(name, cut(c, kind))
    if clean:
        out = out.withColumn("code", without_nul("code")).withColumn("language", language(F.col("language"), F.col("file_path")))
    return out.select("chunk_id", "file_path", "language", "chunk_type", "code", "ast", "span", "hierarchy", "metadata")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with nulls written and other scripts unescaped."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def export_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_jsonl(narrow(chunks), path, mode)


def export_with_context(chunks: DataFrame, path: str, repo: dict[str, str], mode: str = "errorifexists") -> DataFrame:
    """Writes chunks with repository information and cross-file context; gives the repository's statistics."""
    info = F.create_map(*(F.lit(x) for pair in repo.items() for x in pair)) if repo else F.lit(None).cast("map<string,string>")
    rows = cross_file_context(narrow(chunks, clean=False))
    context = F.when(F.col("similar_files").isNotNull(), F.struct("similar_files", "total_similar_files"))
    rows = rows.withColumn("metadata", F.col("metadata").withField("repo_info", info).withField("repository_context", context)).drop("similar_files", "total_similar_files")
    write_jsonl(rows, path, mode)
    return repo_stats(chunks)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array in one file: for results of a stated small size, as samples of pairs are."""
    one = df.coalesce(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    one.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, path: str, form: str = "jsonl") -> None:
    """Pairs or triplets as JSON lines, as a JSON array, or both."""
    if form not in ("jsonl", "json", "both"):
        raise ValueError(form)
    if form != "json":
        write_jsonl(pairs, f"{path}.jsonl", "overwrite")
    if form != "jsonl":
        write_json_array(pairs, f"{path}.json")


def write_repo_stats(chunks: DataFrame, path: str) -> None:
    """``repo_stats`` as JSON lines."""
    write_jsonl(repo_stats(chunks), path, "overwrite")


def write_dataset_metadata(chunks: DataFrame, path: str, name: str, version: str) -> None:
    """``dataset_metadata`` as one JSON line."""
    write_jsonl(dataset_metadata(chunks, name, version).coalesce(1), path, "overwrite")


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", header).option("escape", '"').csv(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    """TREC judgements: no header, constant second column."""
    write_csv(qrels.select("qid", F.lit("0").alias("q0"), "docno", "relevance"), path, "\t", False)


def write_run(run: DataFrame, path: str, system: str) -> None:
    write_csv(run.select("qid", F.lit("Q0").alias("q0"), "docno", "rank", "score", F.lit(system).alias("system")), path, "\t", False)


def write_split(df: DataFrame, path: str) -> None:
    """``df(split, ...)`` as JSON lines, a folder for each side."""
    for side in ("train", "test"):
        write_jsonl(df.where(F.col("split") == side).drop("split"), f"{path}/{side}", "overwrite")
