"""Tables in files, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXPORTED


def load_chunks(spark: SparkSession, path: str, schema: str = EXPORTED) -> DataFrame:
    """Chunks of a JSON-lines file; blank and malformed lines are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def load_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON lines, or one JSON array."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def load_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("multiLine", True).option("escape", '"').csv(path)


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """TREC judgements: qid, constant, docno, relevance, without a header."""
    return load_csv(spark, path, "qid string, q0 string, docno string, relevance int", "\t", False).drop("q0")


def load_run(spark: SparkSession, path: str) -> DataFrame:
    """A TREC run: qid, constant, docno, rank, score, system."""
    return load_csv(spark, path, "qid string, q0 string, docno string, rank int, score double, system string", "\t", False).drop("q0")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan, dealt anew if it has fewer tasks than there are cores, as that of one small file has; else as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows are much work each."""
    return spread(table(spark, sf_dir, name))


def benchmark_corpus(docs: DataFrame, language: str | None = None) -> DataFrame:
    """(docno, text), filtered by language at the scan."""
    d = docs.where(F.col("lang") == language) if language else docs
    return d.select(F.col("doc_id").cast("string").alias("docno"), "text")
