"""Lexical and dense retrieval, pools, and judging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cut, dot, max_sim
from ..scratch import written
from .joins import bounded
from .tiles import Block, best, late, shaped, tiled

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; no stemming, no stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """``scored(qid, docno, score)`` cut to the k best of each query, with ranks from 0; ties by docno."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "docno")
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


#: The term under which an index has a row for each document, whatever it holds.
DOCUMENT = ""


def asked_terms(topics: DataFrame) -> DataFrame:
    """(qid, term, qtf) of ``topics(qid, query)``; repeated terms count each time."""
    return topics.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def term_index(corpus: DataFrame, topics: DataFrame, path: str | None = None) -> DataFrame:
    """(docno, dl, term, tf) of ``corpus(docno, text)`` for the terms that topics ask for, and a row of term ``DOCUMENT`` for each document.

    Texts are split once: only asked terms leave the scan. With ``path`` an index that is there is read, else written there.
    """
    spark = corpus.sparkSession
    kind = "docno string, dl int, term string, tf bigint"
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return spark.read.schema(kind).parquet(path)
    terms = asked_terms(topics).select("term").union(spark.createDataFrame([(DOCUMENT,)], "term string")).distinct()
    docs = corpus.select(F.col("docno").cast("string").alias("docno"), tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    words = docs.select("docno", "dl", F.explode(F.concat(F.array(F.lit(DOCUMENT)), "t")).alias("term"))
    index = words.join(bounded(terms), "term").groupBy("docno", "dl", "term").agg(F.count("*").alias("tf")).select("docno", "dl", "term", "tf")
    if not path:
        return written(index, "index")
    index.write.mode("overwrite").parquet(path)
    return spark.read.schema(kind).parquet(path)


def bm25(corpus: DataFrame, topics: DataFrame, k: int = 100, k1: float = K1, b: float = B, index: DataFrame | None = None) -> DataFrame:
    """(qid, docno, score, rank) of ``topics(qid, query)`` over ``corpus(docno, text)``, or over its ``term_index``.

    Postings are dealt by document once; joins with topics and sums then stay where they are.
    """
    asked = asked_terms(topics)
    index = index if index is not None else term_index(corpus, topics)
    size = index.where(F.col("term") == DOCUMENT).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = index.where(F.col("term") != DOCUMENT)
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(size)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")  # size is one row
    weighed = asked.join(idf, "term")
    frequency = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    pairs = tf.repartition("docno").join(bounded(weighed), "term")
    scored = pairs.groupBy("qid", "docno").agg(F.round(F.sum(F.col("idf") * frequency * F.col("qtf")), 6).alias("score"))
    return top_k(scored, k)


def term_counts(corpus: DataFrame, topics: DataFrame, k: int = 100, index: DataFrame | None = None) -> DataFrame:
    """The same with the plain number of a document's words that are asked for as its score."""
    index = index if index is not None else term_index(corpus, topics)
    pairs = index.where(F.col("term") != DOCUMENT).repartition("docno").join(bounded(asked_terms(topics)), "term")
    return top_k(pairs.groupBy("qid", "docno").agg(F.sum(F.col("tf") * F.col("qtf")).cast("double").alias("score")), k)


def dense(corpus: DataFrame, topics: DataFrame, k: int = 100, dims: tuple[int, ...] | None = None, renormalise: bool = False) -> DataFrame:
    """Exhaustive inner products of ``topics(qid, vector)`` with ``corpus(docno, vector)``; with ``dims`` a run of each cut dimension, in one scan.

    Blocks of topics meet blocks of the corpus, and a tile gives the ``k`` best of each topic and dimension. Vectors that are
    null, hold nulls or differ in length from most, and cosines (``renormalise``), are computed pair by pair.
    """
    sweep = dims or (0,)
    order = Window.partitionBy("dim", "qid").orderBy(F.desc("score"), F.asc_nulls_last("docno"))

    def pairwise(corpus: DataFrame, topics: DataFrame) -> DataFrame:
        q = topics.select("qid", F.col("vector").alias("qv")).withColumn("dim", F.explode(F.array(*map(F.lit, sweep))))
        pairs = corpus.join(bounded(q, 5_000), how="cross")

        def part(c: str) -> Column:
            return F.when(F.col("dim") > 0, cut(F.col(c), F.col("dim"))).otherwise(F.col(c)) if dims else F.col(c)

        value = dot(part("qv"), part("vector"))
        if renormalise:
            value = value / (F.sqrt(dot(part("qv"), part("qv"))) * F.sqrt(dot(part("vector"), part("vector"))))
        return pairs.select("dim", "qid", "docno", F.round(value, 6).alias("score"))

    def run(q: Block, c: Block, parts: int, width: int) -> Iterator[pa.RecordBatch]:
        for d, i, j, score in best(q, c, sweep, k, 6):
            yield pa.record_batch([pa.array(np.full(len(i), d, np.int32)), q.ids.take(pa.array(i)), c.ids.take(pa.array(j)), pa.array(score)], ["dim", "qid", "docno", "score"])

    if renormalise:
        scored = pairwise(corpus, topics)
    else:
        rows, asked = shaped(corpus.withColumn("m", F.array("vector")), "docno", "m"), shaped(topics.withColumn("m", F.array("vector")), "qid", "m")
        found, rest = tiled(rows, asked, run, f"dim int, qid {_kind(asked)}, docno {_kind(rows)}, score double", 2048, 16_384)
        vector = F.get("m", F.lit(0)).alias("vector")
        more = [pairwise(c.select(F.col("id").alias("docno"), vector), q.select(F.col("id").alias("qid"), vector)) for c, q in rest]
        scored = reduce(DataFrame.unionByName, ([found] if found is not None else []) + more)
    ranked = scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return ranked if dims else ranked.drop("dim")


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def max_sims(corpus: DataFrame, topics: DataFrame) -> DataFrame:
    """(qid, docno, score) of every topic with every row: MaxSim of ``topics(qid, vectors)`` and ``corpus(docno, vectors)``, rounded to six digits.

    Blocks of topics meet blocks of the corpus. Lists that are null, hold nulls or differ in shape from most are computed pair by pair.
    """

    def run(q: Block, c: Block, parts: int, width: int) -> Iterator[pa.RecordBatch]:
        for i, j, score in late(q, c, parts, width, 6):
            yield pa.record_batch([q.ids.take(pa.array(i)), c.ids.take(pa.array(j)), pa.array(score)], ["qid", "docno", "score"])

    rows, asked = shaped(corpus, "docno", "vectors"), shaped(topics, "qid", "vectors")
    found, rest = tiled(rows, asked, run, f"qid {_kind(asked)}, docno {_kind(rows)}, score double", 2048, 2048)

    def pairwise(c: DataFrame, q: DataFrame) -> DataFrame:
        q = q.select(F.col("id").alias("qid"), F.col("m").alias("qm"))
        return c.join(bounded(q), how="cross").select("qid", F.col("id").alias("docno"), F.round(max_sim(F.col("qm"), F.col("m")), 6).alias("score"))

    return reduce(DataFrame.unionByName, ([found] if found is not None else []) + [pairwise(c, q) for c, q in rest])


def pool(runs: list[DataFrame], depth: int = 100) -> DataFrame:
    """Distinct (qid, docno) of the runs' first ``depth`` ranks."""
    out = None
    for r in runs:
        part = r.where(F.col("rank") < depth).select("qid", "docno")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def pool_texts(pooled: DataFrame, corpus: DataFrame, topics: DataFrame) -> DataFrame:
    """The pool with query and text; pairs without either are dropped."""
    return pooled.join(corpus, "docno", "left").join(bounded(topics), "qid", "left").dropna(subset=["query", "text"])


def _grade(share: Column) -> Column:
    return F.when(share >= 0.9, 3).when(share >= 0.6, 2).when(share >= 0.3, 1).otherwise(0)


def lexical_grade(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a judge: 0 to 3 by the share of the query's distinct terms that the text has."""
    q = F.array_distinct(tokens(query))
    share = F.size(F.array_intersect(q, tokens(text))) / F.size(q)
    return F.when(F.size(q) == 0, 0).otherwise(_grade(share))


def lexical_judgements(topics: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, docno, relevance) of every topic with every document that ``lexical_grade`` gives more than 0; all others have 0.

    Topics and documents meet by the terms that they share, so that no pair without one is made.
    """
    asked = topics.select("qid", F.array_distinct(tokens(F.col("query"))).alias("q")).select("qid", F.size("q").alias("n_terms"), F.explode("q").alias("term"))
    terms = bounded(asked.select("term").distinct())
    has = corpus.select("docno", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(terms, "term").repartition("docno")
    hits = has.join(bounded(asked), "term").groupBy("qid", "docno").agg((F.count("*") / F.first("n_terms")).alias("share"))
    return hits.select("qid", "docno", _grade(F.col("share")).alias("relevance")).where("relevance > 0")


def lexical_counts(topics: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, relevance, n) over every topic and document: those of grade 0 are what the others leave."""
    above = lexical_judgements(topics, corpus).groupBy("qid", "relevance").agg(F.count("*").alias("n"))
    above = written(above, "grades")
    size = corpus.agg(F.count("*").alias("all"))
    rest = topics.select("qid").join(above.groupBy("qid").agg(F.sum("n").alias("m")), "qid", "left").join(F.broadcast(size))  # size is one row
    return above.union(rest.select("qid", F.lit(0).alias("relevance"), (F.col("all") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0"))


def containing(corpus: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """(qid, docno) of ``corpus(docno, text)`` whose text holds a passage of ``passages(qid, passage)`` verbatim.

    A passage's second to fifth word stand in such a text as whole words too; texts and passages meet by these,
    and only pairs that do are searched. Passages of too few words are searched in all texts.
    """
    cut = passages.where("passage <> ''").withColumn("t", tokens(F.col("passage")))
    long = F.size("t") >= words + 2
    anchored = cut.where(long).select("qid", "passage", F.xxhash64(F.slice("t", 2, words)).alias("anchor"))
    t = corpus.where("text is not null").withColumn("t", tokens(F.col("text")))
    runs = F.transform(F.sequence(F.lit(1), F.size("t") - words + 1), lambda i: F.xxhash64(F.slice("t", i, F.lit(words))))
    placed = t.where(F.size("t") >= words).select("docno", F.explode(F.array_distinct(runs)).alias("anchor"))
    met = placed.join(bounded(anchored.select("qid", "anchor")), "anchor").select("docno", "qid").distinct()
    found = met.join(corpus, "docno").join(bounded(anchored.select("qid", "passage")), "qid").where(F.col("text").contains(F.col("passage")))
    rest = corpus.join(bounded(cut.where(~long).select("qid", "passage"), 5_000), F.col("text").contains(F.col("passage")))
    return found.select("qid", "docno").union(rest.select("qid", "docno")).distinct()


def judge(pooled: DataFrame, grade=lexical_grade) -> DataFrame:
    """(qid, docno, relevance) of ``pooled(qid, docno, query, text)``; ``grade`` gives a column, for instance of a pandas UDF around a model."""
    return pooled.select("qid", "docno", grade(F.col("query"), F.col("text")).cast("int").alias("relevance"))


def judge_all(topics: DataFrame, corpus: DataFrame, grade=lexical_grade) -> DataFrame:
    """Every topic with every document; the topics are few and stated."""
    return judge(corpus.join(bounded(topics, 5_000), how="cross"), grade)


def judge_batches(pooled: DataFrame, path: str, batches: int, grade=lexical_grade) -> DataFrame:
    """``judge`` in batches of documents, each written to a folder of its own under ``path``; those there already are not judged again.

    For graders that are slow or fail at times: a run that was stopped goes on with the batch at which it was.
    """
    spark = pooled.sparkSession
    kind = "qid string, docno string, relevance int"
    for i in range(batches):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={i}/_SUCCESS")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            judge(pooled.where(F.pmod(F.xxhash64("docno"), F.lit(batches)) == i), grade).write.mode("overwrite").parquet(f"{path}/batch={i}")
    return spark.read.schema(kind).parquet(*(f"{path}/batch={i}" for i in range(batches)))


def mean_pool(pooled: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: topics, pooled pairs, and pairs a topic over all topics, those without any included."""
    return topics.agg(F.count("*").alias("topics")).join(F.broadcast(pooled.agg(F.count("*").alias("pairs")))).select("topics", "pairs", F.round(F.col("pairs") / F.col("topics"), 6).alias("mean_pool"))  # one row each
