"""Training pairs and triplets from chunks, and the samples and splits they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import framework
from ..functions.questions import different, keywords, question, questions
from ..scratch import written
from .joins import bounded

FLAT = "chunk_id, file_path, chunk_type, code, symbol_type, name, docstring"


def draw(seed: int, *key: Column | str) -> Column:
    """A hash that orders rows as a seeded shuffle would, alike in every engine."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement; all if there are fewer."""
    return df.withColumn("_d", draw(seed, key)).orderBy("_d", key).limit(n).drop("_d")


def stratified(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows of each class."""
    order = Window.partitionBy(by).orderBy("_d", key)
    return df.withColumn("_d", draw(seed, key)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_d", "_n")


def split(df: DataFrame, key: str, train: float = 0.9, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: train or test by the hash of ``key``. By a row's own key, one document's rows land on both sides; by document_id they do not."""
    part = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("split", F.when(part < int(train * 10_000), "train").otherwise("test"))


def valid_chunks(chunks: DataFrame, least: int = 50) -> DataFrame:
    """Chunks of at least ``least`` characters, without pure imports and short ``__init__`` files; of flat columns ``FLAT``."""
    plain = (F.col("chunk_type") == "imports") | ((F.col("chunk_type") == "module") & (F.coalesce(F.col("docstring"), F.lit("")) == ""))
    imports = F.coalesce(plain & (F.col("symbol_type") == "imports"), F.lit(False))
    hollow = F.coalesce(F.col("file_path").contains("__init__"), F.lit(False)) & (F.length("code") < 100)
    return chunks.where((F.length("code") >= least) & ~imports & ~hollow)


def positive_pairs(chunks: DataFrame, n: int = 100, variance: int = 5, seed: int = 42) -> DataFrame:
    """(document_id, variations, framework) for n sampled valid chunks; variations are (anchor, positive) structs."""
    some = sample(valid_chunks(chunks), n, "chunk_id", seed)
    asked = questions(F.col("code"), F.col("symbol_type"), F.col("name"), variance)
    return some.select(F.col("chunk_id").alias("document_id"), F.transform(asked, lambda q: F.struct(q.alias("anchor"), F.col("code").alias("positive"))).alias("variations"), framework(F.col("file_path")).alias("framework"))


def flat_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("document_id", F.explode("variations").alias("v"), "framework").select("document_id", "v.anchor", "v.positive", "framework")


def negatives(anchors: DataFrame, chunks: DataFrame, attempts: int = 50, seed: int = 42) -> DataFrame:
    """(chunk_id, negative_id): for each anchor the first of ``attempts`` hashed candidates that differs in purpose, else the first.

    All chunks stand in one hashed order; an anchor's candidates are those that follow its own
    hash (going round), so each anchor meets its own run of candidates and no pairs but these are made. The order is cut into
    blocks of ``attempts``, and an anchor joins its own block and the next by an equi-join.
    """
    return _negatives(anchors, written(_keyed(chunks, seed), "keyed"), attempts)


def _keyed(chunks: DataFrame, seed: int) -> DataFrame:
    """What candidates are chosen by, without their code."""
    return chunks.select("chunk_id", "symbol_type", keywords(F.col("code")).alias("keys"), draw(seed, "chunk_id").alias("d"))


def _negatives(anchors: DataFrame, keyed: DataFrame, attempts: int) -> DataFrame:
    # Blocks by the leading bits of the hash: about ``attempts`` chunks each whatever the number of chunks.
    blocks = max(1, keyed.count() // attempts)
    block = F.floor(F.conv(F.substring("d", 1, 12), 16, 10).cast("double") / float(1 << 48) * blocks).cast("long")
    keyed = keyed.withColumn("block", block)
    mine = anchors.select("chunk_id").join(keyed, "chunk_id")
    near = mine.select(F.col("chunk_id").alias("a"), F.col("symbol_type").alias("a_symbol"), F.col("keys").alias("a_keys"), F.col("d").alias("a_d"), F.explode(F.array_distinct(F.array(*((F.col("block") + i) % blocks for i in range(3))))).alias("block"), F.col("block").alias("home"))
    pairs = near.join(keyed, "block").where("a <> chunk_id")
    lap = F.when((F.col("block") > F.col("home")) | ((F.col("block") == F.col("home")) & (F.col("d") > F.col("a_d"))), 0).otherwise(1)
    order = Window.partitionBy("a").orderBy("lap", "d", "chunk_id")
    ranked = pairs.withColumn("lap", lap).withColumn("n", F.row_number().over(order)).where(F.col("n") <= attempts)
    other = different(F.col("a_keys"), F.col("keys"), F.col("a_symbol"), F.col("symbol_type"))
    return ranked.groupBy(F.col("a").alias("chunk_id")).agg(F.min_by("chunk_id", F.struct(~other, "n")).alias("negative_id"))


def triplets(chunks: DataFrame, n: int = 100, seed: int = 42, attempts: int = 50) -> DataFrame:
    """(document_id, anchor, positive, negative, framework) for n sampled valid chunks; none if fewer than two are valid."""
    valid = valid_chunks(chunks)
    keyed = written(_keyed(valid, seed), "keyed")
    found = written(_negatives(keyed.orderBy("d", "chunk_id").limit(n), keyed, attempts), "negatives")
    # Texts come last, in one pass, and only for the ids that were chosen
    wanted = found.select("chunk_id").union(found.select("negative_id")).distinct()
    rows = written(valid.join(bounded(wanted), "chunk_id"), "chosen")
    code = rows.select(F.col("chunk_id").alias("negative_id"), F.col("code").alias("negative"))
    joined = rows.join(bounded(found), "chunk_id").join(code, "negative_id")
    return joined.select(F.col("chunk_id").alias("document_id"), question(F.col("code"), F.col("symbol_type"), F.col("name")).alias("anchor"), F.col("code").alias("positive"), "negative", framework(F.col("file_path")).alias("framework"))


def keep_first(df: DataFrame, key: str | Column, order: str) -> DataFrame:
    """The first row of each key by ``order``, by partial minima: rows of a frequent key meet in none of the tasks."""
    row = F.min_by(F.struct(*df.columns), F.col(order)).alias("_row")
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias("_key")).agg(row).select("_row.*")


def dense_ids(df: DataFrame, key: str, order: str, name: str = "dense_id") -> DataFrame:
    """(key, dense id from 0) by first appearance.

    Numbers run within ranges of the order first, and the ranges' totals are added: no task sees all keys.
    """
    firsts = df.groupBy(key).agg(F.min(order).alias("_o"))
    blocks = firsts.withColumn("_b", F.floor(F.col("_o") / 4096))
    totals = blocks.groupBy("_b").agg(F.count("*").alias("_c"))
    before = totals.withColumn("_s", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_b").orderBy("_o", key)
    return blocks.join(before.drop("_c"), "_b").select(key, (F.row_number().over(inside) - 1 + F.col("_s")).cast("long").alias(name))


def relevant_documents(queries: DataFrame, corpus: DataFrame, by: str = "document_id") -> DataFrame:
    """(qid, docnos): all corpus rows that share the query's document, sorted."""
    return queries.join(corpus, by).groupBy("qid").agg(F.array_sort(F.collect_set("docno")).alias("docnos"))


def relevant_classes(corpus: DataFrame, by: str = "document_id") -> DataFrame:
    """(docno, first, copies) of every row of ``corpus(docno, by)``: the smallest docno of its document and how many share it.

    The same relation as ``relevant_documents`` of all rows, without a list that grows with the square of a common document.
    """
    classes = corpus.groupBy(by).agg(F.min("docno").alias("first"), F.count("*").alias("copies"))
    return corpus.join(classes, by).select("docno", "first", "copies")
