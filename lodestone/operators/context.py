"""What a chunk's row is given of the other files of its repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cross_file_context(chunks: DataFrame, path: str = "file_path", repo: str | None = None, most: int = 5) -> DataFrame:
    """``chunks`` with ``similar_files`` (the first five other files by path) and ``total_similar_files``; null where there are none.

    The first six distinct paths of a repository and their number suffice, so no list grows with the repository.
    """
    key = [repo] if repo else []
    files = chunks.select(*key, F.col(path).alias("_f")).where("_f is not null").distinct()
    few = None
    if repo:
        place = F.row_number().over(Window.partitionBy(repo).orderBy("_f"))  # cut within each partition before rows are dealt
        first = files.withColumn("_p", place).where(F.col("_p") <= most + 1).groupBy(repo).agg(F.array_sort(F.collect_list("_f")).alias("_first"))
        few = files.groupBy(repo).agg(F.count("*").alias("_n")).join(first, repo)
    if few is None:
        first = files.orderBy("_f").limit(most + 1).agg(F.array_sort(F.collect_list("_f")).alias("_first"))
        joined = chunks.crossJoin(F.broadcast(files.agg(F.count("*").alias("_n")).crossJoin(first)))  # one row
    else:
        joined = chunks.join(few, repo, "left")
    others = F.col("_n") - F.when(F.col(path).isNotNull(), 1).otherwise(0)
    return joined.withColumn("similar_files", F.when(others > 0, F.slice(F.coalesce(F.array_remove("_first", F.col(path)), "_first"), 1, most))).withColumn("total_similar_files", F.when(others > 0, others)).drop("_n", "_first")
