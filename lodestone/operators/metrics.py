"""Ranking metrics of runs against judgements, their significance and leaderboards.

Gains are linear, discounts log2(rank + 2) with ranks from 0; unjudged documents are not
relevant; only topics with judgements count.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from .joins import bounded


def per_query(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (5, 10), relevant: int = 1, ap_relevant: int = 2, recall_at: int = 10) -> DataFrame:
    """(system, qid, metric columns): nDCG at ``cuts``, AP, recall, reciprocal rank, precision and accuracy.

    A topic that a system has no rank for scores 0. One join of runs with judgements; the ideal comes from the judgements alone.
    """
    run, q = written(run, "run"), written(qrels.where("relevance is not null"), "qrels")  # both are read twice; they hold ranks and judgements, no texts
    ideal_order = Window.partitionBy("qid").orderBy(F.desc("relevance"), "docno")
    ranked = q.withColumn("i", F.row_number().over(ideal_order) - 1)
    gain = F.greatest("relevance", F.lit(0)) / F.log2(F.col("i") + 2.0)
    ideal = ranked.groupBy("qid").agg(*(F.sum(F.when(F.col("i") < c, gain).otherwise(0.0)).alias(f"idcg_{c}") for c in cuts), F.count_if(F.col("relevance") >= relevant).alias("n_rel"), F.count_if(F.col("relevance") >= ap_relevant).alias("n_ap"))
    judged = run.join(q, ["qid", "docno"], "left").withColumn("rel", F.greatest(F.coalesce("relevance", F.lit(0)), F.lit(0)))
    return _scores(run, judged, ideal, cuts, relevant, ap_relevant, recall_at)


def per_query_by_class(run: DataFrame, items: DataFrame, topics: DataFrame, cuts: tuple[int, ...] = (5, 10), relevant: int = 1, ap_relevant: int = 2, recall_at: int = 10) -> DataFrame:
    """``per_query`` where a topic's relevant documents, of relevance 1, are those of its class: ``items(docno, label)`` and ``topics(qid, label)``.

    Judgements are counted by class and looked up for ranked documents, not listed: there is one for each topic and member of its class.
    """
    run = written(run, "run")
    asked = topics.join(items.where("label is not null").groupBy("label").agg(F.count("*").alias("n")), "label")
    asked = written(asked.select("qid", F.col("label").alias("own"), "n"), "asked")
    gains = F.transform(F.sequence(F.lit(0), F.lit(max(cuts) - 1)), lambda i: F.when(i < F.col("n"), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    upto = {c: F.aggregate(F.slice(gains, 1, c), F.lit(0.0), lambda s, x: s + x) for c in cuts}

    def counted(least: int) -> Column:
        return F.sum("n") if least <= 1 else F.lit(0)

    # a topic of several rows has the documents of each of their classes
    ideal = asked.groupBy("qid").agg(F.sum("n").alias("n"), counted(relevant).alias("n_rel"), counted(ap_relevant).alias("n_ap")).select("qid", "n_rel", "n_ap", *(g.alias(f"idcg_{c}") for c, g in upto.items()))
    judged = run.join(asked.select("qid", "own"), "qid").join(items.select("docno", "label"), "docno").withColumn("rel", F.coalesce((F.col("label") == F.col("own")).cast("int"), F.lit(0)))
    return _scores(run, judged, ideal, cuts, relevant, ap_relevant, recall_at)


def _scores(run: DataFrame, judged: DataFrame, ideal: DataFrame, cuts: tuple[int, ...], relevant: int, ap_relevant: int, recall_at: int) -> DataFrame:
    """Metrics of ranked documents with their relevance (``rel``) against the ideal of each topic."""
    upto = Window.partitionBy("system", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("seen", F.sum((F.col("rel") >= ap_relevant).cast("int")).over(upto))
    dcg = F.col("rel") / F.log2(F.col("rank") + 2.0)
    hit = F.col("rel") >= relevant
    sums = judged.groupBy("system", "qid").agg(
        *(F.sum(F.when(F.col("rank") < c, dcg).otherwise(0.0)).alias(f"dcg_{c}") for c in cuts),
        F.sum(F.when(F.col("rel") >= ap_relevant, F.col("seen") / (F.col("rank") + 1.0)).otherwise(0.0)).alias("ap"),
        F.count_if(hit & (F.col("rank") < recall_at)).alias("found"),
        F.count_if(hit & (F.col("rank") < 3)).alias("found_3"),
        F.count_if(hit & (F.col("rank") < 5)).alias("found_5"),
        F.count_if(hit & (F.col("rank") < 1)).alias("found_1"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    every = ideal.join(bounded(run.select("system").distinct()), how="cross").join(sums, ["system", "qid"], "left")

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.coalesce(a, F.lit(0)) / b).otherwise(0.0)

    return every.select(
        "system",
        "qid",
        *(share(F.col(f"dcg_{c}"), F.col(f"idcg_{c}")).alias(f"ndcg_{c}") for c in cuts),
        share(F.col("ap"), F.col("n_ap")).alias("ap"),
        share(F.col("found"), F.col("n_rel")).alias("recall"),
        share(F.col("found_3"), F.col("n_rel")).alias("recall_3"),
        F.coalesce(F.when(F.col("first") < 10, 1.0 / (F.col("first") + 1)), F.lit(0.0)).alias("mrr"),
        (F.coalesce("found_1", F.lit(0)) / 1.0).alias("accuracy_1"),
        (F.coalesce("found_3", F.lit(0)) / 3.0).alias("precision_3"),
        (F.coalesce("found_5", F.lit(0)) / 5.0).alias("precision_5"),
    )


METRICS = ("ndcg_5", "ndcg_10", "ap", "recall")
BINARY_METRICS = ("accuracy_1", "precision_3", "precision_5", "recall_3", "mrr", "ndcg_10")


def means(scores: DataFrame, metrics: tuple[str, ...] = METRICS, digits: int = 6) -> DataFrame:
    return scores.groupBy("system").agg(*(F.round(F.avg(m), digits).alias(m) for m in metrics))


def leaderboard(scores: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """Means rounded first, then placed from 1; ties by system. ``best`` marks all that share the top value."""
    m = scores.groupBy("system").agg(F.round(F.avg(by), digits).alias(by))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), "system"))).withColumn("best", F.col(by) == F.max(by).over(Window.partitionBy()))


def average_rank(df: DataFrame, by: str, name: str) -> DataFrame:
    """Descending ranks, ties averaged and the average cut to an integer: a two-way tie at the top gives 1, 1, 3."""
    ties = Window.partitionBy(by)
    return df.withColumn(name, (F.rank().over(Window.orderBy(F.desc(by))) + (F.count("*").over(ties) - 1) / 2).cast("int"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_p(x, d) for x, d in zip(t, df, strict=True)], dtype="float64")


def against_baseline(scores: DataFrame, baseline: str, metric: str, tests: int | None = None, alpha: float = 0.05, p: bool = True) -> DataFrame:
    """(system, mean, wins, losses, t, and p, corrected p, reject) of paired per-query differences to ``baseline``; Bonferroni over ``tests`` systems."""
    base = scores.where(F.col("system") == baseline).select("qid", F.col(metric).alias("b"))
    other = scores.where(F.col("system") != baseline).join(base, "qid").withColumn("d", F.col(metric) - F.col("b"))
    n, sd = F.count("*"), F.stddev_samp("d")
    out = other.groupBy("system").agg(F.avg(metric).alias(metric), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), n.alias("n"), F.when(sd > 0, F.avg("d") / (sd / F.sqrt(n))).alias("t"))
    if not p:
        return out
    m = tests if tests is not None else scores.select("system").distinct().count() - 1
    out = out.withColumn("p", p_value("t", (F.col("n") - 1).cast("double")))
    return out.withColumn("p_corrected", F.least(F.lit(1.0), F.col("p") * m)).withColumn("reject", F.coalesce(F.col("p_corrected") < alpha, F.lit(False)))


def relative_gain(new: Column, old: Column) -> Column:
    """Gain in percent, safe at 0."""
    return (new - old) / (old + 1e-9) * 100
