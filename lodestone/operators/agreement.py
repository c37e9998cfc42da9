"""Agreement of two graders: kappas and Kendall's tau, from one table of grade pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .metrics import average_rank


def contingency(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by, x, y, n) of grade pairs without nulls: the only pass over the rows."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count("*").alias("n"))


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, qwk): 1 - sum of squared differences over its expectation by the margins; null where that is 0."""
    n = F.sum("n")
    mean = {c: F.sum(F.col("n") * F.col(c)) for c in "xy"}
    square = {c: F.sum(F.col("n") * F.col(c) * F.col(c)) for c in "xy"}
    seen = F.sum(F.col("n") * (F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    expected = square["x"] + square["y"] - 2 * mean["x"] * mean["y"] / n
    return contingency(df, a, b).agg(F.coalesce(n, F.lit(0)).alias("n"), F.round(F.when(expected > 0, 1 - seen / expected), 6).alias("qwk"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, kappa): observed less chance agreement, over 1 less chance."""
    c = contingency(df, a, b)
    total = c.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    rows = c.groupBy(F.col("x").alias("g")).agg(F.sum("n").alias("nx"))
    cols = c.groupBy(F.col("y").alias("g")).agg(F.sum("n").alias("ny"))
    chance = rows.join(cols, "g").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("chance"))
    po, pe = F.col("same") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    return total.crossJoin(chance).select(F.col("total").alias("n"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))  # one row each


def kendall_tau(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, tau): the tie-corrected b variant, from counts of grade pairs, never from pairs of rows."""
    c = written(contingency(df, a, b), "cells")
    # Cells of different y differ first in one bit of its rank: per bit, what stands before the cells with the bit set, less
    # what stands behind them, by sums in the order of x. So cells are sorted once for each bit and never paired.
    ranks = written(c.select("y").distinct().withColumn("r", F.row_number().over(Window.orderBy("y")) - 1), "ranks")
    bits = max(1, int(ranks.agg(F.coalesce(F.max("r"), F.lit(0))).first()[0]).bit_length())
    cells = c.join(ranks, "y").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    half = F.expr("shiftright(r, bit) & 1")
    cells = cells.groupBy("bit", F.expr("shiftright(r, bit + 1)").alias("g"), "x").agg(F.sum(F.when(half == 0, F.col("n")).otherwise(0)).alias("lo"), F.sum(F.when(half == 1, F.col("n")).otherwise(0)).alias("hi"))
    order = Window.partitionBy("bit", "g").orderBy("x")
    before, behind = F.sum("lo").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.sum("lo").over(order.rowsBetween(1, Window.unboundedFollowing))
    scored = cells.select((F.col("hi") * (F.coalesce(before, F.lit(0)) - F.coalesce(behind, F.lit(0)))).cast("double").alias("s"))
    pairs = scored.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))

    def untied(g: str) -> DataFrame:
        total = c.groupBy(g).agg(F.sum("n").alias("m")).agg(F.sum("m").alias("t"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("tied"))
        return total.select(F.col("t").alias(f"t{g}"), (F.col("t") * (F.col("t") - 1) / 2 - F.col("tied")).alias(f"u{g}"))

    return pairs.crossJoin(untied("x")).crossJoin(untied("y")).select(F.col("tx").alias("n"), F.round(F.when((F.col("ux") > 0) & (F.col("uy") > 0), F.col("s") / F.sqrt(F.col("ux") * F.col("uy"))), 6).alias("tau"))


def joined_grades(left: DataFrame, right: DataFrame) -> DataFrame:
    """(qid, docno, a, b): the grades of two tables of judgements (qid, docno, relevance) where both have one."""
    return left.select("qid", "docno", F.col("relevance").alias("a")).join(right.select("qid", "docno", F.col("relevance").alias("b")), ["qid", "docno"])


def binarised(score: Column, least: int = 2) -> Column:
    return F.when(score >= least, 1).otherwise(0)


def compare_systems(left: DataFrame, right: DataFrame, metric: str) -> DataFrame:
    """(system, both metrics, both descending average ranks) of the systems in both."""
    both = left.select("system", F.col(metric).alias(f"{metric}_a")).join(right.select("system", F.col(metric).alias(f"{metric}_b")), "system")
    return average_rank(average_rank(both, f"{metric}_a", "rank_a"), f"{metric}_b", "rank_b")


def arg_max(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``best``: whether the row has the largest value; ties all have."""
    return df.withColumn("best", F.col(by) == F.max(by).over(Window.partitionBy()))
