"""Operator 6: a document's quality, by a sparse rule ensemble.

Method: statistics of each text; small boosted trees over them on a bounded sample of labelled
rows; the paths of the trees become conjunctive rules; a lasso logistic regression keeps few of
them; the kept rules are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import texts
from .language_id import held_out

STATISTICS = ("log_words", "word_length", "distinct", "top_word", "repeats", "upper", "digits", "marks", "bangs", "bars", "symbols", "spaces", "high_bytes", "capital_words", "long_words", "marked_words", "repeated_lines", "line_words", "entropy")
SYMBOLS = b"#$%&*@^~"


def _classes() -> np.ndarray:
    """A column for each class of bytes: upper, digits, marks, bangs, bars, symbols, spaces, high bytes."""
    c = np.zeros((256, 8), np.int64)
    for i in range(256):
        ch = chr(i)
        c[i] = [65 <= i <= 90, 48 <= i <= 57, ch in ".,;:?\"'()-", ch == "!", ch == "|", i in SYMBOLS, i in b" \t\r\n", i >= 128]
    return c


CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    """``STATISTICS`` of a text; all 0 where there are no words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, digits, marks, bangs, bars, symbols, spaces, high = (counts @ CLASSES / len(raw)).tolist()
    n, seen = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = counts[counts > 0] / len(raw)
    return [
        math.log1p(n), sum(map(len, words)) / n, len(seen) / n, max(seen.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n,  # noqa: B905
        upper, digits, marks, bangs, bars, symbols, spaces, high,
        sum(map(str.isupper, words)) / n, sum(len(w) > 15 for w in words) / n, sum(not w[-1].isalnum() for w in words) / n,
        1 - len(set(lines)) / len(lines), n / len(lines), float(-(share * np.log2(share)).sum()),
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the statistics of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([statistics(t.as_py()) for t in b["text"]], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(values[:, i]) for i in range(len(STATISTICS)))], [*keep, *STATISTICS])

    part = docs.select(*keep, "text")
    schema = T.StructType([*(part.schema[c] for c in keep), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])
    return part.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, over, threshold), all of which hold


@dataclass
class Ensemble:
    """log odds = bias + the weights of the rules that hold."""

    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        def holds(rule: Rule) -> Column:
            out = None
            for i, over, at in rule:
                c = F.col(STATISTICS[i]) > at if over else F.col(STATISTICS[i]) <= at
                out = c if out is None else out & c
            return out

        odds = F.lit(self.bias)
        for rule, weight in self.rules:
            odds = odds + F.when(holds(rule), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-odds))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """Rules of all nodes but the root of one tree, and the tree's step for each row."""
    rules: list[Rule] = []
    step = np.zeros(len(g))

    def grow(rows: np.ndarray, path: Rule) -> None:
        best = (1e-6, -1, 0.0)
        gs, hs = g[rows].sum(), h[rows].sum()
        if len(path) < depth and len(rows) >= 2 * least:
            for i, at in enumerate(cuts):
                if not len(at):
                    continue
                to = np.searchsorted(at, x[rows, i], "left")
                n = np.cumsum(np.bincount(to, minlength=len(at) + 1))[:-1]
                gl, hl = (np.cumsum(np.bincount(to, v[rows], len(at) + 1))[:-1] for v in (g, h))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), i, float(at[k]))
        _, i, at = best
        if i < 0:
            step[rows] = gs / (hs + 1)
            return
        over = x[rows, i] > at
        for side in (False, True):
            longer = (*path, (i, side, at))
            rules.append(longer)
            grow(rows[over == side], longer)

    grow(np.arange(len(g)), ())
    return rules, step


def hold(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, over, at in rule:
        out &= (x[:, i] > at) == over
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.3, penalty: float = 4e-4, rounds: int = 300) -> Ensemble:
    """Boosted trees, their rules, and lasso weights by accelerated proximal steps."""
    if not len(y) or y.min() == y.max():
        return Ensemble(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0, [])
    cuts = []
    for i in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, i], np.linspace(0, 1, 65)))
        cuts.append((q[1:] + q[:-1]) / 2)
    least, odds, rules = max(2, len(y) // 500), np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        found, step = _tree(x, y - p, p * (1 - p), cuts, depth, least)
        rules |= dict.fromkeys(tuple(sorted(r)) for r in found)
        odds = odds + rate * step
    r = np.array([hold(x, rule) for rule in rules], np.float64).T
    mean, scale = r.mean(0), np.maximum(r.std(0), 1e-3)
    z = (r - mean) / scale
    w, v, b, vb, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0.0, 0.0, 1.0
    size = 4 * len(y) / max(1e-9, np.linalg.norm(z, 2) ** 2 + len(y))
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(z @ v + vb))) - y
        w2 = v - size * (z.T @ e) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - size * penalty, 0)
        b2, t2 = vb - size * e.mean(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb, w, b, t = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b), w2, b2, t2
    kept = [(rule, float(c)) for rule, c in zip(rules, w / scale, strict=True) if c]
    return Ensemble(float(b - (w / scale) @ mean), kept)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` labelled rows that are not held out, in hashed order."""
    able = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
    one = able.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    few = F.broadcast(one)  # of at most ``rows`` rows
    # One row for each label, so that repeated doc_ids keep the bound; of these the one of the largest statistics
    each = with_statistics(docs.select("doc_id", "text").join(few, "doc_id"), ["doc_id", "quality"])
    one_each = each.groupBy("doc_id").agg(F.max(F.struct(*STATISTICS, "quality")).alias("s")).select("doc_id", "s.*")
    found = one_each.toPandas().sort_values("doc_id", kind="stable")
    return found[list(STATISTICS)].to_numpy(np.float64), (found["quality"].to_numpy() >= 1).astype(np.float64)


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text, ...).

    Learns from at most ``sample_rows`` rows of ``labels`` (doc_id, quality); rows whose crc32 of
    doc_id has remainder 1 by 3 are held out, as are null labels and doc_ids (a null doc_id itself is not marked held out).
    Of repeated labels the larger counts. Null and wordless texts have statistics 0 and are scored
    like others; without labels of both kinds all rows get the smoothed share of label 1. Other columns are ignored.
    """
    ensemble = fit(*labelled_sample(docs, labels, sample_rows))
    scored = with_statistics(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), ensemble.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(texts(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
