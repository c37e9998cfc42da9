"""Queries over odd rows, and vectors by blocks, held against the queries' SQL."""

from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone import plans
from lodestone.operators.metrics import per_query, per_query_by_class
from lodestone.operators.retrieval import dense, max_sims
from lodestone.operators.tiles import rounded

from .oracle import difference

ODD_TEXTS = [
    None, "", " ", "\n", " \n\t ", "\u00a0", "\u3000\n", "a", "a ", "a\n\n", "a\n ", "a\t\r\f\n", "a\x0b", "a\x0b\n", "a\x1c", "a\x1f ", "a\x85", "a\u00a0", "a\u00a0\n", "a\n\u00a0", "a \u2003\u202f ", "a\u2028", "a\u200b",
    "  a\n  b", "\u00a0a", "a\r\nb\r\n", "\u00e9\u4e2d\U0001f600 \u3000", "x" + " " * 5000 + "y" + " " * 5000, "a\x00 ", "\ufeffa",
]


def test_stable_ids(spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD_TEXTS)]
    rows += [(1000 + i, t, lang, source) for i, (t, lang, source) in enumerate(itertools.product([None, "a"], [None, "", "de "], [None, "", " s\n"]))] + [(None, "a", "en", "s"), (-1, "a", "en", "s"), (1, "a", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "q").mkdir()
    assert difference(plans.QUERIES["stable_ids"](spark, str(tmp_path)), plans.ORACLE_SQL["stable_ids"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"), str(tmp_path / "q")) is None


def in_order(x, y) -> float:
    s = 0.0
    for a, b in zip(x, y, strict=True):
        s += a * b
    return s


def by_sql(x: float) -> float:
    """As DuckDB rounds to six digits."""
    return float(duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0])


def halves(n: int) -> list[list[float]]:
    """Vectors of 64 components: products that end on half a unit of the sixth digit, exact copies, zeros, huge and non-finite ones."""
    r = np.random.default_rng(5)
    v = (r.integers(-3, 4, (n, 64)) * 2.0**-4).astype(np.float32)
    v[:, 8:] *= r.random((n, 56)).astype(np.float32)
    v[1::3, 1:] = 0
    v[1::3, 0] = r.integers(-5, 6, len(v[1::3])) * np.float32(2.0**-3)
    v[2::7] = v[2]
    v[5], v[6], v[7], v[8], v[9] = 0, 3e18, np.nan, np.inf, -np.inf
    v[10, 40] = np.nan
    v[20], v[40, 3], v[60] = v[2], np.nan, v[6]
    return v.tolist()


@pytest.fixture(scope="module")
def odd_vectors(spark, tmp_path_factory):
    """Embeddings of which SQL knows a result: 700 rows, some without a vector, an id or a label."""
    at = tmp_path_factory.mktemp("odd")
    rows = [(i, v, i % 7) for i, v in enumerate(halves(700))]
    rows[80], rows[81], rows[82], rows[100] = (80, None, 3), (81, None, 4), (None, rows[82][1], 1), (100, rows[100][1], None)
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    pq.write_table(table, at / "embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["late_interaction", "dense_top10", "dimension_sweep"])
def test_odd_vectors(spark, odd_vectors, name):
    assert difference(plans.QUERIES[name](spark, odd_vectors), plans.ORACLE_SQL[name], odd_vectors) is None


def test_max_sims_of_other_shapes(spark):
    """Lists that are null or of another shape than most are in the result too."""
    rows = [("a", [[1.0, 2.0], [0.5, 1.0]]), ("b", [[3.0, 1.0], [1.0, 1.0]]), ("c", None), ("d", [[1.0, 1.0]]), ("e", [[1.0, 1.0], None]), ("f", [[2.0, 2.0], [0.0, 0.0]])]
    df = spark.createDataFrame(rows, "docno string, vectors array<array<double>>")
    found = {(r["qid"], r["docno"]): r["score"] for r in max_sims(df, df.withColumnRenamed("docno", "qid")).collect()}
    assert len(found) == 36

    def score(q, d):
        if q is None or d is None:
            return None
        tops = [max((in_order(x, y) for y in d if x is not None and y is not None), default=None) for x in q]
        return None if None in tops else sum(tops)

    assert found == {(a, b): score(x, y) for a, x in rows for b, y in rows}


def test_late_interaction_by_blocks(spark, tmp_path):
    """No row of the result is a row of a join: pairs are products of blocks."""
    r = np.random.default_rng(6)
    n = 5000
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(r.normal(size=(n, 64)).astype(np.float32)), pa.list_(pa.float32())), "label": pa.array(np.arange(n) % 5, pa.int32())}), tmp_path / "embeddings.parquet")
    df = plans.QUERIES["late_interaction"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.agg(F.count("*"), F.count_distinct("q"), F.count_distinct("d")).first()[:] == (n * n // 20, n // 20, n)


def test_rounding():
    """Bit for bit as DuckDB rounds, halves and huge numbers too."""
    x = np.array([0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, 0.0078125, -0.0078125, 0.1234565, 0.1234575, 1e300, 1e305, -1e305, np.nan, np.inf, -1e-9, 0.0, 123456789.1234565, 0.49999999999999994e-6])
    assert rounded(x, 6).tobytes() == np.array([by_sql(v) for v in x]).tobytes()


@pytest.mark.parametrize("dims", [None, (3, 8, 64), (64, 5)])
def test_dense_by_blocks(spark, dims):
    """The best of each topic and dimension, in order of rounded score and then of id, through ties, copies and odd vectors; pairs are no rows of a join."""
    v = np.array(halves(3000), np.float64)
    v[300:2500:2] = v[300]
    ids = [str(i) for i in np.random.default_rng(1).permutation(len(v))]
    docs = spark.createDataFrame(list(zip(ids, v.tolist(), strict=True)), "docno string, vector array<double>")
    asked = docs.where("docno % 50 = 0")
    run = dense(docs, asked.withColumnRenamed("docno", "qid"), 7, dims)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    found = {(r["dim"] if dims else 64, r["qid"], r["rank"]): (r["docno"], r["score"]) for r in run.collect()}
    expected, order = {}, np.argsort(np.array(ids))
    with np.errstate(all="ignore"):
        for q in np.flatnonzero([int(i) % 50 == 0 for i in ids]):
            s = np.zeros(len(v))
            for t in range(64):
                s = s + v[q, t] * v[:, t]
                if t + 1 in (dims or (64,)):
                    x = rounded(s, 6)[order]
                    top = np.lexsort((np.arange(len(x)), np.where(np.isnan(x), 0, -x), ~np.isnan(x)))[:7]
                    expected |= {(t + 1, ids[q], n): (ids[order[i]], x[i]) for n, i in enumerate(top)}
    assert len(found) == len(expected) and {k: repr(float(a[1])) + a[0] for k, a in found.items()} == {k: repr(float(a[1])) + a[0] for k, a in expected.items()}


def test_dense_of_other_shapes(spark):
    """Null vectors, null components and other lengths have no score, and come last."""
    docs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 1.0]), ("c", None), ("d", [1.0, None]), ("e", [3.0]), ("f", [1.0, 1.0])], "docno string, vector array<double>")
    found = sorted((r["qid"], r["rank"], r["docno"], r["score"]) for r in dense(docs, docs.where("docno in ('a', 'c', 'e')").withColumnRenamed("docno", "qid"), 4).collect())
    assert found == [("a", 0, "a", 5.0), ("a", 1, "b", 4.0), ("a", 2, "f", 3.0), ("a", 3, "c", None), *(("c", i, x, None) for i, x in enumerate("abcd")), ("e", 0, "e", 9.0), *(("e", i + 1, x, None) for i, x in enumerate("abc"))]


def test_metrics_by_class(spark):
    """The same as with every judgement listed."""
    r = np.random.default_rng(3)
    items = spark.createDataFrame([(f"d{i}", None if i % 11 == 0 else int(i**0.5) % 9) for i in range(200)], "docno string, label int")
    topics = spark.createDataFrame([(f"q{i}", None if i == 4 else i % 12) for i in range(24)], "qid string, label int")
    run = spark.createDataFrame([(s, f"q{q}", f"d{d}", n) for s in "xy" for q in range(0, 24, 1 + (s == "y")) for n, d in enumerate(r.permutation(200)[:30].tolist())], "system string, qid string, docno string, rank int")
    qrels = items.join(topics, "label").select("qid", "docno", F.lit(1).alias("relevance"))
    for more in ({}, {"cuts": (3, 10, 20), "ap_relevant": 1, "recall_at": 30}):
        a, b = per_query_by_class(run, items, topics, **more), per_query(run, qrels, **more)
        assert a.columns == b.columns
        assert sorted((x[0], x[1], *(round(y, 9) for y in x[2:])) for x in a.collect()) == sorted((x[0], x[1], *(round(y, 9) for y in x[2:])) for x in b.collect())
