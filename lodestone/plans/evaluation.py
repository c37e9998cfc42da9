"""Queries of retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.questions import judge_score, prompt
from ..functions.vectors import cosine, cut
from ..operators.agreement import arg_max, binarised, cohen_kappa, compare_systems, joined_grades, kendall_tau, weighted_kappa
from ..operators.joins import bounded
from ..operators.metrics import BINARY_METRICS, METRICS, against_baseline, leaderboard, means, per_query, per_query_by_class, relative_gain
from ..operators.pairs import keep_first
from ..operators.retrieval import bm25, containing, dense, lexical_counts, lexical_grade, max_sims, mean_pool, pool, pool_texts, term_counts, term_index, tokens
from ..operators.stats import row_mean, value_counts
from ..sources.tables import benchmark_corpus, table, texts
from .register import query

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def topics(spark: SparkSession, sf_dir: str, words: int = 12) -> DataFrame:
    """The first words of each benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.array_join(F.slice(tokens(F.col("text")), 1, words), " ").alias("query"))


def passage_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a passage are relevant to its topic."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("passage"))
    docs = benchmark_corpus(texts(spark, sf_dir))
    return containing(docs, passages).select("qid", "docno", F.lit(2).alias("relevance"))


CTE = f"""WITH docs AS (SELECT CAST(doc_id AS VARCHAR) AS docno, text, {WORDS} AS t FROM documents),
topics AS (SELECT CAST(item_id AS VARCHAR) AS qid, {WORDS}[1:12] AS q, text AS passage FROM benchmark),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(q) AS term FROM topics) GROUP BY ALL),
tf AS (SELECT docno, dl, term, count(*) AS tf FROM (SELECT docno, len(t) AS dl, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
scored AS (SELECT qid, docno, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * qtf), 6) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), size GROUP BY qid, docno),
tfonly AS (SELECT qid, docno, CAST(sum(tf * qtf) AS DOUBLE) AS score FROM tf JOIN asked USING (term) GROUP BY qid, docno),
ranked AS (SELECT 'bm25' AS system, qid, docno, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) - 1 AS rank FROM scored
  UNION ALL SELECT 'tf', qid, docno, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) - 1 FROM tfonly),
qrels AS (SELECT qid, docno, 2 AS relevance FROM docs, topics WHERE contains(docs.text, passage))"""


def runs(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """BM25 and plain term counts as two systems."""
    corpus, asked = benchmark_corpus(texts(spark, sf_dir)), topics(spark, sf_dir)
    index = term_index(corpus, asked)
    first = bm25(corpus, asked, k, index=index).withColumn("system", F.lit("bm25"))
    second = term_counts(corpus, asked, k, index).withColumn("system", F.lit("tf"))
    return first.unionByName(second)


METRIC_SQL = """,
run AS (SELECT * FROM ranked WHERE rank < 10),
ideal AS (SELECT qid, sum(CASE WHEN i < 5 THEN relevance / log2(i + 2) ELSE 0 END) AS idcg_5, sum(CASE WHEN i < 10 THEN relevance / log2(i + 2) ELSE 0 END) AS idcg_10, count(*) AS n_rel
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, docno) - 1 AS i FROM qrels) GROUP BY qid),
judged AS (SELECT run.*, coalesce(relevance, 0) AS rel FROM run LEFT JOIN qrels USING (qid, docno)),
seen AS (SELECT *, sum(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY system, qid ORDER BY rank) AS seen FROM judged),
sums AS (SELECT system, qid, sum(CASE WHEN rank < 5 THEN rel / log2(rank + 2) ELSE 0 END) AS dcg_5, sum(CASE WHEN rank < 10 THEN rel / log2(rank + 2) ELSE 0 END) AS dcg_10,
  sum(CASE WHEN rel >= 2 THEN seen / (rank + 1) ELSE 0 END) AS aps, sum(CASE WHEN rel >= 1 AND rank < 10 THEN 1 ELSE 0 END) AS found FROM seen GROUP BY ALL),
scores AS (SELECT s.system, ideal.qid, coalesce(dcg_5, 0) / idcg_5 AS ndcg_5, coalesce(dcg_10, 0) / idcg_10 AS ndcg_10, coalesce(aps, 0) / n_rel AS ap, coalesce(found, 0) / n_rel AS recall
  FROM (SELECT DISTINCT system FROM run) s CROSS JOIN ideal LEFT JOIN sums ON sums.system = s.system AND sums.qid = ideal.qid)"""


@query(CTE + METRIC_SQL + " SELECT system, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(ap), 6) AS ap, round(avg(recall), 6) AS recall FROM scores GROUP BY system")
def bm25_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexical systems by nDCG, AP and recall over passage topics."""
    return means(per_query(runs(spark, sf_dir), passage_qrels(spark, sf_dir)), METRICS)


@query(CTE + " SELECT qid, docno, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE system = 'bm25' AND rank < 10")
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(benchmark_corpus(texts(spark, sf_dir)), topics(spark, sf_dir), 10)


@query(CTE + " SELECT qid, docno, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE system = 'bm25' AND rank < 100")
def bm25_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual depth of a first stage."""
    return bm25(benchmark_corpus(texts(spark, sf_dir)), topics(spark, sf_dir), 100)


@query(CTE + " SELECT (SELECT count(*) FROM topics) AS topics, count(*) AS pairs, round(count(*) / (SELECT count(*) FROM topics), 6) AS mean_pool FROM (SELECT DISTINCT qid, docno FROM ranked WHERE rank < 5)")
def mean_pool_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-5 pool of both systems: pairs a topic."""
    r = runs(spark, sf_dir)
    return mean_pool(pool([r.where("system = 'bm25'"), r.where("system = 'tf'")], 5), topics(spark, sf_dir))


@query(CTE + """, a AS (SELECT qid, docno, CASE WHEN rank < 3 THEN 2 ELSE 1 END AS relevance FROM ranked WHERE system = 'bm25' AND rank < 10), b AS (SELECT qid, docno, CASE WHEN rank < 3 THEN 2 ELSE 1 END AS relevance FROM ranked WHERE system = 'tf' AND rank < 10)
SELECT a.relevance AS a, b.relevance AS b, count(*) AS n FROM a JOIN b USING (qid, docno) GROUP BY ALL""")
def joined_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of judgements, read off the two systems' ranks, joined by topic and document."""
    grade = F.when(F.col("rank") < 3, 2).otherwise(1).alias("relevance")
    r = runs(spark, sf_dir).select("system", "qid", "docno", grade)
    return joined_grades(r.where("system = 'bm25'"), r.where("system = 'tf'")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(CTE + METRIC_SQL + " SELECT system, qid, round(ndcg_5, 6) AS ndcg_5, round(ndcg_10, 6) AS ndcg_10, round(ap, 6) AS ap, round(recall, 6) AS recall FROM scores")
def per_query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = per_query(runs(spark, sf_dir), passage_qrels(spark, sf_dir))
    return s.select("system", "qid", *(F.round(m, 6).alias(m) for m in METRICS))


@query(
    CTE
    + METRIC_SQL
    + """ SELECT a.system, round(avg(a.ap), 6) AS ap, CAST(sum(CASE WHEN a.ap > b.ap THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN a.ap < b.ap THEN 1 ELSE 0 END) AS BIGINT) AS losses, count(*) AS n,
round(avg(a.ap - b.ap) / (stddev_samp(a.ap - b.ap) / sqrt(count(*))), 6) AS t FROM scores a JOIN scores b ON a.qid = b.qid AND b.system = 'tf' WHERE a.system <> 'tf' GROUP BY a.system"""
)
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences against the baseline: wins, losses and t."""
    s = against_baseline(per_query(runs(spark, sf_dir), passage_qrels(spark, sf_dir)), "tf", "ap", p=False)
    return s.select("system", F.round("ap", 6).alias("ap"), "wins", "losses", "n", F.round("t", 6).alias("t"))


@query()
def significance_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with p-values of Student's t, corrected by Bonferroni."""
    return against_baseline(per_query(runs(spark, sf_dir), passage_qrels(spark, sf_dir)), "tf", "ap")


@query(CTE + METRIC_SQL + " , m AS (SELECT system, round(avg(ndcg_10), 4) AS ndcg_10 FROM scores GROUP BY system) SELECT system, ndcg_10, CAST(row_number() OVER (ORDER BY ndcg_10 DESC, system) AS INTEGER) AS place, ndcg_10 = (SELECT max(ndcg_10) FROM m) AS best FROM m")
def leaderboard_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard(per_query(runs(spark, sf_dir), passage_qrels(spark, sf_dir)), "ndcg_10")


@query(CTE + " SELECT qid, count(*) AS pooled, round(count(*) / (SELECT count(*) FROM topics), 6) AS share FROM (SELECT DISTINCT qid, docno FROM ranked WHERE rank < 5) JOIN docs USING (docno) JOIN topics USING (qid) WHERE text IS NOT NULL GROUP BY qid")
def pooled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-5 pool of both systems with texts, by topic."""
    r, asked = runs(spark, sf_dir), topics(spark, sf_dir)
    p = pool([r.where("system = 'bm25'"), r.where("system = 'tf'")], 5)
    n = pool_texts(p, benchmark_corpus(texts(spark, sf_dir)), asked).groupBy("qid").agg(F.count("*").alias("pooled"))
    return n.join(F.broadcast(asked.agg(F.count("*").alias("all"))), how="cross").select("qid", "pooled", F.round(F.col("pooled") / F.col("all"), 6).alias("share"))


GRADE = "CASE WHEN len(q) = 0 THEN 0 WHEN s >= 0.9 THEN 3 WHEN s >= 0.6 THEN 2 WHEN s >= 0.3 THEN 1 ELSE 0 END"


@query(CTE + f" SELECT qid, {GRADE} AS relevance, count(*) AS n FROM (SELECT qid, list_distinct(q) AS q, len(list_intersect(list_distinct(q), t)) / len(list_distinct(q)) AS s FROM docs, topics) GROUP BY ALL")
def judged_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic with every document, graded; counts by topic and grade."""
    return lexical_counts(topics(spark, sf_dir), benchmark_corpus(texts(spark, sf_dir)))


@query(CTE + " SELECT qid, q.docno, relevance, len(t) AS n_tokens FROM qrels q JOIN topics USING (qid) JOIN docs ON docs.docno = q.docno")
def qrels_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements with their queries and documents."""
    docs = benchmark_corpus(texts(spark, sf_dir))
    q = passage_qrels(spark, sf_dir).join(bounded(topics(spark, sf_dir)), "qid").join(docs, "docno")
    return q.select("qid", "docno", "relevance", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


VECTORS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


@query(f"WITH {VECTORS} SELECT * FROM (SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(d.vec_id AS VARCHAR) AS docno, round(list_dot_product(q.e, d.e), 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, d.e), 6) DESC, CAST(d.vec_id AS VARCHAR)) - 1 AS INTEGER) AS rank FROM v q, v d WHERE q.vec_id % 20 = 0) WHERE rank < 10")
def dense_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhaustive dense retrieval: every twentieth vector is a stated topic."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("docno"), F.col("embedding").alias("vector"))
    return dense(e.drop("vec_id"), e.where("vec_id % 20 = 0").select(F.col("docno").alias("qid"), "vector"), 10)


DIMS = (8, 16, 32, 64)


def sweep_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of each dimension, and the labels of rows and of topics."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("vec_id").cast("string").alias("docno"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 20 = 0").withColumnRenamed("docno", "qid")
    run = dense(e.select("docno", "vector"), asked.select("qid", "vector"), 10, DIMS)
    return run.withColumn("system", F.col("dim").cast("string")), e.select("docno", "label"), asked.select("qid", "label")


@query(
    f"""WITH {VECTORS}, dims AS (SELECT unnest([8, 16, 32, 64]) AS dim),
run AS (SELECT * FROM (SELECT CAST(dim AS VARCHAR) AS system, CAST(q.vec_id AS VARCHAR) AS qid, CAST(d.vec_id AS VARCHAR) AS docno, q.label = d.label AS hit,
  row_number() OVER (PARTITION BY dim, q.vec_id ORDER BY round(list_dot_product(q.e[1:dim], d.e[1:dim]), 6) DESC, CAST(d.vec_id AS VARCHAR)) - 1 AS rank FROM v q, v d, dims WHERE q.vec_id % 20 = 0) WHERE rank < 10),
n AS (SELECT CAST(q.vec_id AS VARCHAR) AS qid, count(*) AS n_rel FROM v q JOIN v d USING (label) WHERE q.vec_id % 20 = 0 GROUP BY ALL),
s AS (SELECT system, qid, max(CASE WHEN hit AND rank < 1 THEN 1 ELSE 0 END) AS a1, sum(CASE WHEN hit AND rank < 3 THEN 1 ELSE 0 END) AS f3, sum(CASE WHEN hit AND rank < 5 THEN 1 ELSE 0 END) AS f5,
  coalesce(1 / (min(CASE WHEN hit THEN rank END) + 1), 0) AS mrr, sum(CASE WHEN hit THEN 1 / log2(rank + 2) ELSE 0 END) AS dcg FROM run GROUP BY ALL),
i AS (SELECT qid, sum(1 / log2(k + 2)) AS idcg FROM n, LATERAL (SELECT unnest(range(least(10, n_rel))) AS k) GROUP BY qid)
SELECT system, round(avg(a1), 6) AS accuracy_1, round(avg(f3 / 3), 6) AS precision_3, round(avg(f5 / 5), 6) AS precision_5, round(avg(f3 / n_rel), 6) AS recall_3, round(avg(mrr), 6) AS mrr, round(avg(dcg / idcg), 6) AS ndcg_10
FROM s JOIN n USING (qid) JOIN i USING (qid) GROUP BY system"""
)
def dimension_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary ranking metrics of embeddings cut to several dimensions, scored in one plan."""
    return means(per_query_by_class(*sweep_runs(spark, sf_dir), (10,)), BINARY_METRICS)


@query(f"WITH {VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e[1:16], b.e[1:16]), 6) AS cosine_16, round(list_cosine_similarity(a.e, b.e), 6) AS cosine_64 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cut_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of neighbouring rows, whole and of cut vectors with norms of the cut part."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(cosine(cut(F.col("x"), 16), cut(F.col("y"), 16)), 6).alias("cosine_16"), F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine_64"))


@query(f"WITH {VECTORS}, q AS (SELECT * FROM v WHERE vec_id % 20 = 0) SELECT q.vec_id AS q, d.vec_id AS d, round(greatest(list_dot_product(q.e[1:32], d.e[1:32]), list_dot_product(q.e[1:32], d.e[33:64])) + greatest(list_dot_product(q.e[33:64], d.e[1:32]), list_dot_product(q.e[33:64], d.e[33:64])), 6) AS score FROM q, v d")
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim of rows read as two half-length vectors each: every twentieth row against all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("docno"), F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("vectors"))
    found = max_sims(e, e.where("docno % 20 = 0").withColumnRenamed("docno", "qid"))
    return found.select(F.col("qid").alias("q"), F.col("docno").alias("d"), "score")


GRADES = """g AS (SELECT quality AS a, CASE WHEN n_chars >= 3000 THEN 1 WHEN n_chars >= 800 THEN 1 ELSE 0 END AS b, CASE WHEN n_chars >= 5000 THEN 3 WHEN n_chars >= 2000 THEN 2 WHEN n_chars >= 500 THEN 1 ELSE 0 END AS c, quality * 2 + toxic AS d
FROM documents JOIN labels USING (doc_id))"""


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and rule-based grades of the labelled documents."""
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("quality").alias("a"), F.when(n >= 800, 1).otherwise(0).alias("b"), F.when(n >= 5000, 3).when(n >= 2000, 2).when(n >= 500, 1).otherwise(0).alias("c"), (F.col("quality") * 2 + F.col("toxic")).alias("d"))


@query(f"WITH {GRADES} SELECT count(*) AS n, round(1 - sum((c - d) * (c - d)) / (sum(c * c) + sum(d * d) - 2.0 * sum(c) * sum(d) / count(*)), 6) AS qwk FROM g")
def agreement_qwk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_kappa(grades(spark, sf_dir), "c", "d")


@query(f"WITH {GRADES}, m AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(CAST(a AS DOUBLE)) AS pa, avg(CAST(b AS DOUBLE)) AS pb FROM g) SELECT n, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM m")
def agreement_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohen_kappa(grades(spark, sf_dir), "a", "b")


@query(
    f"""WITH {GRADES}, t AS (SELECT c, d, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY ALL), s AS (SELECT sum(sign(q.d - p.d) * p.n * q.n) AS s FROM t p JOIN t q ON p.c < q.c),
x AS (SELECT sum(m) * (sum(m) - 1) / 2 - sum(m * (m - 1) / 2) AS u FROM (SELECT sum(n) AS m FROM t GROUP BY c)), y AS (SELECT sum(m) * (sum(m) - 1) / 2 - sum(m * (m - 1) / 2) AS u FROM (SELECT sum(n) AS m FROM t GROUP BY d))
SELECT CAST((SELECT sum(n) FROM t) AS BIGINT) AS n, round(s / sqrt(x.u * y.u), 6) AS tau FROM s, x, y"""
)
def agreement_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kendall_tau(grades(spark, sf_dir), "c", "d")


@query(f"WITH {GRADES} SELECT CASE WHEN c >= 2 THEN 1 ELSE 0 END AS binary, count(*) AS n, sum(CASE WHEN d >= 2 THEN 1 ELSE 0 END)::BIGINT AS relevant FROM g GROUP BY ALL")
def relevance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades made binary, and how many are relevant by the other grader."""
    return grades(spark, sf_dir).groupBy(binarised(F.col("c")).alias("binary")).agg(F.count("*").alias("n"), F.count_if(F.col("d") >= 2).alias("relevant"))


@query("WITH m AS (SELECT source AS system, round(avg(n_chars), 2) AS x, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 1) AS y FROM documents GROUP BY source) SELECT system, x AS v_a, y AS v_b, CAST(rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) // 2 AS INTEGER) AS rank_a, CAST(floor(rank() OVER (ORDER BY y DESC) + (count(*) OVER (PARTITION BY y) - 1) / 2) AS INTEGER) AS rank_b FROM m")
def compared_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as systems: two metrics side by side with averaged descending ranks."""
    m = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("system")).agg(F.round(F.avg("n_chars"), 2).alias("x"), F.round(F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)), 1).alias("y"))
    return compare_systems(m.select("system", F.col("x").alias("v")), m.select("system", F.col("y").alias("v")), "v")


@query("WITH m AS (SELECT source, count(*) AS n, avg(n_chars) AS x FROM documents GROUP BY source) SELECT source, n, round(((n + x) / 2), 4) AS mean, n = (SELECT max(n) FROM m) AS best, round((x - (SELECT avg(n_chars) FROM documents)) / ((SELECT avg(n_chars) FROM documents) + 1e-9) * 100, 4) AS gain FROM m")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row means, gains over the whole, and the flagged best."""
    d = table(spark, sf_dir, "documents")
    m = d.groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("x")).join(F.broadcast(d.agg(F.avg("n_chars").alias("w"))), how="cross")
    m = m.select("source", "n", F.round(row_mean("n", "x"), 4).alias("mean"), F.round(relative_gain(F.col("x"), F.col("w")), 4).alias("gain"))
    return arg_max(m, "n")


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def value_counts_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(table(spark, sf_dir, "documents"), "lang")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(trim(text), '^[0-3]') THEN CAST(substr(trim(text), 1, 1) AS INTEGER) ELSE 0 END AS score, length('Q: ' || role || chr(10) || 'Code: ' || substr(text, 1, 100)) AS prompt_chars FROM conversations")
def parsed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades parsed from answers, and the length of the prompts built from them."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", judge_score(F.col("text")).alias("score"), F.length(prompt("Q: {query}\nCode: {code}", F.col("role"), F.col("text"), 100)).cast("long").alias("prompt_chars"))


@query("SELECT doc_id, text, lang FROM (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return keep_first(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "text", "lang")


@query(f"WITH {VECTORS} SELECT doc_id, {GRADE} AS grade FROM (SELECT doc_id, list_distinct({WORDS}) AS t, ['the', 'of', 'and', 'on'] AS q, len(list_intersect(['the', 'of', 'and', 'on'], list_distinct({WORDS}))) / 4 AS s FROM documents)")
def graded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in judge on one query."""
    return table(spark, sf_dir, "documents").select("doc_id", lexical_grade(F.lit("the of and on"), F.col("text")).alias("grade"))
