"""Queries of training pairs, samples, splits and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.questions import KEYWORDS, TEMPLATES, category, description, keywords, question
from ..operators.joins import bounded
from ..operators.pairs import dense_ids, draw, flat_pairs, keep_first, negatives, positive_pairs, relevant_classes, relevant_documents, sample, split, stratified, triplets, valid_chunks
from ..sources.tables import table
from ..streaming.chunking import event_counts
from .chunks import PARTS, _sha, parts
from .register import query


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks with symbol types and names made from their place, as flat chunk rows."""
    i = F.col("chunk_index")
    symbol = F.get(F.array(*map(F.lit, ("function", "class", "method", "module", "imports", "text"))), (F.col("doc_id") + i).cast("int") % 6)
    p = parts(spark, sf_dir).withColumn("chunk_id", F.concat("chunk_id", F.lit("_"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string"))).withColumn("symbol_type", symbol)
    path = F.concat(F.lit("data/codebases/"), F.when(F.col("doc_id") % 3 == 0, "crewai").otherwise("own_1"), F.when(i == 0, "/__init__.py").otherwise("/m.py"))
    return p.select("chunk_id", path.alias("file_path"), F.when(symbol == "text", "documentation").otherwise(symbol).alias("chunk_type"), "code", "symbol_type", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("lang") == "en", F.lit("Doc. More")).alias("docstring"))


FLAT = f"""{PARTS}, flat0 AS (SELECT *, ['function', 'class', 'method', 'module', 'imports', 'text'][(doc_id + chunk_index) % 6 + 1] AS symbol_type FROM parts),
flat AS (SELECT {_sha("text", "code || '_' || chunk_index")} || '_' || doc_id || '_' || chunk_index AS chunk_id, 'data/codebases/' || CASE WHEN doc_id % 3 = 0 THEN 'crewai' ELSE 'own_1' END || CASE WHEN chunk_index = 0 THEN '/__init__.py' ELSE '/m.py' END AS file_path,
  CASE WHEN symbol_type = 'text' THEN 'documentation' ELSE symbol_type END AS chunk_type, code, symbol_type, 'n' || doc_id AS name, CASE WHEN lang = 'en' THEN 'Doc. More' END AS docstring, doc_id % 3 = 0 AS crew FROM flat0),
valid AS (SELECT * FROM flat WHERE length(code) >= 50 AND NOT (symbol_type = 'imports' AND chunk_type = 'imports') AND NOT (contains(file_path, '__init__') AND length(code) < 100))"""
CATEGORY = "CASE WHEN symbol_type IN ('class', 'function', 'method', 'module') THEN symbol_type WHEN contains(lower(code), 'graph') OR contains(lower(code), 'workflow') OR contains(lower(code), 'state') THEN 'workflow' ELSE 'function' END"
FIRST = "CASE " + " ".join(f"WHEN cat = '{c}' THEN '{t[0].replace("{name}", "' || name || '")}'" for c, t in TEMPLATES.items()) + " END"
KEYS = "list_filter([" + ", ".join(f"'{k}'" for k in KEYWORDS) + "], lambda k: contains(lower(code), k))"


@query(f"WITH {FLAT} SELECT chunk_id, length(code) AS chars FROM valid")
def valid_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks fit for pairs."""
    return valid_chunks(flat(spark, sf_dir)).select("chunk_id", F.length("code").cast("long").alias("chars"))


@query(f"WITH {FLAT} SELECT chunk_id, cat AS category, {FIRST} AS question, array_to_string({KEYS}, ',') AS keys FROM (SELECT *, {CATEGORY} AS cat FROM flat)")
def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template categories, first questions and purpose words."""
    f, code, symbol = flat(spark, sf_dir), F.col("code"), F.col("symbol_type")
    return f.select("chunk_id", category(code, symbol).alias("category"), question(code, symbol, F.col("name")).alias("question"), F.array_join(keywords(code), ",").alias("keys"))


@query(
    f"WITH {FLAT}, s AS (SELECT *, {CATEGORY} AS cat FROM valid ORDER BY sha256('42:' || chunk_id), chunk_id LIMIT 50) SELECT chunk_id AS document_id, replace(unnest(CASE "
    + " ".join(f"WHEN cat = '{c}' THEN [{', '.join("'" + x.replace("'", "''") + "'" for x in t)}]" for c, t in TEMPLATES.items())
    + " END), '{name}', name) AS anchor, length(code) AS positive_chars, CASE WHEN crew THEN 'crewai' ELSE 'own' END AS framework FROM s"
)
def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and code pairs of 50 sampled chunks."""
    p = flat_pairs(positive_pairs(flat(spark, sf_dir), 50))
    return p.select("document_id", "anchor", F.length("positive").cast("long").alias("positive_chars"), "framework")


NEGATIVES = f"""{FLAT}, k AS (SELECT chunk_id, code, symbol_type, name, crew, {KEYS} AS keys, sha256('42:' || chunk_id) AS d FROM valid), nb AS (SELECT greatest(1, count(*) // 50) AS nb FROM k),
b AS (SELECT k.*, CAST(floor(CAST(CAST('0x' || substr(d, 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 * nb) AS BIGINT) AS block FROM k, nb),
a AS (SELECT * FROM b ORDER BY d, chunk_id LIMIT 40),
near AS (SELECT DISTINCT a.chunk_id AS a, a.keys AS ak, a.symbol_type AS asym, a.d AS ad, a.block AS home, (a.block + i) % nb AS block FROM a, nb, (SELECT unnest([0, 1, 2]) AS i)),
p AS (SELECT a, c.chunk_id AS c, row_number() OVER (PARTITION BY a ORDER BY CASE WHEN c.block > home OR (c.block = home AND c.d > ad) THEN 0 ELSE 1 END, c.d, c.chunk_id) AS n,
  CASE WHEN len(ak) = 0 OR len(c.keys) = 0 THEN asym <> c.symbol_type ELSE len(list_intersect(ak, c.keys)) / len(list_distinct(list_concat(ak, c.keys))) < 0.3 END AS differs FROM near JOIN b c ON c.block = near.block AND c.chunk_id <> a),
neg AS (SELECT a AS chunk_id, arg_min(c, CASE WHEN differs THEN n ELSE n + 1000 END) AS negative_id FROM p WHERE n <= 50 GROUP BY a)"""


@query(f"WITH {NEGATIVES} SELECT chunk_id, negative_id FROM neg")
def chosen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For 40 sampled anchors, the first candidate that differs in purpose."""
    valid = valid_chunks(flat(spark, sf_dir))
    return negatives(sample(valid, 40, "chunk_id"), valid)


@query(f"WITH {NEGATIVES} SELECT chunk_id AS document_id, {FIRST} AS anchor, length(code) AS positive_chars, length(ncode) AS negative_chars, CASE WHEN crew THEN 'crewai' ELSE 'own' END AS framework FROM (SELECT a.*, {CATEGORY.replace('code', 'a.code').replace('symbol_type', 'a.symbol_type')} AS cat, n.code AS ncode FROM a JOIN neg USING (chunk_id) JOIN valid n ON n.chunk_id = negative_id)")
def sampled_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(flat(spark, sf_dir), 40)
    return t.select("document_id", "anchor", F.length("positive").cast("long").alias("positive_chars"), F.length("negative").cast("long").alias("negative_chars"), "framework")


@query(f"WITH {FLAT} SELECT chunk_id, CASE WHEN docstring <> '' THEN 'Doc' WHEN contains(lower(code), 'stategraph') OR contains(lower(code), 'workflow') THEN 'building a stateful workflow' WHEN contains(lower(code), 'agent') THEN 'creating an AI agent' WHEN contains(lower(code), 'tool') THEN 'implementing a tool' WHEN contains(lower(code), 'async') THEN 'async operations' WHEN contains(lower(code), 'api') OR contains(lower(code), 'request') THEN 'API interactions' WHEN contains(lower(code), 'database') OR contains(lower(code), 'sql') THEN 'database operations' WHEN contains(lower(code), 'parse') THEN 'parsing data' WHEN contains(lower(code), 'format') THEN 'formatting output' WHEN contains(lower(code), 'template') THEN 'creating templates' WHEN contains(lower(code), 'filter') THEN 'filtering data' WHEN contains(lower(code), 'search') THEN 'search functionality' WHEN contains(lower(code), 'create') OR contains(lower(code), 'build') THEN 'building ' || name ELSE 'implementing ' || name END AS description FROM flat")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir).select("chunk_id", description(F.col("code"), F.col("name"), F.col("docstring")).alias("description"))


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 21")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(table(spark, sf_dir, "documents"), 21, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id), doc_id) AS n FROM labels) WHERE n <= 20")
def stratified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty labels of each class."""
    return stratified(table(spark, sf_dir, "labels"), "quality", 20, "doc_id").select("doc_id", "quality")


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) % 10000 < 9000 THEN 'train' ELSE 'test' END AS split FROM documents")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split")


@query("SELECT text, CAST(row_number() OVER (ORDER BY o, text) - 1 AS BIGINT) AS dense_id FROM (SELECT text, min(doc_id) AS o FROM documents GROUP BY text)")
def dense_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of distinct texts by first appearance."""
    return dense_ids(table(spark, sf_dir, "documents"), "text", "doc_id")


TURNS = "SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


@query(TURNS)
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn with the assistant's next."""
    return turn_pairs(spark, sf_dir)


@query(f"SELECT lower(question) AS q, min(conv_id * 1000 + turn) AS place FROM ({TURNS}) GROUP BY 1")
def distinct_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of questions that are equal whatever their case."""
    p = turn_pairs(spark, sf_dir).select(F.lower("question").alias("q"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"))
    return keep_first(p, "q", "place")


@query("SELECT docno, min(docno) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS copies FROM (SELECT CAST(doc_id AS VARCHAR) AS docno, text FROM documents)")
def relevant_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its text: the first that has it, and how many have."""
    return relevant_classes(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("document_id"), F.col("doc_id").cast("string").alias("docno")))


@query("SELECT q.conv_id, CAST(count(*) AS BIGINT) AS turns, array_to_string(list_sort(list(DISTINCT CAST(d.turn AS VARCHAR))), ',') AS docnos FROM (SELECT DISTINCT conv_id FROM conversations) q JOIN conversations d USING (conv_id) GROUP BY q.conv_id")
def relevant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation all turns of it, as the relevant documents of a query."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("string").alias("docno"), "conv_id")
    found = relevant_documents(c.select("document_id", F.col("conv_id").alias("qid")).distinct(), c)
    return found.join(c.groupBy(F.col("conv_id").alias("qid")).agg(F.count("*").alias("turns")), "qid").select(F.col("qid").alias("conv_id"), "turns", F.array_join("docnos", ",").alias("docnos"))


@query("SELECT doc_id, sha256('7:' || doc_id || ':' || lang) AS place FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)")
def draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded order of the labelled documents."""
    labelled = bounded(table(spark, sf_dir, "labels").select("doc_id").distinct())
    return table(spark, sf_dir, "documents").join(labelled, "doc_id", "left_semi").select("doc_id", draw(7, "doc_id", "lang").alias("place"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming count, run over the stored events."""
    return event_counts(table(spark, sf_dir, "events"))
