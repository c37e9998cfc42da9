"""Sources, sinks, routes, Python chunks, repository metadata, judging and streams, on small files written here."""

from __future__ import annotations

import itertools
import json
import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.paths import folder_repo_name
from lodestone.functions.text import binary_bytes, without_nul
from lodestone.operators import agreement, chunk_files, chunk_python, context, repo_metadata, retrieval, sinks, stats
from lodestone.sources import files, manifests, tables
from lodestone.streaming import chunking

MODULE = b'''"""Doc of it."""
import os
from a import b


@cached
class Tree(Base):
    """A tree."""

    import sys

    @property
    def leaf(self):
        def inner():
            return 1
        return inner

    class Node:
        def up(self):
            """Up."""


class Bare:
    def own(self):
        pass


async def grow(x):
    return x
'''


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def text_of(folder) -> list[str]:
    return [line for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]


@pytest.fixture
def tree(tmp_path):
    made = {"a.py": b"x = 1\n", "pkg/__init__.py": b"", "pkg/B.PY": b"y", "data.bin": b"a\x00b", "empty.txt": b"", ".hidden": b"h", ".github/w.yml": b"w", "node_modules/m.js": b"m", ".git/config": b"c", "latin.txt": "é".encode() * 40}
    for name, content in made.items():
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return tmp_path / "r"


def test_listing(spark, tree):
    listed = rows(files.list_files(spark, str(tree)), "relative_path", "size", "extension")
    assert listed == [("a.py", 6, ".py"), ("data.bin", 3, ".bin"), ("empty.txt", 0, ".txt"), ("latin.txt", 80, ".txt"), ("pkg/B.PY", 1, ".py"), ("pkg/__init__.py", 0, ".py")]
    assert [r[0] for r in rows(files.list_files(spark, str(tree), {".py"}), "relative_path")] == ["a.py", "pkg/B.PY", "pkg/__init__.py"]
    rich = files.list_files(spark, str(tree), rich_metadata=True)
    assert sorted(rows(rich, "relative_path", "is_binary")) == [("a.py", False), ("empty.txt", False), ("pkg/B.PY", False), ("pkg/__init__.py", False)]
    counted = rows(stats.listing_stats(rich))
    assert counted == [(4, 7, 0, 4)]
    kept = files.list_files(spark, str(tree), rich_metadata=True, skip_binary=False)
    assert kept.count() == 6 and rows(stats.listing_stats(kept))[0][2:] == (0, 0)


def test_reading(spark, tree):
    df = files.read_files(files.list_files(spark, str(tree)).union(spark.createDataFrame([("/none", "none", 1, "")], files.LISTING)))
    assert {r.relative_path: r.content and bytes(r.content) for r in df.collect()}["none"] is None
    assert {r.relative_path: r.content and bytes(r.content) for r in df.collect()}["data.bin"] == b"a\x00b"


def test_byte_test(spark):
    df = spark.createDataFrame([(1, b""), (2, b"abc\n"), (3, b"a\x00"), (4, "ééééé".encode()), (5, None), (6, b"a" * 1024 + b"\x00"), (7, b"a" * 8 + b"\xff" * 2)], "i int, content binary")
    assert dict(rows(df, "i", binary_bytes("content"))) == {1: False, 2: False, 3: True, 4: True, 5: True, 6: False, 7: False}


def test_nul(spark):
    assert rows(spark.createDataFrame([("a\x00b\x00",), (None,)], "t string"), without_nul("t")) == [("ab",), (None,)]


def test_readme(spark):
    df = spark.createDataFrame([("README.txt", "t" * 6000), ("README.md", None), ("docs/README.md", "no"), ("readme.md", "low")], "relative_path string, text string")
    assert rows(files.readme(df)) == [("t" * 5000,)]
    assert rows(files.readme(df.where("relative_path = 'docs/README.md'"))) == []


def test_manifests(spark):
    made = [("requirements.txt", "a==1\n# no\n\n-r more.txt\nb>=2\nc~=1\nd"), ("pyproject.toml", '[project]\ndependencies = ["e>=1", "f"]'), ("Pipfile", "[packages]\ng = '*'"), ("package.json", '{"dependencies": {"h": "1", "i": "2"}, "devDependencies": {"h": "1"}}'), ("Dockerfile", "FROM x")]
    df = spark.createDataFrame(made, "relative_path string, text string")
    assert rows(manifests.dependencies(df)) == [(["a", "b", "c", "d", "e", "f"], ["h", "i", "h"], True)]
    broken = spark.createDataFrame([("pyproject.toml", "[project"), ("package.json", "{")], "relative_path string, text string")
    assert rows(manifests.dependencies(broken)) == [([], [], False)]


def git(at, *args):
    subprocess.run(["git", "-C", str(at), "-c", "user.name=N", "-c", "user.email=e@x", *args], check=True, capture_output=True)


def test_git(spark, tmp_path):
    at = tmp_path / "own_test"
    at.mkdir()
    git(at, "init", "-q", "-b", "main")
    (at / "f").write_text("x")
    git(at, "add", "f")
    git(at, "commit", "-qm", "one | two")
    git(at, "branch", "side")
    git(at, "tag", "v1")
    r = manifests.git_metadata(spark, str(at)).first()
    assert (r.remote_url, r.branch, r.branch_count, r.branches, r.tag_count, r.tags) == ("", "main", 2, ["main", "side"], 1, ["v1"])
    assert (r.latest_commit.author, r.latest_commit.email, r.latest_commit.message) == ("N", "e@x", "one ")
    none = manifests.git_metadata(spark, str(tmp_path / "no")).first()
    assert (none.branch, none.branch_count, none.latest_commit.hash) == ("", 0, "")
    to = str(tmp_path / "copy")
    assert manifests.clone(f"file://{at}", to) == to == manifests.clone("file:///none", to)
    assert manifests.clone("file:///none", str(tmp_path / "other")) is None
    assert rows(spark.range(1), folder_repo_name(F.lit("own_test")), folder_repo_name(F.lit("own_LOCAL")), folder_repo_name(F.lit("own"))) == [("own", "own", "own")]


def test_tables(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "code": "é"}\n\nnot json\n{"chunk_id": "b"}\n')
    assert rows(tables.load_chunks(spark, str(tmp_path / "c.jsonl")), "chunk_id", "code", "language") == [("a", "é", None), ("b", None, None)]
    (tmp_path / "a.json").write_text('[\n{"x": 1},\n{"x": 2}\n]')
    assert rows(tables.load_json(spark, str(tmp_path / "a.json"), "x int", lines=False)) == [(1,), (2,)]
    (tmp_path / "t.csv").write_text('q,t\n1,"a ""b"",\nc"\n')
    assert rows(tables.load_csv(spark, str(tmp_path / "t.csv"), "q int, t string")) == [(1, 'a "b",\nc')]
    docs = spark.createDataFrame([(1, "x", "en"), (2, "y", "de")], "doc_id long, text string, lang string")
    assert rows(tables.benchmark_corpus(docs, "de")) == [("2", "y")]


def test_trec(spark, tmp_path):
    qrels = spark.createDataFrame([("1", "d1", 2), ("1", "d2", 0)], "qid string, docno string, relevance int")
    sinks.write_qrels(qrels, str(tmp_path / "qrels"))
    assert sorted(text_of(tmp_path / "qrels")) == ["1\t0\td1\t2", "1\t0\td2\t0"]
    assert sorted(rows(tables.load_qrels(spark, str(tmp_path / "qrels")), "qid", "docno", "relevance")) == sorted(rows(qrels))
    run = spark.createDataFrame([("1", "d1", 0, 1.5)], "qid string, docno string, rank int, score double")
    sinks.write_run(run, str(tmp_path / "run"), "s")
    assert rows(tables.load_run(spark, str(tmp_path / "run"))) == [("1", "d1", 0, 1.5, "s")]


ROUTED = [
    ("p/m.py", MODULE),
    ("p/bad.py", b"def ("),
    ("p/latin.py", b"x = '\xe9'\n"),
    ("p/r.md", b"# Top\nIntro words here.\n## How\n```bash\nls -l\n```\ntail\n"),
    ("p/o.json", '{"b": "é", "a": [1]}'.encode()),
    ("p/l.json", b"[1]"),
    ("p/x.json", b"{x"),
    ("p/c.YML", b"a: 1\n"),
    ("p/p.toml", b"[a]\n"),
    ("p/requirements.txt", b"a==1\n-e .\n"),
    ("p/Dockerfile", b"FROM x"),
    ("p/docker-compose.yml", b"v: 1"),
    ("p/README", b"read\n"),
    ("p/LICENSE", b"use"),
    ("p/long.txt", b"\n".join(b"%d" % i for i in range(250))),
    ("p/odd.bin", bytes(range(1, 9)) * 5),
    ("p/odd.dat", b"ok\xff text"),
    ("p/none.txt", None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    df = chunk_files.chunk_files(spark.createDataFrame(ROUTED, "path string, content binary"), F.create_map(F.lit("repo"), F.lit("r")))
    return df.persist()


def of(chunks, path):
    return sorted(chunks.where(F.col("file_path") == path).collect(), key=lambda r: (r.span.start_line or 0, r.metadata.chunk_index or 0))


def test_document_routes(chunks):
    md = of(chunks, "p/r.md")
    assert [(c.chunk_type, c.language, c.code, c.ast.name, c.metadata.heading, c.metadata.heading_path) for c in md] == [
        ("documentation", "markdown", "# Top\nIntro words here.", "r.md", None, None),
        ("documentation", "bash", "ls -l", "r.md", "How", "How"),
        ("documentation", "markdown", "tail", "r.md", "How", "How"),
    ]
    (o,), (listed,), (x,) = of(chunks, "p/o.json"), of(chunks, "p/l.json"), of(chunks, "p/x.json")
    assert (o.chunk_type, o.code, o.metadata.config_keys) == ("configuration", json.dumps({"b": "é", "a": [1]}, indent=2), ["b", "a"])
    assert (listed.language, listed.metadata.config_keys) == ("json", []) and (x.chunk_type, x.code) == ("text", "{x")
    (yml,), (toml,) = of(chunks, "p/c.YML"), of(chunks, "p/p.toml")
    assert (yml.language, yml.code, yml.metadata.file_type) == ("yaml", "a: 1\n", "yaml_config") and (toml.language, toml.metadata.file_type) == ("toml", "toml_config")
    (wants,), (docker,), (compose,) = (of(chunks, f"p/{n}") for n in ("requirements.txt", "Dockerfile", "docker-compose.yml"))
    assert (wants.chunk_type, wants.language, wants.metadata.dependencies) == ("configuration", "requirements", ["a", "-e ."])
    assert (docker.chunk_type, docker.language) == ("script", "dockerfile") and (compose.chunk_type, compose.language) == ("configuration", "yaml")
    (readme,), (use,) = of(chunks, "p/README"), of(chunks, "p/LICENSE")
    assert (readme.metadata.is_readme, readme.metadata.is_license, readme.chunk_id[:4]) == (True, False, "doc_")
    assert (use.metadata.is_readme, use.metadata.is_license, use.chunk_id[:8]) == (False, True, "license_")
    long = of(chunks, "p/long.txt")
    assert [(c.metadata.chunk_index, c.metadata.total_lines, c.span.start_line) for c in long] == [(0, 100, 1), (1, 100, 1), (2, 50, 1)]
    assert of(chunks, "p/odd.bin") == [] and of(chunks, "p/none.txt") == []
    assert [c.code for c in of(chunks, "p/odd.dat")] == ["ok text"]
    assert {json.dumps(r.metadata.repo_info) for r in chunks.collect()} == {'{"repo": "r"}'}


def test_python_chunks(chunks):
    found = of(chunks, "p/m.py")
    by = {c.ast.name: c for c in found}
    assert [(c.chunk_type, c.ast.name, c.ast.parent) for c in found] == [("module", "m", None), ("class", "Tree", "module"), ("method", "leaf", "Tree"), ("class", "Node", "module"), ("method", "up", "Node"), ("class", "Bare", "module"), ("method", "own", "Bare"), ("function", "grow", "module")]
    assert by["m"].ast.docstring == "Doc of it." and by["Tree"].ast.docstring == "A tree." and by["up"].ast.docstring == "Up."
    assert by["m"].ast.imports == ["import os", "from a import b", "import sys"] and by["Tree"].ast.imports == ["import sys"] and by["grow"].ast.imports == []
    assert by["Tree"].ast.decorators == ["cached"] and by["leaf"].ast.decorators == ["property"] and by["Bare"].ast.decorators == []
    h = {n: c.hierarchy for n, c in by.items()}
    ids = {n: c.chunk_id for n, c in by.items()}
    assert {n: x.depth for n, x in h.items()} == {"m": 0, "Tree": 1, "leaf": 2, "Node": 2, "up": 3, "Bare": 1, "own": 2, "grow": 1}
    assert h["up"].lineage == [ids["m"], ids["Tree"], ids["Node"]] and h["Node"].parent_id == ids["Tree"]
    assert [h[n].sibling_index for n in ("Tree", "Bare", "grow", "leaf", "Node", "up")] == [0, 1, 2, 0, 1, 0]
    for n, x in h.items():  # children are linked both ways
        assert x.children_ids == [c.chunk_id for c in found if c.hierarchy.parent_id == ids[n]]
    lines = MODULE.split(b"\n")
    starts = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
    for n in ("Tree", "Bare", "own", "grow"):  # nodes within depth three: exact places
        s = by[n].span
        assert MODULE[s.start_byte : s.end_byte].decode() == by[n].code
    for n in ("leaf", "Node", "up"):  # what a decorated class holds lies deeper: whole lines
        s = by[n].span
        assert (s.start_byte, s.end_byte) == (starts[s.start_line - 1], starts[s.end_line])
    assert (by["m"].span.start_byte, by["m"].span.end_byte) == (0, len(MODULE))
    assert of(chunks, "p/bad.py") == []
    assert [(c.chunk_type, c.code) for c in of(chunks, "p/latin.py")] == [("text", "x = ''\n")]


def test_parents_and_table_function(spark, chunks):
    up = {r.name: (r.parent_type, r.parent_name) for r in chunk_python.with_parents(chunks.where("file_path = 'p/m.py'")).select("ast.name", "parent_type", "parent_name").collect()}
    assert up["m"] == (None, None) and up["Tree"] == ("module", "m") and up["up"] == ("class", "Node")
    chunk_python.register(spark)
    spark.createDataFrame(ROUTED[:2], "path string, content binary").createOrReplaceTempView("sources_of_test")
    got = rows(spark.sql("SELECT c.chunk_type, c.name, c.start_line, c.end_line FROM sources_of_test s, LATERAL python_chunks(s.path, s.content) c"))
    assert len(got) == 8 and ("class", "Bare", 23, 25) in got


def test_exports(spark, chunks, tmp_path):
    some = chunks.where("file_path in ('p/m.py', 'p/o.json')").withColumn("code", F.concat("code", F.lit("\x00"))).withColumn("language", F.when(F.col("file_path") == "p/m.py", "").otherwise(F.col("language")))
    sinks.export_chunks(some, str(tmp_path / "out"))
    got = [json.loads(x) for x in text_of(tmp_path / "out")]
    assert len(got) == 9 and {g["language"] for g in got} == {"python", "json"} and not any("\x00" in g["code"] for g in got)
    assert set(got[0]) == {"chunk_id", "file_path", "language", "chunk_type", "code", "ast", "span", "hierarchy", "metadata"}
    assert "lineage" not in got[0]["hierarchy"] and "char_count" not in got[0]["span"] and "parent" in got[0]["ast"]
    assert sorted(rows(tables.load_chunks(spark, str(tmp_path / "out")), "chunk_id")) == sorted(rows(some, "chunk_id"))
    summary = sinks.export_with_context(some, str(tmp_path / "context"), {"name": "r"})
    with_context = [json.loads(x) for x in text_of(tmp_path / "context")]
    assert all(g["metadata"]["repo_info"] == {"name": "r"} for g in with_context) and any("\x00" in g["code"] for g in with_context)
    assert {json.dumps(g["metadata"]["repository_context"]) for g in with_context if g["file_path"] == "p/m.py"} == {'{"similar_files": ["p/o.json"], "total_similar_files": 1}'}
    assert {("file_type", ".py", 8), ("file_type", ".json", 1), ("chunk_type", "class", 3)} <= set(rows(summary, "dimension", "value", "n"))
    sinks.write_repo_stats(some, str(tmp_path / "stats"))
    assert {"dimension": "file_type", "value": ".py", "n": 8} in [json.loads(x) for x in text_of(tmp_path / "stats")]
    sinks.write_dataset_metadata(some, str(tmp_path / "meta"), "d", "2")
    (meta,) = [json.loads(x) for x in text_of(tmp_path / "meta")]
    assert (meta["dataset_name"], meta["dataset_version"], meta["languages"], meta["total_files"], meta["total_chunks"], meta["created_at"][-1]) == ("d", "2", ["", "json"], 2, 9, "Z")
    assert ("symbol_type", "class", 3) in rows(stats.dataset_stats(some), "dimension", "value", "n")


def test_pair_files(spark, tmp_path):
    pairs = spark.createDataFrame([("a", None), ("é", "x")], "anchor string, positive string")
    sinks.write_pairs(pairs, str(tmp_path / "p"), "both")
    made = [{"anchor": "a", "positive": None}, {"anchor": "é", "positive": "x"}]
    key = lambda r: r["anchor"]
    assert sorted((json.loads(x) for x in text_of(tmp_path / "p.jsonl")), key=key) == made
    (whole,) = text_of(tmp_path / "p.json")
    assert sorted(json.loads(whole), key=key) == made and "é" in whole
    with pytest.raises(ValueError):
        sinks.write_pairs(pairs, str(tmp_path / "q"), "xml")
    sinks.write_split(pairs.withColumn("split", F.when(F.col("positive").isNull(), "train").otherwise("test")), str(tmp_path / "s"))
    assert [json.loads(x)["anchor"] for side in ("train", "test") for x in text_of(tmp_path / "s" / side)] == ["a", "é"]
    sinks.write_csv(pairs.where("positive = 'x'").coalesce(1), str(tmp_path / "c"))
    assert text_of(tmp_path / "c") == ["anchor,positive", "é,x"]


def test_repository(spark):
    names = ["main.py", "src/agent.py", "src/app.py", "run.py", "cli.py", "x/server.py", "Tools/t.py", ".git/HEAD", ".github/w.yml", "config_a.py", "settings.py", ".env.local", "a.toml", "node_modules/p.json"]
    df = spark.createDataFrame([(n, f"/r/{n}", 1 << 20, "." + n.rsplit(".", 1)[-1] if "." in n.rsplit("/", 1)[-1][1:] else "", "class MyAgent:\n  pass" if n == "main.py" else "import crewai" if n == "cli.py" else "x") for n in names], "relative_path string, path string, size long, extension string, text string")
    assert rows(repo_metadata.structure(df)) == [([".github", "Tools", "node_modules", "src", "x"], True)]
    assert rows(repo_metadata.entry_points(df)) == [(["main.py", "src/app.py", "run.py", "cli.py", "x/server.py"],)]
    assert rows(repo_metadata.config_files(df)) == [([".env.local", "a.toml", "config_a.py", "settings.py"],)]
    found = dict(rows(repo_metadata.agentic_detection(df, spark.createDataFrame([("haystack-ai",)], "package string"))))
    assert found["haystack"] == "dependency" and found["crewai"] == "usage" and found["custom_agents"] == "implementation" and "camel" not in found
    assert rows(stats.tree_stats(df)) == [(13, 13.0, [".json", ".local", ".py", ".toml", ".yml"])]
    assert rows(stats.repo_size(df)) == [(14.0, 12)]
    one = repo_metadata.basic(df, "/r/own_copy/", None).first()
    assert (one.repo_name, one.local_path, one.size_mb, one.file_count) == ("own", "/r/own_copy/", 14.0, 12) and "T" in one.extracted_at
    assert repo_metadata.basic(df, "/r", "https://h/o/name.git/").first().repo_name == "name"


def test_context_by_repository(spark):
    df = spark.createDataFrame([("r", f"f{i}") for i in range(8)] + [("s", "only"), ("s", None)], "repo string, file_path string")
    got = {(r.repo, r.file_path): (r.similar_files, r.total_similar_files) for r in context.cross_file_context(df, repo="repo").collect()}
    assert got["r", "f0"] == (["f1", "f2", "f3", "f4", "f5"], 7) and got["r", "f7"] == (["f0", "f1", "f2", "f3", "f4"], 7)
    assert got["s", "only"] == (None, None) and got["s", None] == (["only"], 1)


def test_judging_in_batches(spark, tmp_path):
    pooled = spark.createDataFrame([("1", f"d{i}", "red fox", "the red fox" if i % 2 else "a hen") for i in range(9)], "qid string, docno string, query string, text string")
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.IntegerType())
    def grade(query: pd.Series, text: pd.Series) -> pd.Series:
        calls.add(len(query))
        return pd.Series([3 if q in t else 0 for q, t in zip(query, text, strict=True)])

    expected = sorted(("1", f"d{i}", 3 * (i % 2)) for i in range(9))
    for _ in range(2):  # the second time nothing is judged again
        assert sorted(rows(retrieval.judge_batches(pooled, str(tmp_path), 3, grade))) == expected
        assert calls.value == 9


def test_index_is_built_once(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "red fox red"), ("b", "hen"), ("c", None)], "docno string, text string")
    topics = spark.createDataFrame([("1", "red hen")], "qid string, query string")
    index = retrieval.term_index(corpus, topics, str(tmp_path / "i"))
    assert sorted(rows(index)) == [("a", 3, "", 1), ("a", 3, "red", 2), ("b", 1, "", 1), ("b", 1, "hen", 1), ("c", 0, "", 1)]
    again = retrieval.term_index(corpus.where("false"), topics, str(tmp_path / "i"))
    assert rows(retrieval.bm25(corpus, topics, index=again)) == rows(retrieval.bm25(corpus, topics))


def test_passages(spark):
    corpus = spark.createDataFrame([("a", "x one Two three four five six y"), ("b", "one two three four five six"), ("c", "zone Two three four five sixty"), ("d", "tiny bit"), ("e", None)], "docno string, text string")
    passages = spark.createDataFrame([("1", "one Two three four five six"), ("2", "tiny"), ("3", ""), ("4", "Two three four five six seven")], "qid string, passage string")
    assert sorted(rows(retrieval.containing(corpus, passages))) == [("1", "a"), ("1", "c"), ("2", "d")]


def test_tau(spark):
    pairs = [(i * 7 % 13, i * i % 11) for i in range(60)]
    sign = lambda v: (v > 0) - (v < 0)
    s = u = v = 0
    for (a, b), (c, d) in itertools.combinations(pairs, 2):
        s, u, v = s + sign(a - c) * sign(b - d), u + (a != c), v + (b != d)
    got = agreement.kendall_tau(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
    assert got.n == 60 and got.tau == pytest.approx(s / (u * v) ** 0.5, abs=1e-6)


def test_joined_grades(spark):
    left = spark.createDataFrame([("1", "a", 2), ("1", "b", 0), ("2", "a", 1)], "qid string, docno string, relevance int")
    right = spark.createDataFrame([("1", "a", 1), ("2", "a", 1), ("2", "b", 0)], "qid string, docno string, relevance int")
    assert sorted(rows(agreement.joined_grades(left, right))) == [("1", "a", 2, 1), ("2", "a", 1, 1)]


def test_streams(spark, tmp_path):
    made = spark.createDataFrame([(f"f{i}", "\n".join(str(j) for j in range(i * 150)), f"2024-01-01 0{i}:00:00") for i in range(4)], "path string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    made.union(made.where("path = 'f2'")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    chunking.run_to_files(chunking.stream_text_chunks(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = chunk_files.text_chunks(made)
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")), "chunk_id")) == sorted(set(rows(batch, "chunk_id")))  # equal chunks come once
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 02:00:00", "b", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    counts = chunking.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    chunking.run_to_files(counts, str(tmp_path / "counts"), str(tmp_path / "check2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "counts")), "event_type", "n", "total") == [("a", 2, 3.0)]  # the last window is still open
