"""Null, repeated, negative and huge ids, empty tables, clashing columns, long texts and ties; alike over one and many partitions."""

from __future__ import annotations

import hashlib
import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.language_id import Model, Parser, TextAutomaton, identify, plain, sample_texts
from lodestone.llm.mixing import mix, mixed_texts, sainte_lague
from lodestone.llm.near_dedup import deduplicated, near_duplicates
from lodestone.llm.nearest import nearest
from lodestone.llm.packing import Stock, pack_documents
from lodestone.llm.quality import STATISTICS, Ensemble, fit, hold, score_quality, statistics, with_statistics
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.suffix_dedup import suffix_dedup
from lodestone.llm.vector_dedup import near_vectors

from .test_operators import WORD, cover, runs

BIG = (1 << 63) - 2
R = random.Random(8)
VOCABULARY = ["".join(R.choices("abcdefghijklmnop", k=R.randint(3, 8))) for _ in range(400)]


def words(n: int) -> str:
    return " ".join(R.choices(VOCABULARY, k=n))


PASSAGE = words(60)
ODD_IDS = [
    (None, f"{words(30)} {PASSAGE} {words(9)}"), (None, f"{words(12)} {PASSAGE} {words(30)}"), (None, None), (BIG, f"{PASSAGE} {words(40)}"), (-5, f"{words(8)} {PASSAGE}"), (-5, f"{words(8)} {PASSAGE} x"),
    (1 << 62, f"{words(20)} {PASSAGE}"), (3, ""), (3, words(70)), (3, words(70)), (0, "a b"), (-(1 << 63), words(200)),
]


def odd(spark, parts: int):
    return spark.createDataFrame(ODD_IDS, "doc_id long, text string").repartition(parts)


def expected(cut, n: int) -> list[tuple]:
    """Rows in the order of their ids, null last; what starts in rows of smaller ids cuts."""
    order = sorted(ODD_IDS, key=lambda r: (r[0] is None, r[0] or 0))
    out, earlier, same, last = [], set(), set(), object()
    for doc, text in order:
        if doc != last:
            earlier |= same
            same, last = set(), doc
        symbols = cut(text)
        out.append((doc, symbols, cover(symbols, n, earlier)))
        same |= {symbols[a : a + n] for a in range(len(symbols) - n + 1)}
    return out


def as_set(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_ids_suffix(spark, parts):
    found = [(doc, len(raw), sum(gone), runs(gone), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()) for doc, raw, gone in expected(lambda t: (t or "").encode(), 50)]
    assert as_set(suffix_dedup(odd(spark, parts)).collect()) == as_set(found)


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_ids_substring(spark, parts):
    found = [(doc, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()) for doc, w, gone in expected(lambda t: tuple(WORD.findall((t or "").encode())), 50)]
    assert as_set(substring_dedup(odd(spark, parts)).drop("text").collect()) == as_set(found)


def test_null_ids_keep_their_passages(spark):
    df = spark.createDataFrame([(None, f"{words(9)} {PASSAGE}"), (None, f"{words(7)} {PASSAGE}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup(df).collect()] == [0, 0] == [r.n_removed for r in suffix_dedup(df).collect()]


def test_texts_longer_than_a_pack(spark):
    r = random.Random(4)
    whole = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=2_300_000)) for _ in range(3)]
    made = [whole[0] + "0", "1" + whole[1][:900_000] + "1" + whole[0][1_000_000:1_600_000] + "1" + whole[1][900_000:] + "1", "2" + whole[2] + "2" + whole[1][400_000:800_000] + "2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string").coalesce(1)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup(df).collect()}
    assert got == {0: (len(made[0]), 0, 0), 1: (len(made[1]), 600_000, 1), 2: (len(made[2]), 400_000, 1)}


def test_long_texts_of_words(spark):
    r = random.Random(6)
    new = lambda n: [str(r.getrandbits(60)) for _ in range(n)]
    a, b = new(300_000), new(100_000)
    df = spark.createDataFrame([(0, " ".join(a)), (1, " ".join(b[:50_000] + a[200_000:280_000] + b[50_000:])), (2, " ".join([*a[:5], "x", *a[6:]]))], "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup(df).collect()}
    assert got == {0: (300_000, 0), 1: (180_000, 80_000), 2: (300_000, 299_994)}
    assert {x.doc_id: x.component_id for x in near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_repeated_ids_of_near_copies(spark, parts):
    z, w = words(90), words(90)
    near = z.split()
    near[40] = "other"
    df = spark.createDataFrame([(1, " ".join(near)), (7, w), (7, z), (9, w), (None, z), (None, z)], "doc_id long, text string").repartition(parts)
    rows = near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None) == [(1, 1, True), (7, 1, False), (7, 1, False), (9, 1, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)] * 2
    left = deduplicated(df.withColumn("n", F.lit(4))).collect()
    assert sorted((r.doc_id, r.text == w, r.n) for r in left) == [(1, False, 4), (7, True, 4)]


def plain_seats(votes, seats: int) -> list[int]:
    out, heap = [0] * len(votes), [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def test_seats_are_those_of_the_highest_quotients():
    r = np.random.default_rng(2)
    assert sainte_lague([0, 15, 3, 2, 1, 3, 5, 2], 46).tolist() == [0, 23, 5, 3, 1, 4, 7, 3]
    for _ in range(3000):
        votes, seats = r.integers(0, r.choice([4, 30, 5000]), r.integers(1, 14)).astype(float), int(r.integers(0, 300))
        assert sainte_lague(votes, seats).tolist() == plain_seats(votes, seats)


def test_mixing_of_repeated_rows(spark):
    made = [(None, "a b c", "s")] * 300 + [(5, words(20), "s")] * 40 + [(i, words(1 + i % 50), [None, "t", "u"][i % 3]) for i in range(200)] + [(6, None, "empty"), (7, "", "empty")]
    schema = "doc_id long, text string, source string"
    one, many = (mix(spark.createDataFrame(made, schema).repartition(n), shard_words=500).select("doc_id", "size", "source_size", "target", "taken", "key").collect() for n in (1, 7))
    assert as_set(one) == as_set(many) and len(one) == len(made)
    for key, target in {(r.key, r.target) for r in one}:
        assert sum(r.taken for r in one if r.key == key) == round(target)
    assert all(0 <= r.taken <= 2 * r["size"] for r in one)
    names = "_row", "_passes", "_spans", "_key", "_h", "_nth", "copy", "key", "n_chars"
    df = spark.createDataFrame(made, schema).select("*", *(F.lit(3).alias(n) for n in names))
    texts = mixed_texts(df, shard_words=500)
    assert texts.columns == df.columns
    got = texts.collect()
    assert sum(len(WORD.findall(r.text.encode())) for r in got) == sum(r.taken for r in one)
    assert all(r.n_chars in (3, len(r.text)) and r._key == 3 for r in got)


@pytest.mark.parametrize("room", [7, 40, 100])
def test_fullest_combination(room):
    r = random.Random(room)
    for _ in range(60):
        stock = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        sums = {0}
        for n in stock:
            sums |= {s + n for s in sums}
        chosen = Stock({n: stock.count(n) for n in set(stock)}).fullest(room)
        assert sum(chosen) == max(s for s in sums if s <= room) and all(chosen.count(n) <= stock.count(n) for n in chosen)


def test_packing_of_one_id(spark):
    df = spark.createDataFrame([(None, "a b")] * 500 + [(4, "c")] * 500, "doc_id long, text string")
    rows = pack_documents(df, capacity=16).collect()
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 1000 and len(bins) <= sum(r.length for r in rows) / 16 + 2
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 16


def naive_phrases(sample: str, text: str) -> int:
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("dense", [0, 1 << 27])
def test_phrases_are_those_of_a_naive_parse(dense):
    r = random.Random(1)
    made = {x: " ".join("".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(300)) for x, letters in (("a", "abcd"), ("b", "abcé"), ("c", "xyzß"))}
    m = Model(made, dense)
    assert all((p.keys is None) == bool(dense) for p in m.parsers)
    texts = [plain(" ".join("".join(r.choices("abcdéxyzßq", k=r.randint(1, 9))) for _ in range(n))) for n in (1, 2, 7, 20, 300)] + [plain(made["a"][40:200])]
    got = m.phrases(texts)
    for t, row in zip(texts, got, strict=True):
        parts = [t[a : a + 256] for a in range(0, len(t), 256)]
        assert row.tolist() == [sum(naive_phrases(plain(made[x]), p) for p in parts) for x in "abc"]
        cost = [n * math.log2(len(plain(made[x])) + 1) for n, x in zip(row, "abc", strict=True)]
        assert m.predict([t])[0][0] == "abc"[int(np.argmin(cost))]
    assert Parser(TextAutomaton("ab").next, {"a": 1, "b": 2, "c": 3}, True).entries(np.array([0]), np.array([3]))[0] == 1


def test_language_edges(spark):
    long = " ".join(["kuzu", "mazi", "wazo", "zaru"] * 4000)
    made = [(i, f"the house and the {words(3)} water", "en") for i in range(40)] + [(100 + i, long, "zz") for i in range(8)] + [(200, "½ ②", "en"), (201, "Ⅷ ² 12", "en"), (202, None, "en"), (203, "wazo kuzu", None), (None, "the house", "en"), (204, "the water and the house", None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    assert len(sample_texts(df)["zz"]) >= 6000  # long documents are learnt from too
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df.repartition(3)).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0)
    assert got[203][0] == got[100][0] == "zz" and got[204][0] == "en" and 0.5 < got[204][1] <= 1
    assert {r.lang_pred for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rules_as_columns_hold_as_in_numpy(spark):
    r = np.random.default_rng(4)
    made = [words(int(n)) + (" !!" * (i % 3)) + ("\nsame\nsame" * (i % 2)) for i, n in enumerate(r.integers(0, 60, 200))] + [None, "", "A B", "1 2 3"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    x = np.array([statistics(t) for t in made])
    ensemble = fit(x, (x[:, 0] + r.normal(size=len(x)) > np.median(x[:, 0])).astype(float), penalty=1e-3)
    assert ensemble.rules
    got = {row.doc_id: row.score for row in with_statistics(df, ["doc_id"]).select("doc_id", ensemble.column().alias("score")).collect()}
    odds = ensemble.bias + sum(w * hold(x, rule) for rule, w in ensemble.rules)
    assert np.allclose([got[i] for i in range(len(made))], 1 / (1 + np.exp(-odds)))
    assert len(STATISTICS) == x.shape[1] and Ensemble(0.0, []).rules == []


def test_quality_of_repeated_and_missing_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c d"), (None, "x"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = score_quality(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in score_quality(docs, labels.where("false")).collect()}) == 1


VEC = "vec_id long, embedding array<double>, label string, score int, v int, id int"


def test_vectors_of_odd_ids(spark):
    made = [(None, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (20, [0.0, 1.0]), (40, [1.0, 0.0, 0.0]), (-20, [2.0, 0.1]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, []), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "l", 1, 2, 3) for i, v in made], VEC)
    rows = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    # 0 has two vectors, each with links of its own; its component is that of both
    assert rows == {(None, 0, None, False), (0, 3, -20, False), (0, 1, -20, False), (20, 1, -20, False), (-20, 3, -20, True), (7, 3, -20, False), (8, 3, -20, False), (40, 0, 40, True), (9, 0, 9, True), (10, 0, 10, True)}
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, df.where("vec_id = 20")).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 0, 1.0), (20, 2, -20, 0.1), (20, 3, 0, 0.0), (20, 4, 7, 0.0), (20, 5, 8, 0.0)]  # ties to the smaller id
    assert near_vectors(df.where("false")).count() == 0 == nearest(df.where("false"), df.where("false")).count()
    assert score_quality(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_nearest_over_many_tiles(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=(900, 16)) * r.uniform(0.1, 3, size=(900, 1))
    v[500:700] = v[3]  # more copies than places
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for x in nearest(df, df.where("vec_id % 20 = 0"), k=10, query_block=16, block=128).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    for q in range(0, 900, 20):
        assert got[q] == [i for _, i in sorted((-float((v[q] * v[i]).sum()), i) for i in range(900) if i != q)[:10]]


def test_links_around_a_crowded_centre(spark):
    """Spokes at a cosine just over the threshold around one centre, among unrelated vectors: at least 0.99 of all links."""
    r = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    v = unit(r.normal(size=(4000, 64)))
    side = r.normal(size=(800, 64))
    side = unit(side - (side @ v[0])[:, None] * v[0])
    v[100:900] = 0.952 * v[0] + math.sqrt(1 - 0.952**2) * side
    other = unit(r.normal(size=(400, 64)))
    v[1000:1400] = unit(0.952 * v[1400:1800] + math.sqrt(1 - 0.952**2) * unit(other - (other * v[1400:1800]).sum(1, keepdims=True) * v[1400:1800]))
    link = v @ v.T >= 0.95
    links = link.sum(1) - 1
    rows = {x.vec_id: x for x in near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    found = sum(rows[i].n_links for i in range(4000))
    assert all(rows[i].n_links <= links[i] for i in range(4000)) and found >= 0.99 * links.sum()
