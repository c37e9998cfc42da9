"""Each stage of the pipeline against its plain definition, over rows with null and repeated ids and columns of awkward names."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import WORD, cover, ids_of, shingles

EXTRA = ("score", "lang_pred", "_nth", "_key", "_h", "_passes", "_spans", "_row", "_null", "row", "first", "component", "batch", "blob", "shard", "place", "copy", "held_out", "a", "b")


@pytest.fixture(scope="module")
def made():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(300)]
    new = lambda n: " ".join(r.choices(words, k=n))
    passage, base = new(30), new(120)
    near = base.split()
    near[50] = "changed"
    texts = [base, " ".join(near), base, None, "", "½ 12 !", f"{new(30)} {passage} {new(10)}", f"{passage} {new(40)}", *(new(r.randint(1, 80)) for _ in range(40)), "x"]
    ids = [4, 9, None, 5, 6, 7, 12, 30, *range(100, 139), 9, None]
    return [(i, t, [None, "en", "de"][k % 3], [None, "s", "t", "u"][k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def docs(spark, made):
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(EXTRA))).repartition(4)


def stage(name: str):
    return dict(corpus_pipeline.STAGES)[name]


def same_columns(out, docs) -> list:
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[n] == k for r in rows for k, n in enumerate(EXTRA))
    return rows


def test_language(spark, docs, made):
    rows = same_columns(stage("language ID")(spark, docs, ""), docs)
    letters = [(i, t) for i, t, *_ in made if t and any(c.isalpha() for c in t)]
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(letters)
    given = Counter((i, t, x) for i, t, x, *_ in made if x and (i, t) in letters)
    assert all(r.lang in ("en", "de") for r in rows) and not given - Counter((r.doc_id, r.text, r.lang) for r in rows)


def test_near_duplicates(spark, docs, made):
    rows = same_columns(stage("near-duplicate removal")(spark, docs, ""), docs)
    sets = [shingles(t) for _, t, *_ in made]
    up = list(range(len(made)))
    for k, x in enumerate(sets):
        for j in range(k):
            if x and sets[j] and (x & sets[j]).total() >= 0.8 * (x | sets[j]).total():
                up = [min(up[k], up[j]) if u in (up[k], up[j]) else u for u in up]
    best: dict[int, int] = {}
    for k, u in enumerate(up):
        key = lambda n: (made[n][0] is None, made[n][0] or 0)
        best[u] = min(best.get(u, k), k, key=key)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(made[k][:2] for k in best.values())


def test_suffixes(spark, docs, made):
    rows = same_columns(stage("suffix-array dedup")(spark, docs, ""), docs)
    earlier: set = set()
    waiting: set = set()
    expected, last = Counter(), object()
    for doc, text, *_ in sorted(made, key=lambda m: (m[0] is None, m[0] or 0)):
        if doc != last:
            earlier |= waiting
            waiting, last = set(), doc
        raw = (text or "").encode()
        kept = bytes(x for x, g in zip(raw, cover(raw, 50, earlier), strict=True) if not g)
        expected[doc, None if text is None else kept.decode()] += 1
        waiting |= {raw[k : k + 50] for k in range(len(raw) - 49)}
    assert Counter((r.doc_id, r.text) for r in rows) == expected
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_sources(spark, docs, made):
    rows = same_columns(stage("source mixing")(spark, docs, ""), docs)
    size = lambda t: len(WORD.findall((t or "").encode()))
    total, taken = Counter(), Counter()
    for _, t, _, s, _ in made:
        total[s] += size(t)
    for r in rows:
        taken[r.source] += size(r.text)
        assert any(r.doc_id == i and r.source == s and " ".join(r.text.split()) in " ".join(t.split()) or set(r.text.split()) <= set((t or "").split()) for i, t, _, s, _ in made)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * total.total(), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        target |= {s: 2 * total[s] if over else share[s] for s in over or open_}
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    assert {s: taken[s] for s in order} == {s: round(target[s]) for s in order}


def test_packing(spark, docs, made):
    rows = stage("best-fit packing")(spark, docs, "").collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in made)
    whole = Counter((i, zlib.crc32(np.array([*ids_of(t), 1], "<u4").tobytes())) for i, t, *_ in made)
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == whole


def test_nothing(spark, docs):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.where("false"), "").count() == 0
