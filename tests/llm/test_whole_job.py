"""Cases in which a shortcut of an operator once lost part of its results."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestone.llm import near_dedup
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.vector_dedup import near_vectors

from .test_operators import shingles


def roots(pairs, n: int) -> list[int]:
    up = list(range(n))
    for a, b in pairs:
        low, high = sorted((up[a], up[b]))
        up = [low if u == high else u for u in up]
    return up


@pytest.mark.parametrize("tile", [256, 16])
def test_near_duplicates_behind_a_common_template(spark, monkeypatch, tile):
    """Pairs whose bands also hold earlier documents that are under the threshold to them."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    r = random.Random(11)
    new = lambda n: ["".join(r.choices("abcdefghij", k=8)) for _ in range(n)]
    template, made = new(400), []
    for _ in range(150):
        made.append(template + new(55))
    for _ in range(30):
        own = new(55)
        made += [template + own, template + own[:11] + new(44)]
    sets = [shingles(" ".join(w)) for w in made]
    links = [(a, b) for b in range(len(made)) for a in range(b) if (both := (sets[a] & sets[b]).total()) >= 0.8 * (sets[a].total() + sets[b].total() - both)]
    assert len(links) == 30
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == dict(enumerate(roots(links, len(made))))


def test_vector_dedup_of_a_dense_region(spark):
    """Linked pairs among many rows that are close to each other and do not link."""
    r = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    n, cone = 6000, 3000
    v = unit(r.normal(size=(n, 64)))
    v[:cone] = unit(np.sqrt(0.88) * v[-1] + np.sqrt(0.12) * v[:cone])
    v[:200] = unit(v[200:400] + 0.3 * unit(r.normal(size=(200, 64))))
    order = r.permutation(n)
    v = v[order]
    link = v @ v.T >= 0.95
    a, b = np.nonzero(np.triu(link, 1))
    assert len(a) >= 200
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = {x.vec_id: x for x in near_vectors(df).collect()}
    assert [rows[i].component_id for i in range(n)] == roots(zip(a.tolist(), b.tolist()), n)
    assert [rows[i].n_links for i in range(n)] == (link.sum(1) - 1).tolist()
