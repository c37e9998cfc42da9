"""The ten operators against brute force, on small tables with nulls, empty texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import queries
from lodestone.llm.language_id import identify
from lodestone.llm.mixing import mix, mixed_texts
from lodestone.llm.near_dedup import dart_minhash, dart_minhashes, near_duplicates
from lodestone.llm.nearest import nearest
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import score_quality
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.suffix_dedup import suffix_dedup
from lodestone.llm.token_counts import token_counts
from lodestone.llm.tokens import encoder
from lodestone.llm.vector_dedup import near_vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch string, bucket int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts() -> list[str | None]:
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzéß", k=r.randint(2, 8))) for _ in range(300)]
    passage = " ".join(r.choices(words, k=70))
    plain = [" ".join(r.choices(words, k=r.randint(1, 200))) for _ in range(30)]
    made = [f"{a} {passage} {b}" for a, b in zip(plain[:8], plain[8:16], strict=True)]
    near = plain[20].split() if len(plain[20].split()) > 60 else (plain[20] + " " + passage).split()
    copy = [*near]
    copy[30] = "other"
    run = "ab" * 400
    return [*plain, *made, plain[3], plain[3], " ".join(near), " ".join(copy), None, "", "  ", "x", run, run + "c", "a b " * 60, "a b " * 70, passage + "\n" + passage, " ".join(r.choices(words, k=9000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, [None, "de", "en"][i % 3], [None, "a", "b", "c"][i % 4], None if t is None else len(t), "x", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def pairs():
    return [(i * 3 + 1, t) for i, t in enumerate(texts())]


def cover(symbols, n: int, earlier: set) -> list[bool]:
    gone = [False] * len(symbols)
    for a in range(len(symbols) - n + 1):
        if symbols[a : a + n] in earlier:
            gone[a : a + n] = [True] * n
    return gone


def by_brute_force(docs, cut, n: int):
    earlier: set = set()
    for doc, text in docs:
        symbols = cut(text)
        yield doc, symbols, cover(symbols, n, earlier)
        earlier |= {symbols[a : a + n] for a in range(len(symbols) - n + 1)}


def runs(gone: list[bool]) -> int:
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def test_suffix_dedup(docs, pairs):
    expected = set()
    for doc, raw, gone in by_brute_force(pairs, lambda t: (t or "").encode(), 50):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        expected.add((doc, len(raw), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_suffix_dedup_keeps_columns(docs):
    cut = suffix_dedup(docs, with_text=True)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text is None for r in cut.collect()} == {r.doc_id: r.text is None for r in docs.collect()}


def test_substring_dedup(docs, pairs):
    expected = set()
    for doc, words, gone in by_brute_force(pairs, lambda t: tuple(WORD.findall((t or "").encode())), 50):
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        expected.add((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_mixing(docs, pairs):
    rows = mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    sizes = {d: len(WORD.findall((t or "").encode())) for d, t in pairs}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    total = defaultdict(int)
    for d, n in sizes.items():
        total[source[d]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(total.values()), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2 * total[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken, blocks = defaultdict(int), max(sizes.values())
    for r in rows:
        assert r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(blocks, 0.02 * target[s])
    again = mix(docs.repartition(5)).select("doc_id", "taken").collect()
    assert {tuple(r) for r in again} == {(r.doc_id, r.taken) for r in rows}
    words = sum(len(WORD.findall((r.text or "").encode())) for r in mixed_texts(docs).collect())
    assert words == sum(taken.values())


def ids_of(text: str | None) -> list[int]:
    import public_tokenizers
    from tokenizers import Tokenizer

    t = ids_of.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return t.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, pairs):
    n = [len(ids_of(t)) for _, t in pairs]
    for r in token_counts(docs).collect():
        at = r.context_limit
        assert r.n_docs == n.count(at) and r.docs_over == sum(x > at for x in n)
        assert r.total_tokens == sum(n) and r.kept_tokens == sum(min(x, at) for x in n)
        assert r.quantile == pytest.approx(sum(x <= at for x in n) / len(n))


def test_packing(docs, pairs):
    rows = pack_documents(docs).collect()
    whole = {d: [*ids_of(t), 1] for d, t in pairs}
    assert Counter(r.doc_id for r in rows) == {d: -(-len(v) // 4096) for d, v in whole.items()}
    bins = defaultdict(list)
    for r in rows:
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(ids) == r.length <= 4096
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(map(len, whole.values())) // 4096) + 1


def shingles(text: str | None) -> Counter:
    w = WORD.findall((text or "").encode())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_duplicates(docs, pairs):
    sets = {d: shingles(t) for d, t in pairs}
    up = {d: d for d in sets}
    for d in sets:
        for e in sets:
            if e < d and sets[d] and sets[e]:
                both = sum((sets[d] & sets[e]).values())
                if both / sum((sets[d] | sets[e]).values()) >= 0.8:
                    low, high = sorted((up[d], up[e]))
                    up = {k: low if v == high else v for k, v in up.items()}
    text = dict(pairs)
    for r in near_duplicates(docs).collect():
        if text[r.doc_id] and sets[r.doc_id]:
            assert (r.doc_id, r.component_id) == (r.doc_id, up[r.doc_id])
        assert r.kept == (r.component_id == r.doc_id)


def vectors(spark, n: int = 260):
    r = np.random.default_rng(3)
    v = r.normal(size=(n, 24))
    v[40:60] = v[5] + r.normal(size=(20, 24)) * 0.03
    v[70] = v[71] = v[5]
    rows = [(i, [float(x) for x in np.float32(v[i])], "l") for i in range(n)]
    rows += [(n, None, "l"), (n + 20, [0.0] * 24, None), (n + 40, [float("nan")] * 24, "l"), (n + 41, [None, *[1.0] * 23], "l")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), np.array([x[1] for x in rows[:n]])


def test_nearest(spark):
    df, v = vectors(spark)
    got = defaultdict(list)
    for r in nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 260, 20))
    for q, found in got.items():
        exact = sorted(((-float(v[q] @ v[i]), i) for i in range(260) if i != q))[:20]
        assert [f[0] for f in found] == [i for _, i in exact]
        assert np.allclose([f[1] for f in found], [-s for s, _ in exact])


def test_vector_dedup(spark):
    df, v = vectors(spark)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(260, dtype=bool)
    rows = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(rows) == 264
    for i in range(260):
        assert rows[i].n_links == link[i].sum()
        assert rows[i].component_id == min([i, *(5 if link[i].any() else i for _ in [0])]) and rows[i].kept == (rows[i].component_id == i)
    for i in (260, 280, 300, 301):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (0, i, True)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out and lang[r.doc_id][0]]
    right = sum(r.lang_pred == lang[r.doc_id][0] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert right / len(held) >= 0.9


def test_language_of_nothing(docs, pairs):
    text = dict(pairs)
    for r in identify(docs).collect():
        if not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert r.lang_pred == "und"


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins >= 0.8


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup, mix, token_counts, near_duplicates, pack_documents, identify])
def test_empty_table(docs, operator):
    assert operator(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_all_rows(spark, name):
    rows = queries.QUERIES[name](spark, SF).count()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    if name == "op10_vector_dedup":
        assert rows == vecs
    elif name == "op8_packing":
        assert rows >= docs
    elif name not in ("op4_token_counts", "op7_nearest"):
        assert rows == docs


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = out
    assert out.count() > 0


def test_darts_of_many_sets_are_those_of_each_alone():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 0, 7, 300, 2, 90])
    names, ends = rng.integers(0, 1 << 62, sizes.sum()).astype(np.uint64), np.cumsum(sizes)
    for weights in (rng.integers(1, 5, sizes.sum()), rng.random(sizes.sum()) * 3 + 0.01):
        each = [dart_minhash(names[e - n : e], weights[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
        assert (dart_minhashes(names, weights, sizes) == np.array(each)).all()
        assert not each[1].any()


def test_words_encoded_together_are_those_of_the_library():
    texts = ["", "It's 12 o'clock -- don't!", "na\u00efve caf\u00e9 \u00c9T\u00c9", "\u3042 x", "a\u0301b", "</w> </ w>", "tab\tline\n\u00a0end", "<|endoftext|>", "qzxv" * 50]
    e = encoder()
    for t in texts + texts[::-1]:
        assert e.encode(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
