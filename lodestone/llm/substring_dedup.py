"""Operator 2: word runs that repeat across documents are cut from all but the earliest of them.

Method: suffix automata of reference shards. The corpus is its own reference, so no shard is of
a proven size and none is broadcast: shards are dealt by the k-word name that every window of
the threshold's length picks (see ``windows``), and the passages that share a pick are streamed
through the automaton of their shard. Its states carry the smallest document of their
occurrences; where the matching statistics reach the threshold, the state of the threshold's
suffix tells whether the window starts in an earlier document. A passage that is the same in all
documents needs one entry. Picks with more than ``crowd`` occurrences are ranked window by window instead,
so that no passage of very many documents meets in one shard.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import ANSWER, REQUEST, Replay, Spec, asked, first_rounds, rank, rest_of, with_answers

WINDOWS, PASSAGES = 3, 4


#: Later than every document, those without an id included.
NEVER = 1 << 63


class SuffixAutomaton:
    """Of several strings; ``low``: the smallest document in which a state's strings occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.low = [-1], [0], [NEVER]

    def _state(self, length: int, step: dict, link: int, low: int) -> int:
        self.next.append(step)
        self.len.append(length)
        self.link.append(link)
        self.low.append(low)
        return len(self.len) - 1

    def add(self, string: list[int], doc: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for c in string:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                self.low[q] = min(self.low[q], doc)
                continue
            if q is not None:
                last = self._split(last, c, q)
                self.low[last] = min(self.low[last], doc)
                continue
            new, p = self._state(length[last] + 1, {}, 0, doc), last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        copy = self._state(self.len[p] + 1, dict(nxt[q]), link[q], NEVER)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def finish(self) -> None:
        """Carries documents to the suffixes."""
        low, link = self.low, self.link
        for v in sorted(range(1, len(low)), key=self.len.__getitem__, reverse=True):
            low[link[v]] = min(low[link[v]], low[v])

    def matches(self, string: list[int], length: int) -> Iterator[tuple[int, int]]:
        """(end, document) where the matching statistic is at least ``length``: the smallest document with that suffix."""
        nxt, link, size = self.next, self.link, self.len
        v = n = 0
        for i, c in enumerate(string):
            while v and c not in nxt[v]:
                v = link[v]
                n = size[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            if n >= length:
                while size[link[v]] >= length:
                    v = link[v]
                    n = size[v]
                yield i, self.low[v]


def judge(table: pa.Table, length: int) -> pa.Table:
    """One bucket's passages: which of their windows start in an earlier document."""
    rows, shard = [], SuffixAutomaton()
    bucket = table["bucket"][0].as_py()
    parts = [(b, pickle.loads(p)) for b, p in zip(table["batch"].to_pylist(), table["blob"].to_pylist(), strict=True)]
    for _, (at, docs, strings) in parts:
        for doc, string in zip(docs.tolist(), strings, strict=True):
            shard.add(string.tolist(), doc)
    shard.finish()
    for batch, (at, docs, strings) in parts:
        gone = []
        for where, doc, string in zip(at.tolist(), docs.tolist(), strings, strict=True):
            gone += [where + i - length + 1 for i, low in shard.matches(string.tolist(), length) if low < doc]
        if gone:
            rows.append((batch, np.array(gone, np.int64).tobytes()))
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "round": pa.array([PASSAGES] * len(rows), pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def substring_dedup(docs: DataFrame, length: int = 50, k: int = 8, crowd: int = 64) -> DataFrame:
    """One row per document of ``docs`` (doc_id long, text string, ...): doc_id, n_words, n_removed, kept_sha256, text.

    ``text`` is the kept words joined by one space. Null text has no words and stays null; a text of under
    ``length`` words is kept whole; a null doc_id is later than all others; rows of one doc_id
    do not cut each other; other columns are ignored; an empty table gives an empty result.
    """
    spec = Spec(k, length, words=True)
    packs, told, buckets = first_rounds(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("text").isNull().alias("none")), spec)

    def split(r: Replay) -> tuple[np.ndarray, np.ndarray]:
        crowded = r.of_pick[r.open] > crowd
        return r.open[~crowded], r.open[crowded]

    def ask(row: dict, got: dict) -> pa.Table:
        r = Replay(row, got, spec, buckets, 3)
        few, many = split(r)
        _, one = np.unique(r.whole[few], return_index=True)  # a document's repeats of one passage are answered through the first
        few = few[one]
        to = ((r.pick[few] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        passages = []
        for b in np.unique(to):
            at = few[to == b]
            blob = pickle.dumps((r.first[at], r.doc[at], [r.batch.symbols[s : e + length] for s, e in zip(r.first[at], r.last[at], strict=True)]), 5)
            passages.append((int(b) + buckets, blob))
        return asked([*r.windows(many).requests(buckets), *passages], row["batch"])

    def answer(table: pa.Table) -> pa.Table:
        return judge(table, length) if table["bucket"][0].as_py() >= buckets else rank(table, WINDOWS)

    def finish(row: dict, got: dict) -> pa.Table:
        r = Replay(row, got, spec, buckets, 3)
        few, many = split(r)
        w = r.windows(many)
        w.apply(got.get(WINDOWS, {}), buckets)
        more = r.at[w.low[w.inverse] < r.at_doc]
        told = np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in got.get(PASSAGES, {}).values()] or [np.zeros(0, np.int64)]))
        if len(told):  # to the repeats of a passage
            whole, one, inverse = np.unique(r.whole[few], return_index=True, return_inverse=True)
            base = r.first[few][one]
            for i in np.flatnonzero(np.arange(len(few)) != one[inverse]):
                b, s = base[inverse[i]], few[i]
                hit = told[np.searchsorted(told, b) : np.searchsorted(told, b + r.last[s] - r.first[s] + 1)]
                more = np.r_[more, hit - b + r.first[s]]
        covered = r.covered(np.unique(np.r_[more, told]))
        before, b = np.r_[0, np.cumsum(covered)], r.batch.bounds
        removed = before[b[1:]] - before[b[:-1]]
        texts = []
        for i, gone in enumerate(removed):
            words = r.batch.data[r.batch.starts[i] : r.batch.starts[i + 1]].split()
            texts.append(b" ".join(words if not gone else [words[j] for j in np.flatnonzero(~covered[b[i] : b[i + 1]])]))
        rest = rest_of(row)
        return pa.table({"doc_id": rest["doc_id"], "n_words": pa.array(r.batch.counts), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "text": pa.array([None if none else t.decode() for t, none in zip(texts, rest["none"].to_pylist(), strict=True)], pa.string())})

    three = with_answers(packs, told, ask, REQUEST).groupBy("bucket").applyInArrow(answer, ANSWER)
    return with_answers(packs, told.union(three), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")
