"""Shared frame of the two repeat removers: which windows of L symbols also start in an earlier document.

Symbols are bytes or words. Every window of L symbols picks the smallest name among its
k-symbol substrings, so equal windows pick equal names wherever they stand; consecutive windows
with one pick form a segment (about (L-k)/2 windows). Names of 2m symbols are made from the
pair of names at offsets 0 and m. Three rounds of ranking across the corpus follow, each
keeping only what is not yet unique:

1. the picked k-symbol name of a segment: how often does it occur?
2. the name of the whole segment, where 1 found others: which document has it first?
3. the L-symbol windows, where 2 found other surroundings of the same pick.

A round is one exchange: every batch of documents sends each name once, with its smallest
document and its count (so a name that a third of all rows share costs one entry a batch),
dealt by name range; the answers go back only where the corpus knows more than the batch.

Rounds 2 and 3 decide what is removed, so their names are 96 bits wide: two hashes of different
bases, the second cut to 32 bits. Among the 10^13 names of 100 TB an accidental equality of two
has a chance of about 1 in 1,000. Round 1 only sorts out what is unique, so that names of 48 bits do: an
accidental equality there costs work, never a result.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch, written

BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SLICE = 1 << 18
#: Text of a pack, which asks as one, and of a bucket of names, which is ranked as one. A round has at most a row for
#: each pack and bucket (and at most one for each name), so both may be raised with the memory of executors.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Later than every other document. A document of that very id is no earlier than those without one.
NO_ID = (1 << 63) - 1
PICK_BITS = 48
U = np.uint64
PACKED = "batch long, n_bytes long, ids binary, lens binary, blob binary, rest binary"
REQUEST = "bucket int, batch long, blob binary"
ANSWER = "batch long, round int, bucket int, blob binary"


@dataclass(frozen=True)
class Spec:
    """k: symbols of a pick; length: symbols of a window; words: words instead of bytes."""

    k: int
    length: int
    words: bool = False


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE_NAME = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` and its inverse to the powers 0 to n."""
    size = 1 << max(12, n.bit_length())
    if (size, base) not in _powers:
        with np.errstate(over="ignore"):
            _powers[size, base] = tuple(np.cumprod(np.r_[U(1), np.full(size, U(b))], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[size, base]


def doubled(x: np.ndarray, k: int) -> np.ndarray:
    """Names of all k-symbol substrings of x, by pairs of names at doubling offsets."""
    name, length, whole, done = x, 1, None, 0
    while True:
        if k & length:
            if whole is None:
                whole, done = name, length
            else:
                m = len(x) - (done + length) + 1
                whole = whole[:m] + name[done : done + m] * U(pow(BASE, done, 1 << 64))
                done += length
        if 2 * length > k:
            return whole
        m = len(x) - 2 * length + 1
        name = name[:m] + name[length : length + m] * U(pow(BASE, length, 1 << 64))
        length *= 2


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    length = 1
    while 2 * length <= w:
        a = np.minimum(a[:-length], a[length:])
        length *= 2
    return np.minimum(a[: length - w], a[w - length :]) if length < w else a


def prefix_names(x: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    pw, ipw = powers(len(x), base)
    return np.r_[U(0), np.cumsum(x * pw[: len(x)], dtype=np.uint64)], ipw


def range_names(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names and 32-bit checks of the runs of ``x`` from ``first`` up to ``end``."""
    both = []
    for symbols, base in ((x, BASE), (x ^ (x >> U(32)), CHECK_BASE)):
        p, ipw = prefix_names(symbols, base)
        both.append(mix((p[end] - p[first]) * ipw[first] + mix((end - first).astype(np.uint64))))
    return both[0], (both[1] >> U(32)).astype(np.uint32)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of some bytes."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


class Batch:
    """The documents of a packed row as one array of symbols."""

    def __init__(self, row: dict, spec: Spec):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, int(row["n_bytes"])))
        self.starts = np.r_[0, np.cumsum(self.lens)]
        raw = np.frombuffer(self.data, np.uint8)
        self.spec = spec
        if spec.words:
            names, count = [], np.zeros(len(self.ids), np.int64)
            for i in range(len(self.ids)):
                d = raw[self.starts[i] : self.starts[i + 1]]
                s, e = word_bounds(d)
                count[i] = len(s)
                for a in range(0, len(s), SLICE):  # a long text word slice by word slice
                    sa, ea = s[a : a + SLICE], e[a : a + SLICE]
                    p, ipw = prefix_names(BYTE_NAME[d[sa[0] : ea[-1]]])
                    sa, ea = sa - sa[0], ea - s[a]
                    names.append(mix((p[ea] - p[sa]) * ipw[sa] + mix((ea - sa).astype(np.uint64))))
            self.symbols = np.concatenate(names) if names else np.zeros(0, np.uint64)
            self.counts = count
        else:
            self.symbols, self.counts = raw, self.lens
        self.bounds = np.r_[0, np.cumsum(self.counts)]

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        length = self.spec.length
        for a in range(0, len(self.symbols) - length + 1, SLICE):
            x = self.symbols[a : a + SLICE + length - 1]
            yield a, (x if self.spec.words else BYTE_NAME[x])

    def segments(self) -> tuple[np.ndarray, ...]:
        """First and last window, pick, whole name and its check of each segment, and its document."""
        k, length = self.spec.k, self.spec.length
        kinds = np.int64, np.int64, np.uint64, np.uint64, np.uint32
        found: tuple[list, ...] = tuple([] for _ in kinds)
        for a, x in self.slices():
            m = len(x) - length + 1
            ok = np.ones(m + 1, bool)
            ok[m] = False
            lo = np.searchsorted(self.bounds, a + 1)
            for b in self.bounds[lo : np.searchsorted(self.bounds, a + m + length, "right")] - a:  # no window crosses the end of a document
                ok[max(0, b - length + 1) : max(0, min(b, m))] = False
            pick = sliding_min(mix(doubled(x, k)), length - k + 1)
            same = np.zeros(m + 1, bool)
            same[1:m] = (pick[1:] == pick[:-1]) & ok[: m - 1] & ok[1:m]
            first, last = np.flatnonzero(ok[:m] & ~same[:m]), np.flatnonzero(ok[:m] & ~same[1:])
            for to, v in zip(found, (first + a, last + a, mix(pick[first]), *range_names(x, first, last + length)), strict=True):
                to.append(v)
        first, last, pick, whole, check = (np.concatenate(v) if v else np.zeros(0, t) for v, t in zip(found, kinds, strict=True))
        return first, last, pick, whole, check, self.ids[np.searchsorted(self.bounds, first, "right") - 1] if len(first) else np.zeros(0, np.int64)

    def names_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and checks of the windows that start at ``at`` (ascending)."""
        out, check = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint32)
        for a, x in self.slices():
            lo, hi = np.searchsorted(at, (a, a + SLICE))
            if lo < hi:
                q = at[lo:hi] - a
                out[lo:hi], check[lo:hi] = range_names(x, q, q + self.spec.length)
        return out, check


def grouped(names: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order by name and check, and where in it a new one begins."""
    order = np.argsort(names)
    n = names[order]
    new = np.r_[np.ones(min(1, len(n)), bool), n[1:] != n[:-1]]
    if check is not None and len(n):
        c = check[order]
        differ = c[1:] != c[:-1]
        if (differ & ~new[1:]).any():  # one name of different checks: almost never
            order = np.lexsort((check, names))
            n, c = names[order], check[order]
            new[1:] = (n[1:] != n[:-1]) | (c[1:] != c[:-1])
    return order, new


class Ranks:
    """Distinct names with smallest document and count, as this batch sees them and then as the corpus does."""

    def __init__(self, names: np.ndarray, docs: np.ndarray | None = None, check: np.ndarray | None = None, bits: int = 64):
        self.bits = bits
        if bits < 64:
            names = names >> U(64 - bits)
        order, new = grouped(names, check)
        first = np.flatnonzero(new)
        self.names, self.check = names[order[first]], None if check is None else check[order[first]]
        self.inverse = np.empty(len(names), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.count = np.diff(np.r_[first, len(names)])
        self.low = np.minimum.reduceat(docs[order], first) if docs is not None and len(names) else np.zeros(len(first), np.int64)

    def bounds(self, buckets: int) -> np.ndarray:
        edges = np.array([min((1 << self.bits) - 1, -(-(b << self.bits) // buckets)) for b in range(1, buckets)], np.uint64)
        return np.r_[0, np.searchsorted(self.names, edges), len(self.names)]

    def requests(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        at = self.bounds(buckets)
        for b in range(buckets):
            if at[b] < at[b + 1]:
                s = slice(at[b], at[b + 1])
                gaps, low, count = np.diff(self.names[s], prepend=U(0)), self.low[s], self.count[s]
                more = None if not low.any() else planes(low.view(np.uint64)), None if (count == 1).all() else planes(count.astype(np.uint64))
                yield b, pickle.dumps((planes(gaps), *more, None if self.check is None else self.check[s].tobytes()), 5)

    def apply(self, answers: dict[int, bytes], buckets: int) -> None:
        at = self.bounds(buckets)
        for b, blob in answers.items():
            where, low, count = pickle.loads(blob)
            self.low[at[b] + where] = low
            self.count[at[b] + where] = count


def planes(v: np.ndarray) -> tuple[int, bytes]:
    """Little-endian bytes of 64-bit numbers, plane by plane, without planes that are all zero."""
    top = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    return len(v), np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :top].T).tobytes()


def unplanes(n: int, raw: bytes) -> np.ndarray:
    top = len(raw) // n if n else 0
    out = np.zeros((n, 8), np.uint8)
    out[:, :top] = np.frombuffer(raw, np.uint8).reshape(top, n).T if top else 0
    return out.view(np.uint64).reshape(-1)


def rank(table: pa.Table, number: int) -> pa.Table:
    """Answers one bucket: entries of which the corpus knows a smaller document or a larger count than the batch."""
    batches, parts = table["batch"].to_numpy(), [pickle.loads(b) for b in table["blob"].to_pylist()]
    names = [np.cumsum(unplanes(*p[0]), dtype=np.uint64) for p in parts]
    sizes = np.array([len(n) for n in names])
    name = np.concatenate(names)
    low = np.concatenate([np.zeros(n, np.int64) if p[1] is None else unplanes(*p[1]).view(np.int64) for n, p in zip(sizes, parts, strict=True)])
    count = np.concatenate([np.ones(n, np.int64) if p[2] is None else unplanes(*p[2]).view(np.int64) for n, p in zip(sizes, parts, strict=True)])
    check = None if parts[0][3] is None else np.concatenate([np.frombuffer(p[3], np.uint32) for p in parts])
    order, new = grouped(name, check)
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    all_low, all_count = np.empty_like(low), np.empty_like(count)
    all_low[order] = np.minimum.reduceat(low[order], first)[group]
    all_count[order] = np.add.reduceat(count[order], first)[group]
    news, ends = (all_low != low) | (all_count != count), np.cumsum(sizes)
    rows = []
    for i, end in enumerate(ends):
        where = np.flatnonzero(news[end - sizes[i] : end])
        if len(where):
            at = where + end - sizes[i]
            rows.append((int(batches[i]), number, int(table["bucket"][0].as_py()), pickle.dumps((where.astype(np.uint32), all_low[at], all_count[at]), 5)))
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table({"batch": pa.array(columns[0], pa.int64()), "round": pa.array(columns[1], pa.int32()), "bucket": pa.array(columns[2], pa.int32()), "blob": pa.array(columns[3], pa.binary())})


MOST_ROWS = 50_000
#: Rows of a pack (at most twice ``MOST_ROWS``), as a power of 2; with 20 bits for the packs of a partition and 26 for partitions, rows can be numbered.
ROW_BITS, PACK_BITS = 17, 20


def pack_rows(batches: Iterator[pa.RecordBatch], numbered: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows in packs of about 4 MB of text; the columns besides the text stay as they are. ``ids`` are doc_ids, or numbers of the rows."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    text, doc = "text", "doc_id"

    def one() -> pa.RecordBatch:
        nonlocal number
        t = pa.Table.from_batches(held)
        raw = [v.as_py() or b"" for v in t[text].cast(pa.binary())]
        batch = part << PACK_BITS | number
        ids = (batch << ROW_BITS) + np.arange(len(t)) if numbered else np.array([NO_ID if v is None else v for v in t[doc].to_pylist()], np.int64)
        sink = pa.BufferOutputStream()
        rest = t.drop_columns([text])
        with pa.ipc.new_stream(sink, rest.schema) as out:
            out.write_table(rest)
        whole = b"".join(raw)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        row = [batch, len(whole), ids.tobytes(), np.array([len(r) for r in raw], np.int64).tobytes(), squeeze(whole), squeeze(sink.getvalue().to_pybytes())]
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["batch", "n_bytes", "ids", "lens", "blob", "rest"])

    for b in batches:
        bytes_before = np.r_[0, np.cumsum([0 if v is None else v for v in pc.binary_length(b[text]).to_pylist()])]
        a = 0
        while a < b.num_rows:
            n = max(1, int(np.searchsorted(bytes_before, bytes_before[a] + BATCH_BYTES - size, "right")) - 1 - a)
            n = min(n, b.num_rows - a, MOST_ROWS)
            held.append(b.slice(a, n))
            size += int(bytes_before[a + n] - bytes_before[a])
            a += n
            if size >= BATCH_BYTES * 9 // 10 or sum(h.num_rows for h in held) >= MOST_ROWS:
                yield one()
                held, size = [], 0
    if held:
        yield one()


def rest_of(row: dict) -> pa.Table:
    raw = zstandard.ZstdDecompressor().decompress(row["rest"], max_output_size=1 << 31) if row["rest"] else b""
    return pa.ipc.open_stream(raw).read_all()


def packed(docs: DataFrame, numbered: bool = False) -> DataFrame:
    """``docs`` as a table of packs, bucketed by pack so that later rounds join answers without moving texts.

    The catalog has it only while it is opened; its files go with the application's scratch folder.
    """
    spark, n, name = docs.sparkSession, partitions(docs.sparkSession), f"lodestone_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(lambda it: pack_rows(it, numbered), PACKED).repartition(n, "batch")
    rows.write.bucketBy(n, "batch").option("path", scratch(spark, "packs")).option("compression", "uncompressed").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def with_answers(packs: DataFrame, answers: DataFrame | None, f: Callable[[dict, dict[int, dict[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """f(pack, {round: {bucket: answer}}) of every pack."""
    if answers is None:

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    yield from f(row, {}).to_batches()

        return packs.mapInArrow(plain, schema)

    def paired(pack: pa.Table, told: pa.Table) -> pa.Table:
        by: dict[int, dict[int, bytes]] = {}
        for r in told.to_pylist():
            by.setdefault(r["round"], {})[r["bucket"]] = r["blob"]
        return pa.concat_tables([f(row, by) for row in pack.to_pylist()])

    return packs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(paired, schema)


def bucket_count(packs: DataFrame) -> int:
    """Buckets of names, one for every ``BUCKET_BYTES`` of text."""
    total = packs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(64, int(total) // BUCKET_BYTES)


def asked(requests: Iterator[tuple[int, bytes]], batch: int) -> pa.Table:
    rows = list(requests)
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([batch] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def ranked(requests: DataFrame, number: int, answer: Callable[[pa.Table, int], pa.Table] = rank) -> DataFrame:
    return requests.groupBy("bucket").applyInArrow(lambda t: answer(t, number), ANSWER)


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, both ends included."""
    n = last - first + 1
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Replay:
    """A pack's side of the rounds: what it asks next, given the answers so far."""

    def __init__(self, row: dict, told: dict[int, dict[int, bytes]], spec: Spec, buckets: int, rounds: int):
        self.batch, self.buckets = Batch(row, spec), buckets
        self.first, self.last, pick, self.whole, self.check, self.doc = self.batch.segments()
        self.pick = pick
        self.ranks = Ranks(pick, bits=PICK_BITS)
        if rounds < 2:
            return
        self.ranks.apply(told.get(1, {}), buckets)
        self.of_pick = self.ranks.count[self.ranks.inverse]
        self.shared = np.flatnonzero(self.of_pick > 1)
        self.ranks = Ranks(self.whole[self.shared], self.doc[self.shared], self.check[self.shared])
        if rounds < 3:
            return
        self.ranks.apply(told.get(2, {}), buckets)
        low, count, doc = self.ranks.low[self.ranks.inverse], self.ranks.count[self.ranks.inverse], self.doc[self.shared]
        self.gone = self.shared[low < doc]
        self.open = self.shared[(low == doc) & (count < self.of_pick[self.shared])]

    def windows(self, segments: np.ndarray) -> Ranks:
        self.at = ranges(self.first[segments], self.last[segments])
        self.at_doc = np.repeat(self.doc[segments], self.last[segments] - self.first[segments] + 1)
        names, check = self.batch.names_at(self.at)
        return Ranks(names, self.at_doc, check)

    def covered(self, more: np.ndarray) -> np.ndarray:
        """Symbols under removed windows: those of ``gone`` segments, and those that start at ``more``."""
        n, length = len(self.batch.symbols), self.batch.spec.length
        edge = np.bincount(np.r_[self.first[self.gone], more], minlength=n + 1)
        edge -= np.bincount(np.r_[self.last[self.gone], more] + length, minlength=n + 1)
        return np.cumsum(edge[:n]) > 0


def first_rounds(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame, int]:
    """Packs, the answers of rounds 1 and 2, and the number of buckets."""
    packs = packed(docs)
    buckets = bucket_count(packs)

    def ask(number: int) -> Callable:
        return lambda row, told: asked(Replay(row, told, spec, buckets, number).ranks.requests(buckets), row["batch"])

    one = written(ranked(with_answers(packs, None, ask(1), REQUEST), 1), "ranks")
    two = written(ranked(with_answers(packs, one, ask(2), REQUEST), 2), "ranks")
    return packs, one.union(two), buckets
