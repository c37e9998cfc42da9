"""Operator 5: near-duplicate documents, by DartMinHash.

Method: a document is a weighted set of word shingles. Hashed darts fall on the plane of weight
and rank over each shingle; those under the shingle's weight are kept, and each of k
coordinates keeps its dart of lowest rank, so two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Darts are thrown rank cell by rank cell, only
as far up as about k ln k darts need, whatever the number of shingles. Bands of the signature
are ranked across the corpus as in ``windows``: each document is held against the document that is
earliest in most of its bands, by exact similarity, and verified pairs are united.
Documents of a band that this leaves in several components are then held against each other, in pairs
where they are few and else in tiles of bounded size, so that every pair that shares a band is united or was checked.
Equal texts are united first and enter once. All of this is done on numbers of rows, so that rows
of one doc_id with different texts are signed each; doc_ids come in at the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, fresh, written
from .windows import ANSWER, REQUEST, ROW_BITS, Batch, Ranks, Spec, U, asked, bucket_count, doubled, mix, packed, ranges, ranked, rest_of, with_answers

COPIES, BANDS, KEYS, GONE = 1, 2, 3, 4
#: Documents on one side of a tile of a band, and of a band up to which its pairs are listed.
TILE, FEW = 1024, 8
#: Rows of a partition whose bands are gathered at once.
GATHERED = 20_000
#: Poisson(area) distribution functions are cut where less than 2 to the -53 is left.
_MOST = 24


def _poisson(area: float) -> np.ndarray:
    p, out, total = math.exp(-area), [], 0.0
    for n in range(_MOST):
        total += p
        out.append(min(total, 1.0))
        p *= area / (n + 1)
    return np.array(out)


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def cells(top: float) -> list[tuple[float, float]]:
    """Rank cells from 0 upwards until past ``top``: the first of 2 to the -6, then doubling, from 1 on of width 1."""
    out, low, high = [], 0.0, 2.0**-6
    while low < top:
        out.append((low, high))
        low, high = high, min(2 * high, high + 1)
    return out


#: Sets and elements that darts are thrown at together: what is held stays within some 10 MB.
_SETS, _ELEMENTS = 256, 1 << 16


def dart_minhash(names: np.ndarray, weights: np.ndarray, k: int = 128, more: float = 2.0) -> np.ndarray:
    """k coordinates of the weighted set of ``names`` (uint64): the names of its lowest darts; all 0 for an empty set."""
    return dart_minhashes(names, weights, np.array([len(names)]), k, more)[0]


def dart_minhashes(names: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int = 128, more: float = 2.0) -> np.ndarray:
    """The same of many sets, ``sizes`` elements each, one row a set. Sets of like weight share their rank cells."""
    out = np.zeros((len(sizes), k), np.uint64)
    ends = np.cumsum(sizes)
    total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights, len(sizes))
    top = np.full(len(sizes), k * (math.log(k) + more))
    np.divide(top, total, out=top, where=total > 0)
    todo = np.flatnonzero(total > 0)
    todo = todo[np.argsort(-top[todo], kind="stable")]
    while len(todo):
        left = []
        cut = np.r_[0, np.cumsum(sizes[todo])]
        a = 0
        while a < len(todo):
            b = max(a + 1, min(a + _SETS, int(np.searchsorted(cut, cut[a] + _ELEMENTS, "right")) - 1))
            some = todo[a:b]
            at = ranges(ends[some] - sizes[some], ends[some] - 1)
            found, whole = _thrown(names[at], weights[at], sizes[some], top[some], k)
            out[some[whole]] = found[whole]
            left.append(some[~whole])
            a = b
        todo = np.concatenate(left)  # some coordinate has no dart yet
        top[todo] *= 2
    return out


def _thrown(names: np.ndarray, weights: np.ndarray, sizes: np.ndarray, top: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of sets in descending order of ``top``, from darts of lower rank than that, and whether all have one."""
    whole = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(names)), whole)
    step = np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(whole)[:-1]], whole)  # weight cell of each
    base = mix(names[at] + step.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    of = np.repeat(np.arange(len(sizes)), sizes)[at]
    inside = weights[at] - step
    integral = bool((whole == weights).all())
    falling = -top[of]
    lowest, dart_of = np.full(len(sizes) * k, np.inf), np.full(len(sizes) * k, ~U(0))
    ranks, darts, places = [], [], []
    for i, (low, high) in enumerate(cells(float(top[0]))):
        cdf = _cdf(high - low)
        h = mix(base[: np.searchsorted(falling, -low)] ^ U((i + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        some = np.flatnonzero(h >= U(math.ceil(cdf[0] * 2.0**53) << 11))  # most have no dart in a narrow cell
        n = np.searchsorted(cdf, unit(h[some]), "right")
        for j in range(int(n.max(initial=0))):
            hit = some[n > j]
            d = mix(h[hit] + U(j + 1))
            if not integral:
                fits = unit(mix(d ^ U(0xA5A5A5A5))) < inside[hit]
                hit, d = hit[fits], d[fits]
            rank = low + (high - low) * unit(mix(d ^ U(0x5BD1E995)))
            under = rank < top[of[hit]]
            ranks.append(rank[under])
            darts.append(d[under])
            places.append(of[hit[under]] * k + (d[under] % U(k)).astype(np.int64))
    rank, dart, place = np.concatenate(ranks), np.concatenate(darts), np.concatenate(places)
    np.minimum.at(lowest, place, rank)
    best = rank == lowest[place]
    np.minimum.at(dart_of, place[best], dart[best])
    return mix(dart_of).reshape(-1, k), np.isfinite(lowest).reshape(-1, k).all(axis=1)


_cdfs: dict[float, np.ndarray] = {}


def _cdf(area: float) -> np.ndarray:
    if area not in _cdfs:
        _cdfs[area] = _poisson(area)
    return _cdfs[area]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Names of the runs of ``size`` words, or of all words where there are fewer; none of no words."""
    return mix(doubled(words, min(size, len(words)))) if len(words) else words


def expanded(names: np.ndarray) -> np.ndarray:
    """Sorted names of (shingle, how many of it before)."""
    s = np.sort(names)
    new = np.r_[True, s[1:] != s[:-1]]
    first = np.flatnonzero(new)
    nth = np.arange(len(s)) - first[np.cumsum(new) - 1] if len(s) else np.zeros(0, np.int64)
    return np.unique(mix(s + nth.astype(np.uint64) * U(0xD1342543DE82EF95)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


class Signed:
    """A pack's rows: which are first of their text, and the band names of those."""

    def __init__(self, row: dict, told: dict, buckets: int, shingle: int, bands: int, rows: int, rounds: int):
        self.batch = b = Batch(row, Spec(1, 1, words=True))
        self.shingle = shingle
        texts = [b.data[s:e] for s, e in zip(b.starts[:-1], b.starts[1:], strict=True)]
        digests = b"".join(hashlib.blake2b(t, digest_size=12).digest() for t in texts)
        name = np.frombuffer(digests, np.dtype([("name", "<u8"), ("check", "<u4")]))
        self.some = np.flatnonzero(b.counts > 0)
        self.ranks = Ranks(name["name"][self.some], b.ids[self.some], name["check"][self.some])
        if rounds < 2:
            return
        self.ranks.apply(told.get(COPIES, {}), buckets)
        self.low = b.ids.copy()
        self.low[self.some] = self.ranks.low[self.ranks.inverse]
        self.own = self.some[self.low[self.some] == b.ids[self.some]]
        self.of = np.repeat(self.own, bands)
        if KEYS in told:
            self.keys = np.frombuffer(told[KEYS][0], np.uint64)
        else:
            self.keys = self.signatures(shingle, bands, rows).reshape(-1)
        self.ranks = Ranks(self.keys, b.ids[self.of])

    def signatures(self, shingle: int, bands: int, rows: int) -> np.ndarray:
        sets = [np.unique(shingles(self.words(d), shingle), return_counts=True) for d in self.own]
        if not sets:
            return np.zeros((0, bands), np.uint64)
        names, counts = (np.concatenate(v) for v in zip(*sets, strict=True))
        sig = dart_minhashes(names, counts, np.array([len(n) for n, _ in sets]), bands * rows).reshape(-1, bands, rows)
        keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), 1))
        for c in range(rows):
            keys = mix(keys * U(0x9E3779B97F4A7C15) + sig[:, :, c])
        return keys

    def words(self, d: int) -> np.ndarray:
        return self.batch.symbols[self.batch.bounds[d] : self.batch.bounds[d + 1]]


def shared(features: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many features each of ``left`` has in common with each of ``right``: 0/1 products, a block of features at a time."""
    at = np.unique(np.r_[left, right])
    rows, names = np.repeat(np.arange(len(at)), [len(features[i]) for i in at]), np.concatenate([features[i] for i in at])
    _, column, count = np.unique(names, return_inverse=True, return_counts=True)
    several = count > 1  # what one row alone has adds nothing
    place = np.cumsum(several) - 1
    use = several[column]
    rows, column = rows[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    x, y = np.searchsorted(at, left), np.searchsorted(at, right)
    out = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, int(several.sum()), width):
        s, e = np.searchsorted(column, (a, a + width))
        has = np.zeros((len(at), width), np.float32)
        has[rows[s:e], column[s:e] - a] = 1
        out += (has[x] @ has[y].T).astype(np.int64)
    return out


def crossing(t: pa.Table, threshold: float) -> pa.Table:
    """Components of similar pairs in one tile of each band of ``t``, where they differ; as many as join the same ones."""
    t = t.sort_by([("key", "ascending"), ("row", "ascending")])
    key, component, own = (t[c].to_numpy() for c in ("key", "component", "own"))
    features = [np.frombuffer(f, np.uint64) for f in t["features"].to_pylist()]
    size = np.array([len(f) for f in features])
    i, j = int(t["i"][0].as_py()), int(t["j"][0].as_py())
    found, parts = [], np.unique(component)
    cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        left, right = s + np.flatnonzero(own[s:e] == i), s + np.flatnonzero(own[s:e] == j)
        if not len(left) or not len(right):
            continue
        both = shared(features, left, right)
        fits = (both >= threshold * (size[left][:, None] + size[right][None] - both)) & (component[left][:, None] != component[right][None])
        x, y = np.nonzero(fits)
        found.append((np.searchsorted(parts, component[left[x]]), np.searchsorted(parts, component[right[y]])))
    x, y = (np.concatenate([np.zeros(0, np.int64), *(f[n] for f in found)]) for n in (0, 1))
    a, b = forest(parts, x, y)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def similar(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose ``features`` (row, features) are similar."""
    names = pairs.columns
    both = pairs.join(features.toDF("b", "fb"), "b").join(features.toDF("a", "fa"), "a").select(*names, "fa", "fb")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= threshold for x, y in zip(b["fa"], b["fb"], strict=True)]
            yield b.select(names).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(verified, pairs.schema)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, component, keys) turned into a row for each key, with the rows that have it and the range of their components."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t["keys"].combine_chunks()
        key, of = keys.flatten().to_numpy(), np.repeat(np.arange(len(t)), keys.value_lengths().to_numpy())
        order = np.argsort(key, kind="stable")
        key, row, component = key[order], t["row"].to_numpy()[of[order]], t["component"].to_numpy()[of[order]]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
        ends = pa.array(np.r_[first, len(key)], pa.int32())
        low, high = (f.reduceat(component, first) if len(first) else component for f in (np.minimum, np.maximum))
        columns = [pa.array(key[first]), pa.array(low), pa.array(high), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (row, component))]
        return pa.record_batch(columns, ["key", "lo", "hi", "rows", "components"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= GATHERED:
            yield out(held)
            held = []
    if held:
        yield out(held)


def crossed(rows_of: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components of ``labels``, by similar rows that share a band.

    Bands are gathered before they are dealt, and of those in one component nothing more is asked.
    The largest component of a band is not held against itself: its tiles meet only those of the others.
    """
    near = rows_of.where("size(keys) > 0").select("row", "keys", "features")
    banded = near.select("row", "keys").join(labels.withColumnRenamed("id", "row"), "row", "left").select("row", F.coalesce("component", "row").alias("component"), "keys")
    parts = written(banded.mapInArrow(by_key, "key long, lo long, hi long, rows array<long>, components array<long>"), "bands")
    several = parts.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.size("rows")).alias("n")).where("lo < hi").select("key", "n")
    members = parts.join(several, "key").select("key", "n", F.explode(F.arrays_zip("rows", "components")).alias("m"))
    members = written(members.select("key", "n", F.col("m.rows").alias("row"), F.col("m.components").alias("component")), "members")
    few = members.where(F.col("n") <= FEW)
    left, right = few.select("key", F.col("row").alias("a"), F.col("component").alias("ca")), few.select("key", F.col("row").alias("b"), F.col("component").alias("cb"))
    listed = left.join(right, "key").where("a < b and ca <> cb").select("a", "b", "ca", "cb").distinct()
    members = members.where(F.col("n") > FEW).drop("n")
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    own = F.when(F.col("component") == F.col("main"), F.col("others") + F.pmod(F.xxhash64("row"), F.ceil(F.col("most") / TILE))).otherwise(F.pmod(F.xxhash64("row"), F.col("others"))).cast("int")
    slots = members.join(mixed, "key").withColumn("others", F.ceil((F.col("n") - F.col("most")) / TILE)).withColumn("own", own)
    slots = written(slots.select("key", "row", "component", "n", "own", F.col("others").cast("int").alias("others"), F.ceil(F.col("most") / TILE).cast("int").alias("mains")), "slots")
    buckets = max(64, slots.count() // TILE)
    # A band of several tiles is a group of its own for each pair of tiles; small ones share buckets
    group = F.when(F.col("n") > TILE, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)))
    last = F.when(F.col("own") < F.col("others"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
    placed = slots.join(near.select("row", "features"), "row").withColumn("grp", group).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    placed = placed.select("grp", "key", "row", "component", "features", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tiled = placed.groupBy("grp", "i", "j").applyInArrow(lambda t: crossing(t, threshold), "a long, b long")
    return similar(listed, near.select("row", "features"), threshold).select("ca", "cb").union(tiled).distinct().toDF("a", "b")


def near_rows(docs: DataFrame, threshold: float, shingle: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Packs of ``docs``, and (row, doc_id, first, component) of all rows; ``first`` is the first row of the text."""
    packs = packed(docs, numbered=True)
    buckets = bucket_count(packs)

    def signed(number: int):
        return lambda row, told: Signed(row, told, buckets, shingle, bands, rows, number)

    def first(row: dict, told: dict) -> pa.Table:
        return asked(signed(1)(row, told).ranks.requests(buckets), row["batch"])

    def sign(row: dict, told: dict) -> pa.Table:
        """Band names to ask for, and all of the pack's, so that the last round need not throw its darts again."""
        s, batch = signed(2)(row, told), row["batch"]
        rows = [(batch, BANDS, b, blob) for b, blob in s.ranks.requests(buckets)] + [(batch, KEYS, 0, s.keys.tobytes())]
        kinds = {"batch": pa.int64(), "round": pa.int32(), "bucket": pa.int32(), "blob": pa.binary()}
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(kinds.items(), zip(*rows, strict=True), strict=True)})

    def found(row: dict, told: dict) -> pa.Table:
        """Rows with the first of their text; of those first also what is earliest in most of its bands, the bands it shares, and its features."""
        s = signed(2)(row, told)
        s.ranks.apply(told.get(BANDS, {}), buckets)
        low, many = s.ranks.low[s.ranks.inverse], s.ranks.count[s.ranks.inverse] > 1
        n, own_keys = len(s.batch.ids), s.keys.view(np.int64)
        leader, keys, features = s.batch.ids.copy(), [[]] * n, [None] * n
        for i, d in enumerate(s.own):
            part = slice(i * bands, (i + 1) * bands)
            if many[part].any():
                to, times = np.unique(low[part][low[part] != s.batch.ids[d]], return_counts=True)
                leader[d] = to[times.argmax()] if len(to) else leader[d]
                keys[d] = own_keys[part][many[part]].tolist()
                features[d] = expanded(shingles(s.words(d), shingle)).tobytes()
        numbers = pa.list_(pa.int64())
        return pa.table({"row": pa.array(s.batch.ids), "doc_id": rest_of(row)["doc_id"].cast(pa.int64()), "first": pa.array(s.low), "leader": pa.array(leader), "features": pa.array(features, pa.binary()), "keys": pa.array(keys, numbers)})

    one = written(ranked(with_answers(packs, None, first, REQUEST), COPIES), "ranks")
    signs = written(with_answers(packs, one, sign, ANSWER), "signatures")
    two = ranked(signs.where(F.col("round") == BANDS).select("bucket", "batch", "blob"), BANDS)
    rows_of = written(with_answers(packs, one.union(signs.where(F.col("round") == KEYS)).union(two), found, "row long, doc_id long, first long, leader long, features binary, keys array<long>"), "found")
    features = rows_of.where("features is not null").select("row", "features")
    led = similar(rows_of.where("leader <> row").select(F.col("leader").alias("a"), F.col("row").alias("b")), features, threshold)
    labels = components(led, "near")
    more = written(crossed(rows_of, labels, threshold), "crossed")
    if not more.isEmpty():  # components that are one after all, and rows that had none
        up = components(more, "near")
        joined = labels.join(up.toDF("component", "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        labels = written(joined.union(up.join(labels, "id", "left_anti")), "labels")
    named = rows_of.select("row", "doc_id", "first").join(labels.withColumnRenamed("id", "first"), "first", "left")
    return packs, written(named.select("row", "doc_id", "first", F.coalesce("component", "first").alias("component")), "named")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, component_id (smallest doc_id that links reach), kept (they are equal), one row per row of ``docs`` (doc_id, text, ...).

    Documents link if their multisets of ``shingle`` consecutive words have a weighted Jaccard similarity
    of ``threshold`` or more; texts under ``shingle`` words are one shingle of all their words. Null,
    empty and wordless texts link with nothing. Rows of one doc_id share a component, and a link of any of them is a link of
    the doc_id; null doc_ids have a null component, are not kept and link with nothing. Other columns are ignored; an empty
    table gives no rows. A pair that shares no band is not checked: at similarity s that has probability (1 - s**rows)**bands.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, labelled = near_rows(docs.where("doc_id is not null"), threshold, shingle, bands, rows)
    labelled = labelled.select("doc_id", "component")
    several = labelled.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("doc_id", "a")
    repeated = written(labelled.join(several, "doc_id").select("a", F.col("component").alias("b")).distinct(), "repeated")
    if not repeated.isEmpty():  # one doc_id's rows join what they are in
        up = components(repeated, "repeated").toDF("component", "up")
        labelled = labelled.join(up, "component", "left").select("doc_id", F.coalesce("up", "component").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(least, "component").select("doc_id", "component_id")
    return named.union(docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group of near duplicates, as ``near_duplicates`` finds them, with all its columns.

    Rows are judged each by its own text: rows of one doc_id with other texts stay. Of a group the row of
    the smallest doc_id stays, null being the last; of its equals any one. Null, empty and wordless texts stay.
    Columns may bear any names; an empty table gives no rows.
    """
    missing = fresh("_null", docs.columns)
    packs, grouped = near_rows(docs.withColumn(missing, F.col("text").isNull()), threshold, shingle, bands, rows)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "first", "row")
    stays = grouped.groupBy("component").agg(F.min(place)["row"].alias("row")).select("row", F.lit(True).alias("stays"))
    gone = grouped.join(stays, "row", "left").where("stays is null").select("row", F.shiftright("row", ROW_BITS).alias("batch"))

    def numbers(t: pa.Table) -> pa.Table:
        return pa.table({"batch": t["batch"].slice(0, 1), "round": pa.array([GONE], pa.int32()), "bucket": pa.array([0], pa.int32()), "blob": pa.array([np.sort(t["row"].to_numpy()).tobytes()], pa.binary())})

    names = docs.columns

    def keep(row: dict, told: dict) -> pa.Table:
        b = Batch(row, Spec(1, 1))
        left = ~np.isin(b.ids, np.frombuffer(told.get(GONE, {}).get(0, b""), np.int64))
        rest = rest_of(row)
        texts = [None if none else b.data[s:e].decode() for s, e, none in zip(b.starts[:-1], b.starts[1:], rest[missing].to_pylist(), strict=True)]
        columns = {n: rest[n] for n in rest.column_names} | {"text": pa.array(texts, pa.string())}
        return pa.table({n: columns[n] for n in names}).filter(pa.array(left))

    return with_answers(packs, gone.groupBy("batch").applyInArrow(numbers, ANSWER), keep, docs.schema)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
