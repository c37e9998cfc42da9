"""Operator 10: near-duplicate vectors by cosine.

Method: projection passes. In each pass a vector's key is the concatenation of the sign
bits of random projections; rows of one key are all compared with each other, in tiles of bounded
size where they are many, and verified pairs are united across passes. Bits follow the number of
rows, and passes the bits, so that a pair at the threshold shares a key in some pass with the asked
probability. Links exist only within components: their counts come from all pairs of each
component, in tiles of bounded size. Equal vectors enter once, with their number.

What is dealt in passes and tiles are 16-bit codes with the norm of what they leave out. Most pairs are decided by the
bounds that these give; the few within the bounds of the threshold are fetched and computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, written
from .vectors import codes, matrix, quantised, usable

TILE = 1024
KEY, CODE = ["pass", "dim", "key"], ["id", "code", "scale", "rest", "stands"]


def bits_for(rows: int, window: int) -> int:
    """Bits of a key: were keys dealt evenly, half of ``window`` rows or a little fewer would share one."""
    return max(1, math.ceil(math.log2(max(2, rows) / window)) + 1)


def passes_for(bits: int, cosine: float, found: float) -> int:
    """Passes after which a pair of that cosine has shared a key with probability ``found``."""
    same = 1 - math.acos(cosine) / math.pi
    return max(4, math.ceil(math.log(1 - found) / math.log(1 - same**bits)))


def keys(v: np.ndarray, number: int, seed: int, bits: int) -> np.ndarray:
    planes = np.random.default_rng([seed, number, v.shape[1]]).standard_normal((v.shape[1], bits))
    return (v @ planes > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def decided(t: pa.Table, left: np.ndarray, right: np.ndarray, cosine: float):
    """(rows of ``left``, surely linked, perhaps linked) of these rows with ``right``, some rows at a time."""
    code, scale, rest, stands = codes(t["code"].take(pa.array(np.r_[left, right])), np.int16).astype(np.float64), *(t[c].to_numpy() for c in ("scale", "rest", "stands"))
    x, y = code[: len(left)], code[len(left) :]
    for c in range(0, len(left), 256):
        at = left[c : c + 256]
        near = (x[c : c + 256] @ y.T) * scale[at, None] * scale[right][None]
        # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'| of unit vectors, and a little for rounding
        error = rest[at, None] + stands[at, None] * rest[right][None] + 1e-9
        sure = near - error >= cosine
        yield slice(c, c + 256), sure, (near + error >= cosine) & ~sure


def neighbours(t: pa.Table, cosine: float) -> pa.Table:
    """Linked pairs of each key of ``t``, in one pair of tiles; as many as join the same rows, and those to be computed exactly."""
    t = t.sort_by([("key", "ascending"), ("id", "ascending")]).combine_chunks()
    ids, own, i, j = t["id"].to_numpy(), t["own"].to_numpy(), int(t["i"][0].as_py()), int(t["j"][0].as_py())
    found: list[tuple] = []
    for s, e in runs(t["key"].to_numpy()):
        left, right = (s + np.flatnonzero(own[s:e] == x) for x in (i, j))
        if not len(left) or not len(right):
            continue
        links, open_ = [], []
        for at, sure, perhaps in decided(t, left, right, cosine):
            x, y = np.nonzero(sure)
            links.append(forest(np.arange(e - s), left[at][x] - s, right[y] - s))
            x, y = np.nonzero(perhaps)
            open_.append((left[at][x] - s, right[y] - s))
        (a, b), (x, y) = ([np.concatenate(v) for v in zip(*both, strict=True)] for both in (links, open_))
        label = np.arange(e - s)
        a, b = forest(label, a, b)
        label[b] = a
        keep = label[x] != label[y]
        x, y = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
        found += [(ids[s + a], ids[s + b], np.ones(len(a), bool)), (ids[s + x], ids[s + y], np.zeros(len(x), bool))]
    columns = [np.concatenate(v) for v in zip(*found, strict=True)] or [ids[:0], ids[:0], np.zeros(0, bool)]
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64()), "sure": pa.array(columns[2], pa.bool_())})


def counted(t: pa.Table, cosine: float) -> pa.Table:
    """Links of each vector with those of its component, in one pair of tiles; and pairs (id, other) to be computed exactly."""
    t = t.sort_by([("component", "ascending"), ("dim", "ascending"), ("own", "ascending"), ("id", "ascending")]).combine_chunks()
    ids, copies, own, i, j = t["id"].to_numpy(), t["copies"].to_numpy(), t["own"].to_numpy(), int(t["i"][0].as_py()), int(t["j"][0].as_py())
    links, open_ = np.zeros(len(ids), np.int64), []
    change = (t["component"].to_numpy()[1:] != t["component"].to_numpy()[:-1]) | (t["dim"].to_numpy()[1:] != t["dim"].to_numpy()[:-1])
    for s, e in runs(np.r_[0, np.cumsum(change)][: len(ids)]):
        left, right = (s + np.flatnonzero(own[s:e] == x) for x in (i, j))
        if not len(left) or not len(right):
            continue
        for at, sure, perhaps in decided(t, left, right, cosine):
            links[left[at]] += sure @ copies[right]
            if i != j:
                links[right] += copies[left[at]] @ sure
            x, y = np.nonzero(perhaps)
            x, y = left[at][x], right[y]
            open_ += [(x, y), (y, x)] if i != j else [(x, y)]
    a, b = (np.concatenate([o[n] for o in open_] or [np.zeros(0, np.int64)]) for n in (0, 1))
    return pa.table({"id": pa.array(np.r_[ids, ids[a]]), "other": pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids[b], pa.int64())]), "links": pa.array(np.r_[links, copies[b]])})


def exactly(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose vectors in ``vectors`` (id, v) have the cosine, in double precision."""
    names = pairs.columns
    both = pairs.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("_x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("v").alias("_y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b["_x"]])
            fits = np.zeros(len(size), bool)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x, y = (unit_rows(matrix(b[c].take(pa.array(at)))) for c in ("_x", "_y"))
                fits[at] = (x * y).sum(1) >= cosine
            yield b.select(names).filter(pa.array(fits))

    return both.select(*names, "_x", "_y").mapInArrow(check, pairs.schema)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, window: int = 64, found: float = 0.999, seed: int = 7, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of ``vectors``.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do
    vectors of different length. Repeated rows and equal vectors link with each other; rows of one id share a
    component. Null ids keep null component and are not kept, with 0 links. Other columns are ignored; an empty
    table gives no rows. ``window`` sets the bits of a key, not a bound on what is compared.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    able = rows.where(usable("v") & F.col("vec_id").isNotNull())
    firsts = written(able.groupBy("v").agg(F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    n, widest = firsts.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    bits = bits_for(n, window)
    passes = passes_for(bits, cosine, found)

    def keyed(coded: bool):
        """Keys of all passes, with or without ids and codes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size = np.array([len(x) for x in b["v"]])
                for d in np.unique(size):
                    part = b.filter(pa.array(size == d))
                    v = matrix(part["v"])
                    if coded:
                        code, *bounds = quantised(unit_rows(v), np.int16)
                        more = [part["id"], pa.array([c.tobytes() for c in code], pa.binary()), *map(pa.array, bounds)]
                    for p in range(passes):
                        key = [pa.array([p] * len(v), pa.int32()), pa.array([int(d)] * len(v), pa.int32()), pa.array(keys(v, p, seed, bits))]
                        yield pa.record_batch(key + (more if coded else []), KEY + (CODE if coded else []))

        return run

    sorts = firsts.select("id", "v").mapInArrow(keyed(True), "pass int, dim int, key long, id long, code binary, scale double, rest double, stands double")
    side = max(256, min(4 * TILE, (1 << 19) // widest))
    groups = max(1, n // side)
    # Keys of many rows are few, at most one for each ``side`` rows of a pass; each is a group of its own for each pair of tiles
    many = firsts.select("id", "v").mapInArrow(keyed(False), "pass int, dim int, key long").groupBy("pass", "dim", "key").agg(F.count("*").alias("n")).where(F.col("n") > side)
    dealt = sorts.join(written(many, "keys"), ["pass", "dim", "key"], "left").withColumn("sides", F.coalesce(F.ceil(F.col("n") / side), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("grp", F.when(F.col("sides") > 1, F.col("key")).otherwise(-1 - F.pmod(F.xxhash64("key"), F.lit(groups))))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, sides - 1)")))
    dealt = dealt.select("pass", "dim", "grp", "key", *CODE, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    pairs = written(dealt.groupBy("pass", "dim", "grp", "i", "j").applyInArrow(lambda t: neighbours(t, cosine), "a long, b long, sure boolean"), "pairs")
    checked = exactly(pairs.where("not sure").select("a", "b").distinct(), firsts, cosine)
    labels = components(pairs.where("sure").select("a", "b").union(checked), "vectors")
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    buckets = max(64, n // (4 * TILE))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b["v"]])
            for d in np.unique(size):
                part = b.filter(pa.array(size == d))
                code, *bounds = quantised(unit_rows(matrix(part["v"])), np.int16)
                yield pa.record_batch([part["component"], part["copies"], pa.array([int(d)] * len(part), pa.int32()), part["id"], pa.array([c.tobytes() for c in code], pa.binary()), *map(pa.array, bounds)], ["component", "copies", "dim", *CODE])

    linked = firsts.join(labels, "id").select("component", "copies", "id", "v").mapInArrow(coded, "component long, copies long, dim int, id long, code binary, scale double, rest double, stands double")
    placed = linked.join(written(sizes, "sizes"), "component").withColumn("tiles", tiles)
    # A component of several tiles is a group of its own for each pair of tiles; small ones share buckets
    group = F.when(F.col("tiles") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(buckets)))
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    placed = placed.withColumn("grp", group).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    placed = placed.select("grp", "component", "copies", "dim", *CODE, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    told = written(placed.groupBy("grp", "i", "j").applyInArrow(lambda t: counted(t, cosine), "id long, other long, links long"), "links")
    more = exactly(told.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"), "links"), firsts, cosine)
    links = told.where("other is null").select("id", "links").union(more.select("a", "links")).groupBy("id").agg(F.sum("links").alias("links"))
    # Components and ids by the smallest vec_id; one vec_id of several vectors joins theirs
    known = firsts.select("v", "id", "copies").join(links, "id", "left").join(labels, "id", "left")
    known = known.select("v", F.coalesce("component", "id").alias("component"), (F.coalesce("links", "copies") - 1).alias("n_links"))
    named = written(able.join(known, "v").select("vec_id", "n_links", "component"), "named")
    several = named.groupBy("vec_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("vec_id", "a")
    repeated = written(named.join(several, "vec_id").select("a", F.col("component").alias("b")).distinct(), "repeated")
    if not repeated.isEmpty():
        up = components(repeated, "repeated").toDF("component", "up")
        named = named.join(up, "component", "left").select("vec_id", "n_links", F.coalesce("up", "component").alias("component"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked_rows = named.join(least, "component").select("vec_id", "n_links", "component_id")
    others = rows.where(~(usable("v") & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.union(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def runs(v: np.ndarray) -> list[tuple[int, int]]:
    cut = np.r_[0, np.flatnonzero(v[1:] != v[:-1]) + 1, len(v)]
    return [(int(s), int(e)) for s, e in zip(cut[:-1], cut[1:], strict=True) if e > s]
