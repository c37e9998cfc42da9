"""Operator 7: the nearest vectors by inner product, for a stated set of queries against all rows.

Method: block matrix join. Queries and candidates are packed into blocks of int8 codes; every pair of blocks
is one int8 product tile, with bounds of the quantisation error from the vectors' own
residues. Heaps of each query's best lower bounds run over the tiles of a task; candidates whose upper bound reaches the k-th best
lower bound of all tiles leave as pairs of ids, and only for these the original vectors are fetched and computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, quantised, usable

PACK = "dim int, block int, ids binary, codes binary, bounds binary"


class Tile:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.code = np.frombuffer(row["codes"], np.int8).reshape(len(self.ids), -1)
        self.scale, self.rest, self.stands, self.norm = np.frombuffer(row["bounds"], np.float64).reshape(4, -1)


class Heaps:
    """For each query of a block: the k best lower bounds so far, and the candidates whose upper bounds reach the k-th."""

    def __init__(self, q: Tile, k: int):
        self.q, self.k = q, k
        self.best = np.full((len(q.ids), k), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, c: Tile, rows: int = 256) -> None:
        q, k, wide = self.q, self.k, c.code.astype(np.float32).T  # products of up to 2**9 components are exact in float32; longer ones in blocks
        dim = wide.shape[0]
        for a in range(0, len(q.ids), rows):
            s = slice(a, a + rows)
            code = q.code[s].astype(np.float32)
            dot = sum((code[:, i : i + 512] @ wide[i : i + 512]).astype(np.float64) for i in range(0, dim, 512))
            near = dot * q.scale[s, None] * c.scale[None]
            # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, and a little for rounding
            err = (q.rest[s, None] * c.norm[None] + q.stands[s, None] * c.rest[None]) * (1 + 1e-9) + 1e-12 * q.norm[s, None] * c.norm[None]
            own = q.ids[s, None] == c.ids[None]
            low = np.where(own, -np.inf, near - err)
            top = np.partition(low, low.shape[1] - k, axis=1)[:, -k:] if low.shape[1] > k else low
            both = np.concatenate([self.best[s], top], axis=1)
            self.best[s] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            i, j = np.nonzero((near + err >= self.best[s].min(1)[:, None]) & ~own)
            self.held.append((a + i, c.ids[j], (near + err)[i, j], low[i, j]))
            self.waiting += len(i)
        if self.waiting > 8 * k * len(q.ids):
            self.prune()

    def prune(self) -> None:
        i, ids, up, low = (np.concatenate(v) for v in zip(*self.held, strict=True))
        keep = up >= self.best.min(1)[i]
        self.held, self.waiting = [(i[keep], ids[keep], up[keep], low[keep])], 0

    def rows(self) -> pa.RecordBatch:
        self.prune()
        i, ids, up, low = self.held[0]
        return pa.record_batch([pa.array(self.q.ids[i]), pa.array(ids), pa.array(up), pa.array(low)], ["query_id", "vec_id", "up", "low"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = 8192, block: int = 8192, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows of ``vectors`` of largest inner product with each row of ``queries``.

    A row never finds rows of its own id. Ties go to the smaller id. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do null ids; vectors of other length than the query's are no
    candidates. Repeated rows are candidates each, and queries of one id share their k. No usable rows give no rows; other
    columns are ignored. ``query_block`` and ``block`` are rows of vectors of up to 64 components; longer ones get fewer.
    """
    number = F.monotonically_increasing_id()

    def usable_rows(df: DataFrame, what: str) -> DataFrame:
        """Rows with numbers of their own, by which repeated ids are told apart."""
        rows = df.select(F.col(id_column).cast("long").alias("own_id"), F.col(vector).cast("array<double>").alias("v")).where(usable("v") & F.col("own_id").isNotNull())
        return written(rows.withColumn("row", number), what)

    def packs(df: DataFrame, n: int) -> DataFrame:
        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by("id").combine_chunks()
            v = matrix(t["v"])
            code, *bounds = quantised(v)
            held = [t["dim"][0].as_py()], [t["block"][0].as_py()], [t["id"].to_numpy().astype(np.int64).tobytes()], [code.tobytes()], [np.concatenate([*bounds, np.linalg.norm(v, axis=1)]).tobytes()]
            return pa.table([pa.array(x, f) for x, f in zip(held, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["dim", "block", "ids", "codes", "bounds"])

        placed = df.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
        return placed.select("dim", "block", F.col("own_id").alias("id"), "v").groupBy("dim", "block").applyInArrow(pack, PACK)

    some, asked = usable_rows(vectors, "rows"), usable_rows(queries, "queries")
    # Of equal vectors no query needs more than those of the k + 1 smallest ids, its own among them, and k rows of each
    of_id = Window.partitionBy("v", "own_id").orderBy("row")
    of_vector = Window.partitionBy("v").orderBy("own_id")
    some = some.withColumn("n", F.row_number().over(of_id)).where(F.col("n") <= k).withColumn("n", F.dense_rank().over(of_vector)).where(F.col("n") <= k + 1)
    some = written(some.drop("n"), "candidates")
    count, widest = some.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    fewer = max(1, -(-widest // 64))
    n_blocks, n_queries = max(1, -(-count * fewer // block)), max(1, -(-asked.count() * fewer // query_block))
    left = packs(asked, n_queries).select("dim", F.col("block").alias("qb"), F.struct("ids", "codes", "bounds").alias("q"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb")
    right = packs(some, n_blocks).select("dim", every, F.col("block").alias("cb"), F.struct("ids", "codes", "bounds").alias("c"))
    tiles = right.join(left, ["dim", "qb"]).repartition(min(n_blocks * n_queries, 4096), "dim", "qb", "cb").sortWithinPartitions("dim", "qb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heaps = None, None
        for b in batches:
            for i in range(b.num_rows):
                key = b["dim"][i].as_py(), b["qb"][i].as_py()
                if key != at:
                    if heaps:
                        yield heaps.rows()
                    at, heaps = key, Heaps(Tile(b["q"][i].as_py()), k)
                heaps.add(Tile(b["c"][i].as_py()))
        if heaps:
            yield heaps.rows()

    found = written(tiles.mapInArrow(run, "query_id long, vec_id long, up double, low double"), "survivors")
    best = Window.partitionBy("query_id").orderBy(F.desc("low"))
    floor = found.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("low").alias("floor"))
    pairs = found.join(floor, "query_id", "left").where("floor is null or up >= floor").select("query_id", "vec_id").distinct()
    # Rows of the pairs' ids: of repeated ids all, and those of other length fall out below
    x = asked.select(F.col("own_id").alias("query_id"), F.col("row").alias("q_row"), F.col("v").alias("x"))
    y = some.select(F.col("own_id").alias("vec_id"), F.col("row").alias("c_row"), F.col("v").alias("y"))
    both = pairs.join(y, "vec_id").join(x, "query_id").where("size(x) = size(y)")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, out = np.array([len(v) for v in b["x"]]), np.zeros(b.num_rows)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                out[at] = (matrix(b["x"].take(pa.array(at))) * matrix(b["y"].take(pa.array(at)))).sum(1)
            yield pa.record_batch([b["query_id"], b["vec_id"], b["c_row"], pa.array(out)], ["query_id", "vec_id", "c_row", "score"])

    scored = both.select("query_id", "vec_id", "c_row", "x", "y").mapInArrow(score, "query_id long, vec_id long, c_row long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "c_row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
