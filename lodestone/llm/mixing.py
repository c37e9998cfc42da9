"""Operator 3: how much of each document a mix takes, so that sources come to their target sizes.

Method: Sainte-Lague apportionment. Blocks of equal numbers of words go by highest quotients to
the sources (votes: their targets), from each source to its racks of shards and from each rack to its
shards (votes: their words), so that no group holds more than the sources, a source's racks, or a rack's shards.
A shard's quota is whole passes and, for the rest, blocks of its hashed order of documents drawn by seed.
What blocks miss of a target (less than a block or so) is taken in words, so that sources come out exactly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 n + 1); ties to the earlier party."""
    votes = np.maximum(np.asarray(votes, np.float64), 0)
    out = np.zeros(len(votes), np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return out
    # Seats at a divisor under which no more than ``seats`` quotients lie above it; the rest, at most one or two a party, by quotients.
    low, high = votes.sum() / (2 * seats + 2 * len(votes) + 2), 2 * votes.sum() / seats + 1
    for _ in range(100):
        middle = (low + high) / 2
        if _above(votes, middle).sum() > seats:
            low = middle
        else:
            high = middle
    out = _above(votes, high)
    while (left := seats - int(out.sum())) > 0:
        quotients = votes / (2 * out + 1)
        best = np.argsort(-quotients, kind="stable")[:left]
        ahead = best[quotients[best] >= (votes[best] / (2 * out[best] + 3)).max()]  # what no second seat of another comes before
        out[ahead if len(ahead) else best[:1]] += 1
    return out


def _above(votes: np.ndarray, divisor: float) -> np.ndarray:
    """How many of each party's quotients are above ``divisor``."""
    n = np.maximum(0, np.ceil((votes / divisor - 1) / 2)).astype(np.int64)
    n += votes / (2 * n + 1) > divisor
    n -= (n > 0) & ~(votes / np.maximum(1, 2 * n - 1) > divisor)
    return n


def dealt_words(room: np.ndarray, votes: np.ndarray, words: int, block: int) -> np.ndarray:
    """``words`` in blocks by quotients of ``votes``, none over its ``room``; what blocks miss or a full one leaves goes to where room is."""
    out = np.minimum(sainte_lague(votes, words // block) * block, room)
    left = min(words, int(room.sum())) - int(out.sum())
    order = np.argsort(out - room, kind="stable")
    free = (room - out)[order]
    out[order] += np.clip(left - np.r_[0, np.cumsum(free)[:-1]], 0, free)
    return out


def targets(sizes: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """(key, source_size, n_docs, target) of sources of ``sizes(key, source, size, copies)``: shares by weight of ``total`` times all sizes, none over ``most`` times its size.

    Weights go round by code point, null last; what a full source leaves is shared again by weight.
    """
    by = sizes.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_docs"))
    n = len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("r") % n).cast("int") + 1)
    ranked = by.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", weight)
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "r")
    before, here = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc(F.col("cap") / F.col("w")), F.desc("r"))
    left = F.sum("source_size").over(Window.partitionBy()) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("w").over(here.rowsBetween(Window.unboundedPreceding, 0))
    leveled = ranked.withColumn("level", level)
    full = F.col("cap") <= F.col("level") * F.col("w")
    first = F.min(F.when(~full, F.struct("place", "level"))).over(Window.partitionBy())
    leveled = leveled.withColumn("place", F.row_number().over(order))
    target = F.when(full | first.isNull(), F.col("cap")).otherwise(first["level"] * F.col("w"))
    return leveled.select("key", "source_size", "n_docs", target.alias("target"))


#: Shards of a rack. A source of 10^14 words has some 10^5 racks.
RACK = 4096


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 42, shard_words: int = 1 << 18) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the parts taken, for each row of ``docs`` (doc_id, text, source, ...).

    ``taken`` is in words with repeats; ``passes`` whole copies of the text and the words
    ``spans`` (flat first/after-last pairs) of one more. Null text has size 0, null source is a source of
    its own; repeated rows are documents of their own (``copy`` numbers rows of equal doc_id, source and text), a null or repeated
    doc_id is no key of its own; a source of size 0 has target 0; an empty table gives no rows; other columns are ignored.
    The same rows and seed give the same mix, however they are dealt to partitions.
    """
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", key.alias("key"), n_words().alias("size"), F.xxhash64("text").alias("h"))
    sizes = written(sizes.groupBy("doc_id", "source", "key", "size", "h").agg(F.count("*").alias("copies")), "sizes")
    aim = written(targets(sizes, weights, total, most), "targets")
    words = aim.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = int(min(1024, max(1, words // 65536)))

    def to_sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All sources; ``quota``: words to take, in blocks by quotients and then to the word."""
        parts = [b for b in batches if len(b)]
        if parts:
            part = pd.concat(parts).sort_values("key", kind="stable")
            aims = np.rint(part["target"].to_numpy()).astype(np.int64)
            yield part.assign(quota=dealt_words(aims, part["target"].to_numpy(), int(aims.sum()), block))

    dealt = aim.coalesce(1).mapInPandas(to_sources, "key string, source_size long, n_docs long, target double, quota long")
    aim = written(dealt, "aims")
    # Copies of one row are dealt like others. A row of very many copies is spread before it is multiplied
    step = 1 << 12
    many = sizes.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / step))))
    many = many.repartition("doc_id", "h", "run").withColumn("copy", F.explode(F.sequence(F.col("run") * step, F.least((F.col("run") + 1) * step, "copies") - 1))).drop("run", "copies")
    shards = F.ceil((F.col("source_size") + F.col("n_docs") + 1) / shard_words)
    placed = many.join(F.broadcast(aim) if aim.count() <= 10_000 else aim, "key")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h", "copy"), shards)).withColumn("place", F.xxhash64("doc_id", "h", "copy", F.lit(seed)))
    by_shard = placed.groupBy("key", "shard").agg(F.sum("size").alias("words"))
    by_shard = written(by_shard.withColumn("rack", F.floor(F.col("shard") / RACK)), "shards")

    def deal(by: list[str], out: str):
        def f(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(by, kind="stable").reset_index(drop=True)
            size = part["words"].to_numpy()
            quota = dealt_words(np.floor(most * size).astype(np.int64), size, int(part["quota"][0]), block)
            return part[by].assign(**{out: quota})

        return f

    racks = by_shard.groupBy("key", "rack").agg(F.sum("words").alias("words")).join(aim.select("key", "quota"), "key")
    racks = racks.groupBy("key").applyInPandas(deal(["key", "rack"], "of_rack"), "key string, rack long, of_rack long")
    in_rack = by_shard.join(racks, ["key", "rack"]).withColumnRenamed("of_rack", "quota")
    quotas = written(in_rack.groupBy("key", "rack").applyInPandas(deal(["key", "shard"], "quota"), "key string, shard long, quota long"), "quotas")

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", "doc_id", "h", "copy"], kind="stable").reset_index(drop=True)
        size = part["size"].to_numpy()
        ends = np.cumsum(size)
        line, quota = int(ends[-1]), int(part["quota"][0])
        passes, quota = divmod(quota, line) if line else (0, 0)
        blocks = -(-line // block)
        order = np.random.default_rng([seed, zlib.crc32(part["key"][0].encode()), int(part["shard"][0])]).permutation(blocks)
        length = np.minimum(order * block + block, line) - order * block
        before = np.r_[0, np.cumsum(length)]
        n = int(np.searchsorted(before, quota, "left"))
        first = np.sort(order[:n]) * block
        last = np.minimum(first + block, line)
        if n and before[n] > quota:
            last[np.searchsorted(first, order[n - 1] * block)] -= int(before[n] - quota)
        spans: list[list[int]] = [[] for _ in range(len(part))]
        taken = passes * size
        doc = np.searchsorted(ends, first, "right")
        for a, e, d in zip(first.tolist(), last.tolist(), doc.tolist(), strict=True):
            while a < e:
                to, start = min(e, int(ends[d])), int(ends[d] - size[d])
                if to > a:
                    s = spans[d]
                    if s and s[-1] == a - start:
                        s[-1] = to - start
                    else:
                        s += [a - start, to - start]
                    taken[d] += to - a
                a, d = to, d + 1
        return part[["doc_id", "size", "source_size", "target", "key", "h", "copy"]].assign(taken=taken, passes=passes, spans=spans)

    both = placed.drop("quota").join(quotas, ["key", "shard"])
    return both.groupBy("key", "shard").applyInPandas(draw, "doc_id long, size long, source_size long, target double, key string, h long, copy long, taken long, passes long, spans array<int>")


TEXT_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def numbered(rows: DataFrame, by: list[str], order: str, number: str, parts: int = 256) -> DataFrame:
    """``rows`` with a number from 0 among those of equal ``by``, in ``order``; no task sees all of a large group."""
    part = F.pmod(F.xxhash64(order), F.lit(parts))
    dealt = rows.withColumn("_part", part)
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order)) - 1
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_part"]]
    both = dealt.withColumn("_inside", inside).alias("l").join(starts.alias("r"), same)
    return both.select(*(F.col(f"l.{c}") for c in rows.columns), (F.col("_before") + F.col("_inside")).alias(number))


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with its columns: whole copies, then the part of one more.

    A part is the text from the first to the last word of each span, spans joined by one space; ``n_chars``, where there, is
    counted anew for it. Documents that the mix leaves out are gone; so are those without words. Columns may bear any names.
    Rows of equal doc_id, source and text are numbered to tell them apart; which of them is which does not matter to the mix.
    """
    names = docs.columns
    row, passes, spans = (fresh(n, names) for n in ("_row", "_passes", "_spans"))
    texts = written(docs.withColumn(row, F.monotonically_increasing_id()), "texts")  # a row's number is fixed with the file
    plan = mix(docs=texts, **how).where("taken > 0").select("doc_id", "key", "h", "copy", F.col("passes").alias("_passes"), F.col("spans").alias("_spans"))
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    told = texts.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.xxhash64("text").alias("h"), F.col(row).alias("_row"))
    told = numbered(told, ["doc_id", "key", "h"], "_row", "copy")
    same = [told[c].eqNullSafe(plan[c]) for c in ("doc_id", "key", "h", "copy")]
    plan = told.join(plan, same).select(F.col("_row").alias(row), F.col("_passes").alias(passes), F.col("_spans").alias(spans))
    both = texts.join(plan, row).select(*names, passes, spans)

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 200):  # a few long texts at a time
                c = b.slice(a, 200)
                times, parts, column = c[passes].to_pylist(), c[spans].to_pylist(), c["text"]
                take = [i for i, n in enumerate(times) for _ in range(n)]
                part = {i: _part(column[i].as_py(), s) for i, s in enumerate(parts) if s}
                whole = pa.table({n: c[n].take(pa.array(take, pa.int64())) for n in names})
                few = {n: c[n].take(pa.array(list(part), pa.int64())) for n in names} | {"text": pa.array(list(part.values()), pa.string())}
                if "n_chars" in few:
                    few["n_chars"] = pa.array([len(t) for t in part.values()], pa.int64()).cast(few["n_chars"].type)
                yield from pa.concat_tables([whole, pa.table({n: few[n].cast(whole[n].type) for n in names})]).combine_chunks().to_batches()

    return both.mapInArrow(repeat, docs.schema)


def _part(text: str, spans: list[int]) -> str:
    at = [m.span() for m in TEXT_WORD.finditer(text)]
    return " ".join(text[at[a][0] : at[e - 1][1]] for a, e in zip(spans[::2], spans[1::2], strict=True))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
