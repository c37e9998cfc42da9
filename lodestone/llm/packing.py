"""Operator 8: documents packed into sequences of a fixed number of tokens.

Method: minimum bin slack. Each bin takes the longest piece left; bitset subset sums over the
lengths that are left find the fullest combination for the rest of it, which is then removed.
Pieces are dealt by hash into shards of bounded size; each shard fills its own bins.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import texts
from .common import written
from .tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
END_ID = 1


def pieces(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document's ids and the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end, step = encoder(vocabulary).encode, END_ID.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            rows: tuple[list, ...] = [], [], [], [], []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                ids = code(text.as_py()) + end
                for i, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    for to, v in zip(rows, (doc, i, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        to.append(v)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


class Stock:
    """Lengths left, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.lengths = counts, sorted(counts)

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def fullest(self, room: int) -> list[int]:
        """Lengths whose sum is as near to ``room`` as subset sums of the stock come."""
        lengths, counts, mask = self.lengths, self.counts, (1 << room + 1) - 1
        reach, steps, aim = 1, [], 1 << room
        for i in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
            n = lengths[i]
            for _ in range(min(counts[n], room // n)):
                more = reach | (reach << n) & mask
                if more == reach:
                    break
                steps.append((n, reach))
                reach = more
                if reach & aim:
                    break
            if reach & aim:
                break
        at, chosen = reach.bit_length() - 1, []
        for n, before in reversed(steps):
            if not at:
                break
            if not before >> at & 1:  # only with this one
                chosen.append(n)
                at -= n
        return chosen


def fill(counts: dict[int, int], capacity: int) -> Iterator[list[int]]:
    """Bins of lengths, until the stock is empty."""
    stock = Stock(dict(counts))
    while stock.lengths:
        first = stock.lengths[-1]
        stock.take(first)
        rest = stock.fullest(capacity - first) if first < capacity else []
        for n in rest:
            stock.take(n)
        yield [first, *rest]


def best_fit(parts: DataFrame, capacity: int = 4096, shard_pieces: int = 40_000) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``; lengths are from 1 to ``capacity``."""
    parts = written(parts, "pieces")
    shards = max(1, -(-parts.count() // shard_pieces))
    columns = parts.columns

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        groups = {n: list(i) for n, i in part.groupby("length").indices.items()}
        at, offset = [0] * len(part), [0] * len(part)
        base = int(part["shard"].iloc[0]) << 32
        for number, chosen in enumerate(fill({int(n): len(i) for n, i in groups.items()}, capacity)):
            place = 0
            for n in chosen:
                row = groups[n].pop()
                at[row], offset[row] = base | number, place
                place += n
        return part[columns].assign(sequence_id=at, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    # Dealt by place in the written table: null and repeated doc_ids spread like others
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(pack, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of ``docs`` (doc_id long, text string, ...): its place in a sequence of at most ``capacity`` tokens.

    Every document's ids end with id 1, so null and empty texts are one piece of one token;
    documents over ``capacity`` are cut, others never. Repeated rows are packed each; null
    doc_ids stay null; other columns are ignored; an empty table gives no rows.
    """
    return best_fit(pieces(docs, capacity, vocabulary), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(texts(spark, sf_dir))
