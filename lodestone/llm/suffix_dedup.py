"""Operator 1: byte strings that repeat across documents are cut from all but the earliest of them.

Method: not prefix doubling of rank pairs (the README says why, with figures), but ranking of hashed
names in three rounds: of picked positions, of whole segments with one pick, of single windows of the
threshold's length. Spark deals names by range, and each range is sorted and ranked (smallest
document, count) in one group; what is unique leaves, the rest goes on with longer names. See
``windows`` for how positions are picked, so that every window is judged, by names of 96 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .windows import REQUEST, Batch, Replay, Spec, asked, first_rounds, ranked, rest_of, with_answers

ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(batch: Batch, covered: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Remaining bytes of each document, how many are removed, and in how many runs."""
    raw, b = np.frombuffer(batch.data, np.uint8), batch.bounds
    before = np.r_[0, np.cumsum(covered)]
    rise = covered & ~np.r_[False, covered[:-1]]
    inner = b[:-1][batch.lens > 0]
    rise[inner] = covered[inner]
    runs = np.r_[0, np.cumsum(rise)]
    removed = before[b[1:]] - before[b[:-1]]
    kept = [batch.data[s:e] if not n else raw[s:e][~covered[s:e]].tobytes() for s, e, n in zip(b[:-1], b[1:], removed, strict=True)]
    return kept, removed, runs[b[1:]] - runs[b[:-1]]


def suffix_dedup(docs: DataFrame, length: int = 50, k: int = 20, with_text: bool = False) -> DataFrame:
    """``docs`` (doc_id long, text string, ...) without the byte runs that ``length``-byte strings of earlier documents cover.

    Returns doc_id, ``n_bytes, n_removed, n_spans, kept_sha256``; with ``with_text`` instead all
    columns of ``docs``, with ``text`` cut (bytes of a character cut in two are dropped) and
    ``n_chars``, where there, counted anew.

    Null text counts as empty, stays null under ``with_text``; an empty or short text (under
    ``length`` bytes) is kept whole; a null doc_id is later than all others; rows of one doc_id
    do not cut each other; other columns pass through whatever their names; an empty table
    gives an empty result.
    """
    if not 0 < k < length:
        raise ValueError("k must be positive and under length")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    spec = Spec(k, length)
    source = docs if with_text else docs.select("doc_id", "text")
    missing = fresh("_null", docs.columns)
    packs, told, buckets = first_rounds(source.withColumn(missing, F.col("text").isNull()), spec)

    def ask(row: dict, got: dict) -> pa.Table:
        r = Replay(row, got, spec, buckets, 3)
        return asked(r.windows(r.open).requests(buckets), row["batch"])

    def finish(row: dict, got: dict) -> pa.Table:
        r = Replay(row, got, spec, buckets, 3)
        w = r.windows(r.open)
        w.apply(got.get(3, {}), buckets)
        kept, removed, spans = cut(r.batch, r.covered(r.at[w.low[w.inverse] < r.at_doc]))
        rest = rest_of(row)
        if with_text:
            text = [None if none else k.decode("utf-8", "ignore") for k, none in zip(kept, rest[missing].to_pylist(), strict=True)]
            columns = {n: rest[n] for n in rest.column_names} | {"text": pa.array(text, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in text], pa.int64())
            return pa.table({n: columns[n] for n in names})
        return pa.table({"doc_id": rest["doc_id"], "n_bytes": pa.array(r.batch.lens), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array(spans.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    if with_text:
        kinds = {"text": T.StringType(), "n_chars": T.LongType()}
        schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in source.schema])
        names = source.columns
    else:
        schema = f"doc_id long, {ADDED}"
    three = ranked(with_answers(packs, told, ask, REQUEST), 3)
    return with_answers(packs, told.union(three), finish, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
