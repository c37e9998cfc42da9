"""Operator 9: the language of a text, by cross-parsing entropy.

Method: a suffix automaton over a bounded sample of labelled text for each language. A text is
parsed greedily into the longest matches that a language's automaton holds, across words; stretches of
``STRETCH`` symbols are parsed each, so that many run side by side, and a phrase ends with its stretch at the latest. The
cross-parsing entropy is the number of phrases times the bits of a place in the sample, so that
languages with larger samples, in which longer matches are found, have no advantage of it; the language of
the smallest wins.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import texts
from .common import fresh

UNKNOWN = "und"
STRETCH = 256
#: Transition tables of all languages together; those beyond it are searched in sorted keys.
DENSE_BYTES = 128 << 20
#: Symbols that are parsed at once.
AT_ONCE = 1 << 21


@functools.cache
def is_letter() -> np.ndarray:
    """Whether each code point is of Unicode category L."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def plain(text: str) -> str:
    """The runs of letters of a text, lower-cased, each with a space before it, and a last space; empty without letters."""
    p = code_points(text)
    letter = is_letter()[p]
    if not letter.any():
        return ""
    whole = np.r_[np.uint32(32), np.where(letter, p, np.uint32(32)), np.uint32(32)]
    return whole[np.r_[True, (whole[1:] != 32) | (whole[:-1] != 32)]].tobytes().decode("utf-32-le", "surrogatepass")


class TextAutomaton:
    """Suffix automaton of one string."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, nxt, last = [-1], [0], self.next, 0
        for c in text:
            new, p = len(length), last
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


class Parser:
    """Steps of many parses at once. An entry is the state to go to, times ``wide``, and how many phrases end."""

    def __init__(self, nxt: list[dict[str, int]], alphabet: dict[str, int], dense: bool):
        own = {c: i for i, c in enumerate(sorted({c for step in nxt for c in step}), 1)}  # 0: occurs in no state
        self.wide = wide = len(own) + 1
        self.remap = np.zeros(len(alphabet) + 1, np.int64)
        for c, i in own.items():
            self.remap[alphabet[c]] = i
        state = np.repeat(np.arange(len(nxt)), [len(step) for step in nxt])
        symbol = np.array([own[c] for step in nxt for c in step], np.int64)
        target = np.array([t for step in nxt for t in step.values()], np.int64)
        self.root = np.full(wide, 1, np.int64)  # a letter that never occurs is a phrase
        first = state == 0
        self.root[symbol[first]] = target[first] * wide << 2
        if dense:
            table = np.tile(self.root, (len(nxt), 1))
            table[1:] += 1
            table[state, symbol] = target * wide << 2
            self.table, self.keys = table.reshape(-1), None
        else:
            order = np.argsort(state * wide + symbol)
            self.keys, self.table = (state * wide + symbol)[order], (target * wide << 2)[order]

    def entries(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        own = self.remap[symbol]
        at = state + own
        if self.keys is None:
            return self.table[at]
        i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[i] == at, self.table[i], self.root[own] + (state != 0))


class Model:
    """Languages with their sampled text."""

    def __init__(self, texts: dict[str, str], dense_bytes: int = DENSE_BYTES):
        samples = {lang: plain(t) for lang, t in sorted(texts.items()) if plain(t)}
        self.languages, self.bits = list(samples), np.array([math.log2(len(t) + 1) for t in samples.values()])
        alphabet = {c: i for i, c in enumerate(sorted(set().union(*samples.values())), 1)}
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in alphabet]] = list(alphabet.values())
        self.parsers, room = [], dense_bytes
        for t in samples.values():
            nxt = TextAutomaton(t).next
            size = 8 * len(nxt) * (len(set(t)) + 1)
            self.parsers.append(Parser(nxt, alphabet, size <= room))
            room -= size if size <= room else 0

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each of the ``plain`` texts (rows) by each language (columns)."""
        sizes = np.array([len(t) for t in texts])
        symbols = self.classes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = -(-sizes // STRETCH)
        of = np.repeat(np.arange(len(texts)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.cumsum(sizes) - sizes, n) + nth * STRETCH
        length = np.minimum(STRETCH, np.repeat(sizes, n) - nth * STRETCH)
        order = np.argsort(-length, kind="stable")
        of, start, length = of[order], start[order], length[order]
        states = np.zeros((len(self.parsers), len(of)), np.int64)
        ended = np.zeros((len(self.parsers), len(of)), np.int64)
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i))  # those longer than i
            symbol = symbols[start[:live] + i]
            for j, parser in enumerate(self.parsers):
                entry = parser.entries(states[j, :live], symbol)
                ended[j, :live] += entry & 3
                states[j, :live] = entry >> 2
        ended += states != 0
        return np.array([np.bincount(of, e, len(texts)) for e in ended]).reshape(len(self.parsers), len(texts)).T

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        held, at, size = [], [], 0
        for i, t in enumerate(texts):
            p = plain(t) if t and self.languages else ""
            if p:
                held.append(p)
                at.append(i)
                size += len(p)
            if held and (size >= AT_ONCE or i + 1 == len(texts)):
                cost = self.phrases(held) * self.bits
                best = cost.argmin(1)
                lowest = cost.min(1)
                cost[np.arange(len(held)), best] = np.inf
                for k, b, least, rest in zip(at, best, lowest, cost.min(1), strict=True):
                    out[k] = self.languages[b], float(1 / (1 + least / rest))
                held, at, size = [], [], 0
        return out


_models: dict[int, Model] = {}


def model(texts: dict[str, str]) -> Model:
    """One model a process and sample."""
    key = hash(tuple(sorted(texts.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


def held_out(column: str = "doc_id", modulus: int = 4, remainder: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def sample_texts(docs: DataFrame, documents: int = 120, stretch: int = 6000, letters_each: int = 40_000, languages: int = 200) -> dict[str, str]:
    """Text to learn each language from: documents in hashed order, those over ``stretch`` characters by a stretch of so many from a hashed place.

    At most ``documents`` a language, as many as fit into ``letters_each`` characters, of the ``languages`` of the smallest names.
    """
    able = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    start = F.greatest(F.lit(1), 1 + F.pmod(F.xxhash64("doc_id", F.lit(9)), F.greatest(F.length("text") - stretch + 1, F.lit(1)))).cast("int")
    part = F.substring(F.col("text"), start, F.lit(stretch)).alias("part")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "part")
    rows = able.select("doc_id", "lang", part).withColumn("n", F.row_number().over(order)).where(F.col("n") <= documents)
    rows = rows.withColumn("l", F.dense_rank().over(Window.orderBy("lang"))).where(F.col("l") <= languages).orderBy("n", "lang")
    texts: dict[str, str] = {}
    for r in rows.select("lang", "part").collect():
        if plain(r["part"]) and len(texts.get(r["lang"], "")) + len(r["part"]) <= letters_each:
            texts[r["lang"]] = texts.get(r["lang"], "") + " " + r["part"]
    return texts


def predicted(docs: DataFrame, texts: dict[str, str], language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``language`` and ``score``, which it must not have."""
    sent = docs.sparkSession.sparkContext.broadcast(texts)  # of the bounded size that sample_texts documents
    names, added = docs.columns, [language, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model(sent.value).predict
        for b in batches:
            both = predict(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in both], pa.string()), pa.array([x[1] for x in both], pa.float64())], [*names, *added])

    out = T.StructType([*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, out)


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which the language can be told, with all its columns; null ``lang`` is filled with it.

    Null, empty and letterless texts go, as does all if no row can be learnt from. Columns may bear any
    names; repeated rows are judged each; an empty table gives no rows.
    """
    language, score = fresh("_language", docs.columns), fresh("_score", docs.columns)
    told = predicted(docs, sample_texts(docs), language, score).where(F.col(language) != UNKNOWN)
    return told.select(*(F.coalesce("lang", language).alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang, ...).

    Null, empty or letterless texts (no character of category L) are ``und`` with score 0; so is all if no row can be learnt
    from. The score is the share of the runner-up's entropy in both; equal ones give
    the language of smaller name and 0.5, a single language 1. A null doc_id is not held out and
    not learnt from. Repeated rows are each predicted; other columns are ignored.
    """
    texts = sample_texts(docs)
    return predicted(docs.select("doc_id", held_out().alias("held_out"), "text"), texts).drop("text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(texts(spark, sf_dir))
