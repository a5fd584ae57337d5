"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered by every task for its own rows, added up in three steps,
and only the table of log-probabilities, whose size is
fixed by the parameters, goes to the driver and back out as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import OWN, crc_mod, partial_sums, summed, table
from .textkit import _LOWER, Chunk, chunks, tidy

#: Buckets of n-grams (a power of two), orders of n-grams, added to each count; languages at most, which bounds the broadcast.
BUCKETS, ORDERS, SMOOTHING, MOST_LANGS = 1 << 15, (1, 2, 3), 0.5, 256
SLICE, PART_BYTES = 4096, 1 << 18
LANG, SCORE = OWN + "lang", OWN + "score"
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
_LETTER = regex.compile(r"\p{L}")


def code_points(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk, ASCII capitals lowered, and where each row starts."""
    data = _LOWER[chunk.data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, before[chunk.offsets]


def ngrams(points: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams inside rows, and where each row's begin."""
    n = len(points) - order + 1
    lengths = np.maximum(np.diff(offsets) - order + 1, 0)
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(lengths, out=first[1:])
    if n <= 0 or not first[-1]:
        return np.zeros(0, np.int64), first
    key = np.full(n, order * 0x3C6EF372 & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(order):
            key += points[k : k + n] * np.uint32(_FACTORS[k])
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
    key >>= np.uint32(33 - buckets.bit_length())
    if order > 1:  # n-grams that reach into the next row go
        inside = np.ones(n + 1, bool)
        for end in offsets[1:-1]:
            inside[max(0, end - order + 1) : end] = False
        short = np.flatnonzero(np.diff(offsets) < order)
        for row in short:
            inside[offsets[row] : offsets[row + 1]] = False
        key = key[inside[:n]]
    return key, first


@dataclass
class Model:
    """langs in alphabetical order; weights[order][lang] has the log-probability of each bucket."""

    langs: list[str]
    prior: np.ndarray
    weights: np.ndarray
    orders: tuple[int, ...]

    def predict(self, chunk: Chunk) -> tuple[list[str], np.ndarray]:
        rows = chunk.hi - chunk.lo
        points, offsets = code_points(chunk)
        total = np.tile(self.prior, (rows, 1))
        for k, order in enumerate(self.orders):
            key, first = ngrams(points, offsets, order, self.weights.shape[2])
            full = np.flatnonzero(np.diff(first))
            if len(full):
                for lang in range(len(self.langs)):
                    total[full, lang] += np.add.reduceat(self.weights[k, lang][key], first[full])
        letter = (points >= 97) & (points <= 122)
        letters = np.zeros(len(points) + 1, np.int64)
        np.cumsum(letter, out=letters[1:])
        found = letters[offsets[1:]] > letters[offsets[:-1]]
        for row in np.flatnonzero(~found):
            found[row] = bool(_LETTER.search(chunk.text(row).decode()))
        if not self.langs:
            return ["und"] * rows, np.zeros(rows)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if f else "und" for b, f in zip(best, found)], np.where(found, score, 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, smoothing: float = SMOOTHING) -> Model:
    """Learns from every row with a language. Null texts count as empty; with no such row there are no languages.

    More than MOST_LANGS languages are an error, since the model would not be of bounded size.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name in set(names) - counts.keys():
                counts[name] = np.zeros((len(orders), buckets), np.int64)
                if len(counts) > MOST_LANGS:
                    raise ValueError(f"more than {MOST_LANGS} languages")
            for chunk in chunks(batch.column(1), PART_BYTES):
                here = names[chunk.lo : chunk.hi]
                distinct = sorted(set(here))
                code = np.array([distinct.index(x) for x in here])
                points, offsets = code_points(chunk)
                for k, order in enumerate(orders):
                    key, first = ngrams(points, offsets, order, buckets)
                    sums = np.bincount(key + np.repeat(code * buckets, np.diff(first)), minlength=len(distinct) * buckets).reshape(-1, buckets)
                    for name, x in zip(distinct, sums):
                        counts[name][k] += x
        for name, x in counts.items():
            flat = x.ravel()
            cuts = range(0, len(flat), SLICE)
            yield partial_sums({"lang": [name] * len(cuts), "slice": [i // SLICE for i in cuts]}, [flat[i : i + SLICE] for i in cuts])

    got = summed(rows.mapInArrow(tidy(count), "lang string, slice long, task int, width int, sums binary"), ["lang", "slice"]).toPandas()
    docs_of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()}
    langs = sorted(docs_of)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    flat = {name: np.concatenate([np.frombuffer(x, f"i{w}") for w, x in part.sort_values("slice")[["width", "sums"]].itertuples(index=False)]) for name, part in got.groupby("lang")}
    counts = np.array([flat[x].reshape(len(orders), buckets) for x in langs], float).reshape(len(langs), len(orders), buckets) + smoothing
    weights = np.log(counts / counts.sum(2, keepdims=True)).transpose(1, 0, 2).copy() if langs else np.zeros((len(orders), 0, buckets))
    prior = np.log(np.array([docs_of[x] for x in langs], float) / max(1, sum(docs_of.values())))
    return Model(langs, prior, weights, tuple(orders))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default) with LANG and SCORE, the posterior probability of that language.

    LANG is `und` and SCORE 0 where the text is null or has no letter, or
    nothing was learned. Whole texts are scored. Rows are independent, so
    repeated rows and null ids have no effect; an empty table gives no rows;
    other columns are passed on as they are.
    """
    keep = [c for c in docs.columns if c not in (LANG, SCORE)] if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)
    # the text goes last under a name of its own
    rows = docs.select(*keep, F.col(text).alias(OWN + "text"))
    schema = rows.drop(OWN + "text").withColumn(LANG, F.lit("")).withColumn(SCORE, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], [np.zeros(0)]
            for chunk in chunks(batch.column(len(keep)), PART_BYTES):
                names, score = held.value.predict(chunk)
                langs += names
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[*keep, LANG, SCORE])

    return rows.mapInArrow(tidy(run), schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(crc_mod("doc_id") != 0))
    got = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return got.select("doc_id", (crc_mod("doc_id") == 0).alias("held_out"), F.col(LANG).alias("lang_pred"), F.col(SCORE).alias("score"))
