"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy with calibrated probabilities.

Random indexing: every word has a sparse random index vector, given by its
hash; a word's vector is the sum of the index vectors of its neighbours over
the whole corpus. Words share a fixed number of buckets, so that the table of
vectors has a fixed size: tasks add up their own, these are summed in three
steps, and the driver gets one table. Labels are learned from a
bounded sample of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import OWN, crc_mod, partial_sums, summed, table
from .textkit import U64, Chunk, chunks, mix, tidy, words

#: Buckets of words, dimensions, non-zeros of an index vector, neighbours on either side.
BUCKETS, DIMENSIONS, NONZEROS, REACH = 1 << 14, 32, 2, 2
#: Labelled rows that the network is fitted to at most (about, by a hash of the id); its hidden units and passes.
MOST_LABELLED, HIDDEN, PASSES = 20_000, 32, 60
SLICE, POOL_BYTES = 1 << 15, 1 << 20
SCORE = OWN + "quality"
THRESHOLD = 0.3

#: Words are runs of letters, digits and non-ASCII characters, and runs of other visible characters.
_LETTERS = np.zeros(256, bool)
_LETTERS[0x30:0x3A] = _LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[0x21:0x7F] = ~_LETTERS[0x21:0x7F]


def word_buckets(chunk: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word in order, and the number of the first word of each row."""
    a, b = words(chunk, _LETTERS), words(chunk, _SIGNS)
    start = np.concatenate([a.start, b.start])
    order = np.argsort(start, kind="stable")
    bucket = (np.concatenate([a.hash, b.hash])[order] >> U64(64 - buckets.bit_length() + 1)).astype(np.int64)
    return bucket, a.first + b.first


def index_vectors(buckets: int, dimensions: int, nonzeros: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of each bucket's index vector."""
    x = mix(mix(np.arange(buckets, dtype=U64))[:, None] ^ mix(np.arange(1, nonzeros + 1, dtype=U64)))
    return (x % U64(dimensions)).astype(np.int64), np.where(x >> U64(63), 1.0, -1.0)


def word_vectors(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of all word buckets, from all rows of docs; zero for buckets without a neighbour. Null texts have no words."""
    rows = docs.select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(buckets, dimensions, NONZEROS)
        total = np.zeros(buckets * dimensions)
        for batch in batches:
            for chunk in chunks(batch.column(0), 4 << 20):
                bucket, first = word_buckets(chunk, buckets)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for apart in range(1, REACH + 1):
                    same = row[apart:] == row[:-apart]
                    left, right = bucket[:-apart][same], bucket[apart:][same]
                    for word, near in ((left, right), (right, left)):
                        for k in range(NONZEROS):
                            total += np.bincount(word * dimensions + place[near, k], sign[near, k], buckets * dimensions)
        cuts = range(0, len(total), SLICE)
        yield partial_sums({"slice": [i // SLICE for i in cuts]}, [total[i : i + SLICE] for i in cuts])

    got = summed(rows.mapInArrow(tidy(run), "slice long, task int, width int, sums binary"), ["slice"]).toPandas().sort_values("slice")
    flat = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, f"i{w}") for w, x in zip(got["width"], got["sums"]))])
    out = (flat if len(flat) else np.zeros(buckets * dimensions)).reshape(buckets, dimensions).astype(float)
    length = np.sqrt((out**2).sum(1, keepdims=True))
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def features(dimensions: int) -> int:
    return 2 * dimensions + 2


def pooled(chunk: Chunk, vectors: np.ndarray) -> np.ndarray:
    """Of each row's word vectors the mean, the spread, the mean product of neighbours, and the logarithm of their number; zero without words."""
    bucket, first = word_buckets(chunk, len(vectors))
    n = np.diff(first)
    out = np.zeros((len(n), features(vectors.shape[1])), np.float32)
    full = np.flatnonzero(n)
    # rows of few words at a time, so that what is gathered stays small
    for part in np.array_split(full, max(1, len(bucket) >> 16)):
        if len(part):
            a = first[part[0]]
            v = vectors[bucket[a : first[part[-1] + 1]]]
            size = n[part][:, None]
            begin = first[part] - a
            mean = np.add.reduceat(v, begin, axis=0) / size
            spread = np.sqrt(np.maximum(np.add.reduceat(v * v, begin, axis=0) / size - mean**2, 0))
            near = np.einsum("ij,ij->i", v, np.roll(v, 1, axis=0))
            near[begin] = 0
            out[part] = np.hstack([mean, spread, np.add.reduceat(near, begin)[:, None] / size, np.log1p(size)])
    return out


@dataclass
class Network:
    """Two layers over standardised features, and a temperature for the logit."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, passes: int = PASSES, seed: int = 1) -> Network:
    """Adam on the log loss; a fifth of the rows is held back for the temperature. With no rows, or one label only, the scores are the label's rate."""
    x, y, rng = x.astype(float), y.astype(float), np.random.default_rng(seed)
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(rate / (1 - rate))))
    order = rng.permutation(len(y))
    kept, held = order[len(y) // 5 :], order[: len(y) // 5]
    scale = x[kept].std(0)
    net = Network(x[kept].mean(0), np.where(scale > 1e-9, scale, 1), rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), float(np.log((y[kept].mean() + 1e-3) / (1 - y[kept].mean() + 1e-3))))
    names = ("w1", "b1", "w2", "b2")
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(passes):
        rng.shuffle(kept)
        for lo in range(0, len(kept), 256):
            part = kept[lo : lo + 256]
            z = (x[part] - net.centre) / net.scale
            h = np.tanh(z @ net.w1 + net.b1)
            err = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - y[part]) / len(part)
            back = err[:, None] * net.w2 * (1 - h**2)
            t += 1
            for k, g in zip(names, (z.T @ back + 1e-4 * net.w1, back.sum(0), h.T @ err + 1e-4 * net.w2, err.sum())):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
    if len(held):
        z = net.logit(x[held])
        loss = lambda s: np.logaddexp(0, -np.where(y[held] > 0.5, z, -z) / s).mean()
        net.temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    return net


def vectors_of(docs: DataFrame, vectors: np.ndarray, text: str, keep: list[str], net: Network | None = None) -> DataFrame:
    """The columns in keep with the pooled vector, or with SCORE if a network is given."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))
    rows = docs.select(*keep, F.col(text).alias(OWN + "text"))
    name, kind = (OWN + "vector", "array<float>") if net is None else (SCORE, "double")
    schema = docs.select(*keep).withColumn(name, F.lit(None).cast(kind)).schema
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = held.value
        for batch in batches:
            out = [np.zeros((0, features(vectors.shape[1])), np.float32), *(pooled(chunk, vectors) for chunk in chunks(batch.column(n), POOL_BYTES))]
            x = np.concatenate(out)
            got = pa.array(list(x), pa.list_(pa.float32())) if net is None else pa.array(net.score(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], got], names=[*keep, name])

    return rows.mapInArrow(tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most: int = MOST_LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors from all rows of docs, and a network from about `most` of the labelled ones, chosen by a hash of the id.

    A null label or id teaches nothing; of an id that is labelled more than
    once the larger label counts.
    """
    vectors = word_vectors(docs, text)
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(OWN + "id")).agg(F.max(label).alias(OWN + "label"))
    share = min(1.0, most / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(OWN + "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias(OWN + "id"), F.col(text).alias("text")).join(known, OWN + "id")
    got = vectors_of(rows, vectors, "text", [OWN + "id", OWN + "label"]).toPandas().sort_values(OWN + "id")
    x = np.array(got[OWN + "vector"].tolist(), float).reshape(len(got), features(vectors.shape[1]))
    return vectors, train(x, got[OWN + "label"].to_numpy(float))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default) with SCORE, the probability of label 1.

    Whole texts are scored; null and empty texts, and texts without words,
    get the score of a zero vector. Rows are independent, so repeated rows
    and null ids have no effect; an empty table gives no rows; other columns
    are passed on as they are.
    """
    keep = [c for c in docs.columns if c != SCORE] if keep is None else keep
    return vectors_of(docs, model[0], text, keep, model[1])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id") != 0)
    got = score(docs, fit(docs, labels), keep=["doc_id"])
    return got.select("doc_id", (crc_mod("doc_id") == 0).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))
