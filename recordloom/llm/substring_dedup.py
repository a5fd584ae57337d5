"""Removal of passages that an earlier document has, by seed and extend.

Seeds: of the hashes of `seed` consecutive words, winnowing picks in every
window of `window` words the least (the rightmost of equal ones), so equal
windows pick the same seed wherever they stand. A seed owns the windows that
pick it, and its stretch is what they cover. Documents are joined on the
seeds that more than one document has.

Extension: occurrences of a seed with equal stretches match in all owned
windows at once; all but the first document's are repeats. Only where a match
begins or ends do stretches of a seed differ; there one occurrence of each
different stretch is extended word by word, as far as its owned windows
reach, and those that an earlier document has are repeats. The windows that
repeat run together to the maximal repeats of at least `window` words.

All groups are met by partial aggregates and by joins that Spark can split:
nothing gathers the occurrences of a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import OWN, discard, materialise, table
from .textkit import NOT_SPACE, U64, Chunk, Sequences, Words, chunks, ranges, tidy, words

#: Words of a window (the least repeat) and of a seed.
WINDOW, SEED = 13, 5
N_WORDS, N_REMOVED, KEPT, SPANS = (OWN + x for x in ("n_words", "n_removed", "kept_text", "spans"))
#: Bits of a mark: the first owned window's word, how many windows the seed owns; of a stretch's place: also the text's checksum.
_AT, _OWNS = 36, 8
_ORDER = U64((1 << 28) - 1)


def seeds(w: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each picked seed: its hash, that of its stretch, the first word of the stretch and the owned windows."""
    sequences = Sequences(w.hash)
    n = np.diff(w.first)
    first = ranges(w.first[:-1], np.maximum(n - window + 1, 0))
    if not len(first):
        none = np.zeros(0, np.int64)
        return none.astype(U64), none.astype(U64), none, none
    at = np.arange(len(w.hash) - seed + 1)
    hashes = sequences.of(at, seed)
    # the least of each run of window - seed + 1 hashes; equal ones (in 36 bits) by the place, from the right
    key, width, reach = (hashes & ~_ORDER) | (_ORDER - (at.astype(U64) & _ORDER)), 1, window - seed + 1
    while width < reach:
        step = min(width, reach - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    picked = (_ORDER - (key[first] & _ORDER)).astype(np.int64)
    picked += (first - picked + int(_ORDER)) // (int(_ORDER) + 1) * (int(_ORDER) + 1)  # places count modulo 2**28
    new = np.ones(len(first), bool)
    new[1:] = picked[1:] != picked[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(first))
    start = first[begin]
    return hashes[picked[begin]], sequences.of(start, first[end - 1] - start + window), start, end - begin


def occurrences(rows: DataFrame, window: int, seed: int, places: bool) -> DataFrame:
    """seed and doc of every seed; with places also stretch and place. rows has doc, sum (a checksum of the text) and text."""
    shape = "seed long, doc long" + ", stretch long, place long" * places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = np.asarray(batch.column(0))
            sums = np.asarray(batch.column(1)).astype(np.int64)
            for chunk in chunks(batch.column(2)):
                w = words(chunk, NOT_SPACE)
                value, stretch, start, owns = seeds(w, window, seed)
                row = np.searchsorted(w.first, start, "right") - 1
                out = {"seed": value.view(np.int64), "doc": docs[chunk.lo + row]}
                if places:
                    out |= {"stretch": stretch.view(np.int64), "place": sums[chunk.lo + row] << _AT | (start - w.first[row]) << _OWNS | owns}
                for lo in range(0, len(start), 50_000):
                    yield pa.RecordBatch.from_pydict({k: pa.array(v[lo : lo + 50_000]) for k, v in out.items()})

    return rows.mapInArrow(tidy(run), shape)


def extend(rows: DataFrame, window: int) -> DataFrame:
    """seed, stretch, doc, k and value (a hash) of every window k that the places own. rows has doc, text and found, structs of seed, stretch and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found = np.asarray(batch.column(0)), batch.column(2)
            for chunk in chunks(batch.column(1)):
                w = words(chunk, NOT_SPACE)
                sequences = Sequences(w.hash, second=True)
                part = found.slice(chunk.lo, chunk.hi - chunk.lo)
                row = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.offsets)))
                inner = part.flatten()
                seed, stretch, place = (np.asarray(inner.field(k)) for k in range(3))
                owns = place & ((1 << _OWNS) - 1)
                start = w.first[row] + (place >> _OWNS & ((1 << _AT - _OWNS) - 1))
                k = np.arange(int(owns.sum())) - np.repeat(np.cumsum(owns) - owns, owns)
                of = np.repeat(np.arange(len(seed)), owns)
                value = sequences.of(start[of] + k, window).view(np.int64)
                for lo in range(0, len(k), 50_000):
                    at = of[lo : lo + 50_000]
                    yield pa.RecordBatch.from_pydict({"seed": seed[at], "stretch": stretch[at], "doc": docs[chunk.lo + row[at]], "k": k[lo : lo + 50_000], "value": value[lo : lo + 50_000]})

    return rows.mapInArrow(tidy(run), "seed long, stretch long, doc long, k long, value long")


def marks(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """doc, sum and marks of the texts with repeats. A mark: first owned window's word, mask of the owned windows that repeat."""
    rows = rows.filter("doc is not null")
    shared = occurrences(rows, window, seed, False).groupBy("seed").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    shared = materialise(shared.filter("first < last").select("seed"), "shared")
    found = materialise(occurrences(rows, window, seed, True).join(shared, "seed"), "found")
    # the first occurrence of each different stretch
    stretches = materialise(found.groupBy("seed", "stretch").agg(F.min(F.struct("doc", "place")).alias("f")).select("seed", "stretch", F.col("f.doc").alias("doc"), F.col("f.place").alias("place")), "stretches")
    differ = stretches.groupBy("seed").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).filter("x < y").select("seed")
    wanted = stretches.join(differ, "seed").groupBy("doc", F.expr(f"shiftright(place, {_AT})").alias("sum")).agg(F.collect_list(F.struct("seed", "stretch", "place")).alias("found"))
    windows = materialise(extend(rows.join(wanted, ["doc", "sum"]).select("doc", "text", "found"), window), "windows")
    first = windows.groupBy("seed", "value").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    masks = windows.join(first, ["seed", "value"]).filter("first < doc").groupBy("seed", "stretch").agg(F.bit_or(F.expr("shiftleft(1L, cast(k AS int))")).alias("mask"))
    # written, so that both sides of the next join are shuffled for it and Spark can split a stretch that very many documents have
    judged = materialise(stretches.select("seed", "stretch", F.col("doc").alias("first")).join(masks, ["seed", "stretch"], "left"), "judged")
    discard(shared, stretches, windows)
    owned = F.expr(f"shiftleft(1L, cast(place & {(1 << _OWNS) - 1} AS int)) - 1")
    got = found.join(judged, ["seed", "stretch"]).select(
        "doc",
        F.expr(f"shiftright(place, {_AT})").alias("sum"),
        F.expr(f"shiftright(place, {_OWNS}) & {(1 << _AT - _OWNS) - 1}").alias("at"),
        F.when(F.col("doc") > F.col("first"), owned).otherwise(F.coalesce("mask", F.lit(0))).alias("mask"),
    )
    got = got.filter("mask <> 0").groupBy("doc", "sum").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
    got = materialise(got, "marks")
    discard(found, judged)
    return got


def remove(w: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row's words that are not gone, joined by one space, and where each row's begin."""
    n = len(w.data)
    kept = np.flatnonzero(~gone)
    left = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(~gone, out=left[1:])
    rows = left[w.first]
    last = np.zeros(len(kept), bool)
    last[rows[1:][np.diff(rows) > 0] - 1] = True
    data = np.append(w.data, np.uint8(0))
    spaces = w.end[kept[~last]]
    data[spaces] = 0x20
    change = np.zeros(n + 2, np.int8)
    change[w.start[kept]] += 1
    change[w.end[kept]] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    inside[spaces] = True
    sizes = w.end[kept] - w.start[kept] + ~last
    total = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    return data[inside], total[rows]


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default) with N_WORDS, N_REMOVED, KEPT (the words that stay, joined by one space) and SPANS, the removed runs (numbers of first and last word).

    A word goes if a window of `window` consecutive words that covers it also
    starts in a document with a smaller id, judged on the input. Null and
    empty texts have no words; texts with fewer words than a window keep all.
    Rows without an id keep all and are no document's source. Rows that
    repeat an id are one document: none is the other's source. An empty table
    gives no rows; other columns are passed on as they are.
    """
    if window - seed + 1 > 60:
        raise ValueError("a seed may own at most 60 windows")
    keep = [c for c in docs.columns if c not in (N_WORDS, N_REMOVED, KEPT, SPANS)] if keep is None else keep
    own = (OWN + "doc", OWN + "sum")
    check = F.pmod(F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.lit(1 << 27))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), check.alias("sum"), F.col(text).alias("text"))
    repeats = marks(rows, window, seed).withColumnsRenamed({"doc": own[0], "sum": own[1], "marks": OWN + "marks"})
    kept = docs.select(*keep, F.col(doc_id).cast("long").alias(own[0]), check.alias(own[1]), F.col(text).alias(OWN + "text"))
    rows = kept.join(repeats, list(own), "left").select(*keep, OWN + "text", OWN + "marks")
    n = len(keep)
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    typed = kept.select(*keep).withColumns({N_WORDS: F.lit(0).cast("long"), N_REMOVED: F.lit(0).cast("long"), KEPT: F.lit("")})
    schema = typed.withColumn(SPANS, F.lit(None).cast("array<struct<first:long,last:long>>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(n + 1)
            for chunk in chunks(batch.column(n)):
                part = found.slice(chunk.lo, chunk.hi - chunk.lo)
                yield pa.RecordBatch.from_arrays([*(c.slice(chunk.lo, len(part)) for c in batch.columns[:n]), *clean(chunk, part, window, span)], names=[*keep, N_WORDS, N_REMOVED, KEPT, SPANS])

    return rows.mapInArrow(tidy(run), schema)


def clean(chunk: Chunk, found: pa.ListArray, window: int, span: pa.DataType) -> list[pa.Array]:
    w = words(chunk, NOT_SPACE)
    n, rows = len(w.hash), len(w.first) - 1
    found = found.fill_null([])
    row = np.repeat(np.arange(rows), np.diff(np.asarray(found.offsets)))
    inner = found.flatten()
    at, mask = (np.asarray(inner.field(k)).astype(np.int64) for k in range(2))
    change = np.zeros(n + window + 1, np.int64)
    for k in range(int(mask.max(initial=0)).bit_length()):
        start = (w.first[row] + at + k)[mask >> k & 1 == 1]
        change[: n + 1] += np.bincount(start, minlength=n + 1) - np.bincount(start + window, minlength=n + 1)
    gone = np.cumsum(change[:n]) > 0
    total = np.zeros(n + 1, np.int64)
    np.cumsum(gone, out=total[1:])
    data, offsets = remove(w, gone)
    cut = np.zeros(n + 1, bool)
    cut[w.first] = True
    before, after = np.append(False, gone[:-1]), np.append(gone[1:], False)
    first, last = np.flatnonzero(gone & (~before | cut[:n])), np.flatnonzero(gone & (~after | cut[1:]))
    base = w.first[np.searchsorted(w.first, first, "right") - 1]
    spans = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], fields=list(span))
    return [
        pa.array(np.diff(w.first)),
        pa.array(np.diff(total[w.first])),
        pa.StringArray.from_buffers(rows, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(first, w.first).astype(np.int32)), spans),
    ]


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return got.select(
        "doc_id",
        F.col(N_WORDS).alias("n_words"),
        F.col(N_REMOVED).alias("n_removed"),
        F.sha2(F.col(KEPT).cast("binary"), 256).alias("kept_sha256"),
    )


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (win) WHERE first < doc_id) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(ps, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
