"""Benchmark decontamination with suffix arrays of the training texts.

The documents are cut into shards (chunks of whole documents inside a task).
Each shard gets a suffix array over its words; every suffix of every
benchmark item is binary-searched in it, which gives all places where the
suffix's window occurs. There the two texts are compared further, by bisection
over hashes of ranges of words, so each place has its longest verbatim match.
A suffix of a document that can't hold a whole window of benchmark vocabulary
can't match and is left out of the array, so that the array is sparse but
complete. The benchmark is the query set: it is taken in blocks of bounded
size, each broadcast and run against all documents; between blocks the
documents are written, so one block is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import OWN, discard, materialise, table
from .textkit import ALNUM, U64, Chunk, Sequences, chunks, ranges, tidy, words

#: Words of a window; bytes of benchmark text that are broadcast at once; bytes of text in a shard.
WINDOW, BLOCK_BYTES, SHARD_BYTES = 10, 32 << 20, 1 << 20
N_WORDS, N_HIT, LONGEST, SPANS, ITEMS, MATCHES = (OWN + x for x in ("n_words", "n_hit", "longest", "spans", "items", "matches"))
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_MATCH = pa.struct([("item_id", pa.string()), ("at", pa.int64()), ("first", pa.int64()), ("words", pa.int64())])
KINDS = pa.schema([(N_WORDS, pa.int64()), (N_HIT, pa.int64()), (LONGEST, pa.int64()), (SPANS, pa.list_(_SPAN)), (ITEMS, pa.list_(pa.string())), (MATCHES, pa.list_(_MATCH))])
_FOUND = f"{SPANS} array<struct<first:long,last:long>>, {ITEMS} array<string>, {MATCHES} array<struct<item_id:string,at:long,first:long,words:long>>"


def packed(ids: np.ndarray, per: int) -> list[np.ndarray]:
    """Rows of word numbers as keys of `per` words each, which compare as the rows do."""
    bits = U64(64 // per)
    out = []
    for at in range(0, ids.shape[1], per):
        key = np.zeros(len(ids), U64)
        for k in range(at, at + per):
            key <<= bits
            if k < ids.shape[1]:
                key |= ids[:, k]
        out.append(key)
    return out


def bisect(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """For each wanted key, how many of the sorted keys are less (right: less or equal)."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        middle = (lo + hi) >> 1
        at = np.minimum(middle, len(keys[0]) - 1)
        less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, w in zip(keys, wanted):
            here = k[at]
            less |= equal & (here < w)
            equal &= here == w
        below = (less | equal if right else less) & open_
        lo = np.where(below, middle + 1, lo)
        hi = np.where(below | ~open_, hi, middle)
    return lo


class Queries:
    """The suffixes of a block of benchmark items: each one's window (its first words), its item, and that item's words."""

    def __init__(self, item_ids: list[str], texts: pa.Array, window: int):
        self.window, self.sequences = window, None
        hashes, starts, sizes, items, firsts, ends = [np.zeros(0, U64)], [], [], [], [], []
        base = 0
        for chunk in chunks(texts):
            w = words(chunk, ALNUM, lower=True)
            hashes.append(w.hash)
            for row, n in enumerate(np.diff(w.first)):
                if n:
                    size = min(window, int(n))
                    starts.append(base + w.first[row] + np.arange(n - size + 1))
                    sizes.append(np.full(n - size + 1, size))
                    items.append(np.full(n - size + 1, chunk.lo + row))
                    firsts.append(np.full(n - size + 1, base + w.first[row]))
                    ends.append(np.full(n - size + 1, base + w.first[row + 1]))
            base += len(w.hash)
        self.hashes = hashes = np.concatenate(hashes)
        self.vocabulary = np.unique(hashes)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary >> U64(48)).astype(np.int64)] = True
        self.item_ids = item_ids
        if not starts:
            self.size = np.zeros(0, np.int64)
            return
        self.start, self.size, self.item, self.first, self.end = (np.concatenate(x) for x in (starts, sizes, items, firsts, ends))
        self.least = int(self.size.min())
        self.per = next(n for n in (4, 3, 2, 1) if len(self.vocabulary) + 2 < 1 << (64 // n) or n == 1)
        ids = np.searchsorted(self.vocabulary, hashes).astype(U64) + U64(1)
        at = np.minimum(self.start[:, None] + np.arange(window), len(ids) - 1)
        short = np.arange(window) >= self.size[:, None]
        self.low = packed(np.where(short, U64(0), ids[at]), self.per)
        self.high = packed(np.where(short, U64((1 << (64 // self.per)) - 1), ids[at]), self.per)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary, from 1; 0 for others."""
        out = np.zeros(len(hashes), U64)
        maybe = np.flatnonzero(self.seen[(hashes >> U64(48)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        good = self.vocabulary[at] == hashes[maybe]
        out[maybe[good]] = at[good].astype(U64) + U64(1)
        return out


def longest(queries: Queries, of: np.ndarray, own: Sequences, place: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from each place of a shard and from the suffix `of` that has its window there; most: words up to the end of the row."""
    if queries.sequences is None:
        queries.sequences = Sequences(queries.hashes)
    start = queries.start[of]
    lo, hi = queries.size[of].copy(), np.minimum(most, queries.end[of] - start)
    while (open_ := lo < hi).any():
        middle = np.where(open_, (lo + hi + 1) >> 1, lo)
        same = own.of(place, middle) == queries.sequences.of(start, middle)
        lo, hi = np.where(open_ & same, middle, lo), np.where(open_ & ~same, middle - 1, hi)
    return lo


def in_order(match: tuple[str, int, int, int]) -> tuple[int, str, int]:
    return match[2], match[0], match[1]


def search(queries: Queries, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[list, list[str], list]]]:
    """Of each row of a shard its words and hit words; of rows with hits the runs (first and last word), the items and the maximal matches."""
    w = words(chunk, ALNUM, lower=True)
    rows, n = chunk.hi - chunk.lo, len(w.hash)
    n_words, n_hit = np.diff(w.first), np.zeros(rows, np.int64)
    if not n or not len(queries.size):
        return n_words, n_hit, {}
    ids = queries.numbers(w.hash)
    # words from here to the end of the stretch of known words inside a row
    stop = ids == 0
    ends = np.union1d(np.flatnonzero(stop), w.first[1:])
    rest = ends[np.searchsorted(ends, np.arange(n), "right")] - np.arange(n)
    rest[stop] = 0
    suffixes = np.flatnonzero(rest >= queries.least)
    if not len(suffixes):
        return n_words, n_hit, {}
    reach = np.arange(queries.window)
    heads = np.where(reach < rest[suffixes][:, None], ids[np.minimum(suffixes[:, None] + reach, n - 1)], U64(0))
    keys = packed(heads, queries.per)
    order = np.lexsort(keys[::-1])
    array, keys = suffixes[order], [k[order] for k in keys]
    # suffixes of the benchmark whose first words occur at all, then the whole window
    maybe = np.flatnonzero(np.searchsorted(keys[0], queries.low[0]) < np.searchsorted(keys[0], queries.high[0], "right"))
    lo = bisect(keys, [k[maybe] for k in queries.low], False)
    hi = bisect(keys, [k[maybe] for k in queries.high], True)
    found = hi > lo
    maybe, lo, count = maybe[found], lo[found], (hi - lo)[found]
    if not len(maybe):
        return n_words, n_hit, {}
    place, of = array[ranges(lo, count)], np.repeat(maybe, count)
    size, item, start = queries.size[of], queries.item[of], queries.start[of]
    change = np.bincount(place, minlength=n + 1) - np.bincount(place + size, minlength=n + 1)
    hit = np.zeros(n + 2, bool)
    hit[1:-1] = np.cumsum(change[:n]) > 0
    row = w.row
    n_hit = np.bincount(row[hit[1:-1]], minlength=rows)
    cut = np.zeros(n + 1, bool)
    cut[w.first] = True
    first = np.flatnonzero(hit[1:-1] & (~hit[:-2] | cut[:n]))
    last = np.flatnonzero(hit[1:-1] & (~hit[2:] | cut[1:]))
    pairs = np.unique(np.stack([row[place], item], 1), axis=0)
    # a match that the word before prolongs is part of the one that begins there
    whole = cut[place] | (start == queries.first[of]) | (w.hash[place - 1] != queries.hashes[start - 1])
    place, of, item, start = place[whole], of[whole], item[whole], start[whole]
    length = longest(queries, of, Sequences(w.hash), place, w.first[row[place] + 1] - place)
    order = np.argsort(place, kind="stable")
    matches = np.stack([item, start - queries.first[of], place - w.first[row[place]], length], 1)[order]
    of_row = row[place][order]
    out = {}
    for r in np.flatnonzero(n_hit):
        a, b = np.searchsorted(first, w.first[r]), np.searchsorted(first, w.first[r + 1])
        runs = np.stack([first[a:b], last[a:b]], 1) - w.first[r]
        c, d = np.searchsorted(pairs[:, 0], [r, r + 1])
        e, f = np.searchsorted(of_row, [r, r + 1])
        own = [(queries.item_ids[i], at, begin, size) for i, at, begin, size in matches[e:f].tolist()]
        out[int(r)] = runs.tolist(), sorted({queries.item_ids[i] for i in pairs[c:d, 1]}), sorted(own, key=in_order)
    return n_words, n_hit, out


def blocks(benchmark: DataFrame, text: str, item_id: str, window: int, block_bytes: int) -> Iterator[tuple[Queries, bool]]:
    """The benchmark in blocks of about block_bytes, and whether a block is the last; an item is whole in one block. At least one block."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).filter("id is not null")
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("id")).alias("n")).first()["n"] or 0
    n = -(-max(1, total) // block_bytes)
    for k in range(n):
        got = items.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k).toArrow()
        yield Queries(got.column("id").to_pylist(), got.column("text"), window), k == n - 1


def united(runs: list[list[int]]) -> list[list[int]]:
    """The union of runs of words, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with its words, hit words, the runs of hit words (numbers of first and last word), the items found, the maximal matches and the words of the longest.

    The columns in keep (all by default) are passed on. A window is `window`
    consecutive words of an item, or the whole item if it has fewer; words
    are maximal runs of ASCII letters (lowered), digits and non-ASCII
    characters. A match is a verbatim passage of an item that holds a window
    and can't be prolonged on either side: the item, the number of its first
    word there and in the document, and how many words. Null texts have no
    words; items without words or without an id match nothing; rows of one
    item_id with different texts are windows of the same item. An empty
    benchmark hits nothing; empty documents give no rows. Rows are judged one
    by one, so repeated rows get equal results. With a benchmark of several
    blocks, all columns of docs are written to the shared folder after each
    block but the last.
    """
    own = OWN + "text"
    keep = [c for c in docs.columns if c not in (own, *KINDS.names)] if keep is None else keep
    got = docs.select(*keep, F.lit(None).cast(f"struct<{_FOUND.replace(' array', ':array')}>").alias(OWN + "was"), F.col(text).alias(own))
    previous = None
    for queries, last in blocks(benchmark, item_text, item_id, window, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(queries)
        counts = ", ".join(f"{c} long" for c in KINDS.names[:3])
        found = T.StructType.fromDDL(f"{counts}, {_FOUND}" + ("" if last else f", {own} string"))
        got = got.mapInArrow(tidy(_searcher(held, keep, last)), T.StructType(got.select(*keep).schema.fields + found.fields))
        if not last:
            got = materialise(got.select(*keep, F.struct(SPANS, ITEMS, MATCHES).alias(OWN + "was"), own), "block")
            held.destroy()
            if previous is not None:
                discard(previous)
            previous = got
    return got


def _searcher(held, keep: list[str], last: bool):
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in KINDS.names]
            was = batch.column(n)
            for chunk in chunks(batch.column(n + 1), SHARD_BYTES):
                n_words, n_hit, found = search(held.value, chunk)
                for row, (total, hit) in enumerate(zip(n_words.tolist(), n_hit.tolist())):
                    runs, items, matches = found.get(row, ([], [], []))
                    if was.null_count < len(was) and (before := was[chunk.lo + row].as_py())[SPANS]:
                        runs = united(runs + [[x["first"], x["last"]] for x in before[SPANS]])
                        items = sorted({*items, *before[ITEMS]})
                        matches = sorted(matches + [tuple(m.values()) for m in before[MATCHES]], key=in_order)
                        hit = sum(b - a + 1 for a, b in runs)
                    most = max((m[3] for m in matches), default=0)
                    spans = [{"first": a, "last": b} for a, b in runs]
                    for column, value in zip(out, (total, hit, most, spans, items, [dict(zip(("item_id", "at", "first", "words"), m)) for m in matches])):
                        column.append(value)
            arrays = [*batch.columns[:n], *(pa.array(c, f.type) for c, f in zip(out, KINDS))]
            names = [*keep, *KINDS.names]
            if not last:
                arrays, names = [*arrays, batch.column(n + 1)], [*names, OWN + "text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.select(
        "doc_id",
        F.col(N_WORDS).alias("n_words"),
        F.col(N_HIT).alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ITEMS, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col(N_HIT) > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH lower_of AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, lower_of),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, lower_of),
iw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS k FROM i WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit GROUP BY doc_id),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN places USING (doc_id)
"""
