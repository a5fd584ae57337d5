"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte pieces. Every adjacent pair that the
vocabulary can merge sits in the bucket of its merge rank; a bitmap over the
ranks (words of 64 ranks, words of 64 words, and so on) gives the lowest
non-empty bucket by a find-first-set a level. Entries that a later merge made
stale are recognised by the pair that they were made for and skipped. A
pre-token of n bytes so takes O(n) merges of constant queue cost (plus the
heap order of a bucket), however long it is.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import OWN, table
from .textkit import chunks, tidy

#: Pre-tokens (and parts between spaces) after which a worker begins a new generation of what it remembers, and their characters together; it keeps the one before.
CACHE, CACHE_CHARS = 250_000, 16 << 20
#: Bytes of text that are encoded at once.
PART_BYTES = 2 << 20
#: Places of a bucket that are merged with numpy at least.
LEAST_AT_ONCE = 12
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Patterns of which it is known that a space before a character that is none begins a pre-token.
CUT_AT_SPACES = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)


#: The ids of a part of a text with commas, how many there are, and the bytes that they decode to.
Encoded = tuple[str, int, bytes]


class Remembered:
    """Texts and what they are encoded to: those of late, and those of the generation before."""

    def __init__(self):
        self.recent: dict[str, Encoded] = {}
        self.before: dict[str, Encoded] = {}

    def missing(self, texts: set[str]) -> set[str]:
        """Those of the texts that are not known; the others are of late now."""
        texts = texts - self.recent.keys()
        again = texts & self.before.keys()
        self.recent.update({t: self.before[t] for t in again})
        return texts - again

    def age(self) -> None:
        """Begins a new generation once this one is large."""
        if len(self.recent) > CACHE or sum(map(len, self.recent)) > CACHE_CHARS:
            self.recent, self.before = {}, self.recent


class Codec:
    """One vocabulary of ranks and one pattern of pre-tokens."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.texts = {rank: str(rank) for rank in self.pieces}
        self.find = regex.compile(pattern).findall
        #: A space before a character that is none always begins a pre-token, so what such spaces separate can be encoded by itself.
        self.odd_space, self.cut = regex.compile(r" (?!\S)").search, regex.compile(r" (?=\S)").split
        self.alone = pattern in CUT_AT_SPACES
        self.low = [0] * ((max(self.pieces) >> 8) + 1)
        self.known, self.units = Remembered(), Remembered()

    @functools.cached_property
    def bytes_(self) -> np.ndarray:
        """The rank of each byte."""
        return np.array([self.ranks.get(bytes([k]), -1) for k in range(256)], np.int64)

    @functools.cached_property
    def pairs(self) -> np.ndarray:
        """The rank of each pair of bytes, -1 for those that are no piece."""
        out = np.full(1 << 16, -1, np.int64)
        for piece, rank in self.ranks.items():
            if len(piece) == 2:
                out[piece[0] << 8 | piece[1]] = rank
        return out

    @functools.cached_property
    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of pieces that make a piece: left and right rank as one number, in order, and the rank of the whole."""
        get, found = self.ranks.get, []
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)):
                if (left := get(piece[:k])) is not None and (right := get(piece[k:])) is not None:
                    found.append((left << 32 | right, rank))
        found.sort()
        return np.array([x for x, _ in found] + [1 << 62], np.int64), np.array([x for _, x in found] + [-1], np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ranks; -1 where they make no piece."""
        keys, ranks = self.halves
        key = left << 32 | right
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: that of the whole piece if it has one, or else by merging pairs of lowest rank, leftmost first.

        All pre-tokens lie in one byte string, a byte that starts no piece
        after each, and share one queue. The queue is a bitmap of two levels:
        `low` has a bit a rank in words of 256 ranks, `top` a bit a word. A
        bucket has the positions at which a pair of its rank starts. When a
        merge makes a pair of no higher rank in a pre-token, what is left of
        the bucket for that pre-token waits until that pair has been merged.
        Large buckets, which come first, are merged with numpy.
        """
        get = self.ranks.get
        out = [[whole] if (whole := get(p)) is not None else [] for p in pieces]
        left = [p for p, o in zip(pieces, out) if not o and p]
        whole = b"".join([p + b"\0" for p in left])
        n, low, top = len(whole), self.low, 0
        sizes = np.array([len(p) + 1 for p in left], np.int64)
        stops = np.cumsum(sizes) - 1
        data = np.frombuffer(whole, np.uint8).astype(np.int64)
        #: A piece starts at i and ends at end[i]; before[i] is where the one before it starts. end[i] is 0 where none starts.
        end, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        end[stops] = 0
        before[stops + 1 - sizes] = -1
        #: The piece that starts at i, and the rank of the pair of which it is the first; -1 where there is none.
        piece, pair = self.bytes_[data], np.full(n, -1, np.int64)
        pair[: max(0, n - 1)] = self.pairs[data[:-1] << 8 | data[1:]]
        pair[stops] = pair[stops - 1] = -1
        buckets: dict[int, list] = {}

        def put(places: np.ndarray) -> None:
            """Places into the buckets of their pairs."""
            nonlocal top
            order = np.argsort(pair[places], kind="stable")
            places = places[order][np.searchsorted(pair[places][order], 0) :]
            found, begin = np.unique(pair[places], return_index=True)
            for rank, own in zip(found.tolist(), np.split(places, begin[1:])) if len(found) else ():
                if rank in buckets:
                    buckets[rank].append(own)
                else:
                    buckets[rank] = [own]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)

        put(np.arange(n))
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            at = np.unique(np.concatenate(buckets[rank]))
            if len(at) < LEAST_AT_ONCE:
                break
            at = at[pair[at] == rank]
            middle = end[at]
            # of pairs that overlap, every second goes, from the left
            k = np.arange(len(at))
            begins = np.ones(len(at), bool)
            begins[1:] = at[1:] != middle[:-1]
            at = at[(k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0]
            middle = end[at]
            last, back = end[middle], before[at]
            back[1:] = np.where(at[1:] == last[:-1], at[:-1], back[1:])
            follows, leads = end[last] > 0, back >= 0
            # a pair of no higher rank, even one that the next merge would undo, must come before the rest of the bucket
            was = self.of_pairs(np.full(len(at), rank), np.where(follows, piece[last], -1))
            old = piece[at]
            piece[at] = rank
            right = np.where(follows, self.of_pairs(np.full(len(at), rank), piece[last]), -1)
            behind = np.where(leads, self.of_pairs(piece[back], np.full(len(at), rank)), -1)
            fresh = np.concatenate([was[follows], right, behind])
            if ((fresh >= 0) & (fresh <= rank)).any():
                piece[at] = old
                break
            low[word] = bits & (bits - 1)
            if not low[word]:
                top &= top - 1
            del buckets[rank]
            end[at], end[middle], pair[middle] = last, 0, -1
            before[last[follows]] = at[follows]
            pair[at] = right
            pair[back[leads]] = behind[leads]
            put(np.unique(np.concatenate([at, back[leads]])))
        end, before, piece, pair, stop = end.tolist(), before.tolist(), piece.tolist(), pair.tolist(), np.repeat(stops, sizes).tolist()
        buckets = {rank: np.concatenate(own).tolist() for rank, own in buckets.items()}
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            wait = 0
            for i in bucket:
                if pair[i] != rank:
                    continue  # stale: a piece no longer starts here, is the last, or has grown since
                if i < wait:
                    places = (i,)
                else:
                    middle = end[i]
                    end[i] = last = end[middle]
                    end[middle], pair[middle], piece[i] = 0, -1, rank
                    j = before[i]
                    if after := end[last]:
                        before[last] = i
                        pair[i] = get(whole[i:after], -1)
                    else:
                        pair[i] = -1
                    if j >= 0:
                        pair[j] = get(whole[j:last], -1)
                        places = (i, j)
                    else:
                        places = (i,)
                for j in places:
                    if (new := pair[j]) >= 0:
                        if new in buckets:
                            buckets[new].append(j)
                        else:
                            buckets[new] = [j]
                            low[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                        if new <= rank:
                            wait = stop[i]
        starts = np.flatnonzero(np.array(end, np.int64))
        ids, cuts = np.array(piece, np.int64)[starts].tolist(), np.searchsorted(starts, stops).tolist()
        begin, k = 0, 0
        for o, p in zip(out, pieces):
            if not o and p:
                o += ids[begin : cuts[k]]
                begin, k = cuts[k], k + 1
        return out

    def forget(self) -> None:
        """Workers live on after a task; what they remember should not."""
        self.known, self.units = Remembered(), Remembered()

    def learn(self, names: set[str]) -> None:
        """Encodes parts of texts, named as in encoded(), that begin and end where pre-tokens do, and decodes their ids."""
        # a space and letters are one pre-token
        plain = {k: " " + k for k in names if k.isalpha()} if self.alone else {}
        split = {k: self.find(k[1:] if k[0] == " " else " " + k) for k in names - plain.keys()}
        new = list(self.known.missing({w for found in split.values() for w in found}.union(plain.values())))
        known, text, piece = self.known.recent, self.texts.__getitem__, self.pieces.__getitem__
        for word, ids in zip(new, self.merge([w.encode() for w in new])):
            known[word] = ",".join(map(text, ids)), len(ids), b"".join(map(piece, ids))
        recent = self.units.recent
        recent.update({k: known[w] for k, w in plain.items()})
        for name, found in split.items():
            if len(found) == 1:
                recent[name] = known[found[0]]
            else:
                ids, counts, decoded = zip(*[known[w] for w in found])
                recent[name] = ",".join(ids), sum(counts), b"".join(decoded)
        self.known.age()

    def encoded(self, texts: list[str]) -> list[Encoded]:
        """What each whole text is encoded to.

        A text is cut at spaces where a pre-token must begin. The parts are
        named without their space; the first, which has none, with one.
        """
        parts = []
        for text in texts:
            if self.alone:
                found = self.cut(text) if self.odd_space(text) else text.split(" ")
                found[0] = " " + found[0]
            else:
                found = [" " + text]
            parts.append(found if found[0] != " " else found[1:])
        if new := self.units.missing(set().union(*parts)):
            self.learn(new)
        units, out = self.units.recent, []
        for found in parts:
            ids, counts, decoded = zip(*[units[u] for u in found]) if found else ((), (), ())
            out.append((",".join(ids), sum(counts), b"".join(decoded)))
        self.units.age()
        return out

    def joined(self, texts: list[str]) -> list[str]:
        """The ids of each whole text as text with commas."""
        return [ids for ids, _, _ in self.encoded(texts)]

    def encode(self, text: str) -> list[int]:
        got = self.joined([text])[0]
        return [int(x) for x in got.split(",")] if got else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def read_vocabulary(path: str) -> bytes:
    """The lines of a vocabulary file (a piece in base64 and its rank) on the driver's machine."""
    with open(path, "rb") as file:
        return file.read()


def shared_vocabulary(spark: SparkSession, path: str):
    """A vocabulary file of the driver's machine for all executors; its size is that of the file, about a megabyte."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with the ids of every whole text in OWN + "ids" (an array of ints; empty for null and empty texts)."""
    name = OWN + "ids"
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(None).cast("array<int>")).schema
    held = shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        for batch in batches:
            ids = [c.encode(t.as_py() or "") for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, name])
        c.forget()

    return kept.mapInArrow(tidy(run), schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = OWN + "ids") -> DataFrame:
    """docs with the bytes of the ids in OWN + "bytes"; null for null."""
    name = OWN + "bytes"
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(None).cast("binary")).schema
    held = shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        for batch in batches:
            out = [None if x is None else c.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, name])

    return kept.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids of every row: encoded, decoded again from the ids, and digested in one pass.

    A null text counts as empty (no ids; digests of nothing). Rows are
    independent, so repeated rows, null ids, ties and other columns have no
    effect; an empty table gives no rows.
    """
    held = shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            # a batch of results for each part, so that neither side holds the ids of a whole batch of texts
            for chunk in chunks(batch.column(1), PART_BYTES):
                counts, ids_sha, decoded_sha, all_ids = [], [], [], []
                for ids, count, decoded in c.encoded([chunk.text(i).decode() for i in range(chunk.hi - chunk.lo)]):
                    counts.append(count)
                    if with_ids:
                        all_ids.append(pa.array(ids.split(",") if ids else [], pa.string()).cast(pa.int32()))
                    ids_sha.append(sha(ids.encode()).hexdigest())
                    decoded_sha.append(sha(decoded).hexdigest())
                columns = [batch.column(0).slice(chunk.lo, len(counts)), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                if with_ids:
                    offsets = pa.array([0, *itertools.accumulate(counts)], pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays([pa.array([], pa.int32()), *all_ids])))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        c.forget()

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [c.split(" ")[0] for c in shape.split(", ")]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(tidy(run), shape)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
