"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Documents with equal shingle sets are one node. Nodes that share a band are
candidates. Within a band bucket, members are compared with a pivot, the most
central one, rather than with each other; what the links so found join needs
no further comparison. Buckets that still hold several groups get pivots from
outside their largest group, twice as many in each round, for as long as these
join groups. What is left are texts that resemble each other without being
linked. Wider bands, whose rows are many registers, divide these into
families, and in each family the pairs of different groups are found in the
one of two ways that meets fewer of them: over the shingles that are rarest in
the family, of which two linked sets must share one among their first few
(exact), or over the wide bands. So no link between different groups is lost,
and a large bucket never emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import OWN, discard, materialise, one_of_repeated, table
from .textkit import NOT_SPACE, U64, Chunk, Sequences, chunks, mix, ranges, tidy, words

#: Registers of a signature; the most that banding may miss of the pairs just at the threshold, and again that wide bands may.
REGISTERS, MISSED = 120, 1e-6
SHINGLE, SIMILAR = 5, (80, 100)
#: Signatures, each of elements hashed anew, that wide bands are cut from.
WIDE = 20
#: The share of the groups in mixed buckets that a round of pivots must join at least for another round.
JOINED = 0.1
#: Classes of set sizes for each factor that two linked sets' sizes may differ by.
CLASSES = 4
SKETCH_BYTES = 1 << 20
_FRACTION = U64(40)


def rows_in_band(similar: tuple[int, int], signatures: int = 1) -> int:
    """The most registers a band, a divisor of REGISTERS, with which at most MISSED of the pairs at the threshold share no band of the signatures."""
    t = similar[0] / similar[1]
    return max([r for r in range(1, REGISTERS + 1) if REGISTERS % r == 0 and (1 - t**r) ** (REGISTERS // r * signatures) <= MISSED], default=1)


def shingles(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another, and where each row's begin.

    A row with fewer words than a shingle has one shingle of all its words; a row without words none.
    """
    w = words(chunk, NOT_SPACE, lower=True)
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    start = ranges(w.first[:-1], count)
    hashes = Sequences(w.hash).of(start, np.repeat(np.minimum(n, size), count))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    distinct = np.ones(len(hashes), bool)
    distinct[1:] = hashes[1:] != hashes[:-1]
    distinct[first[:-1][count > 0]] = True
    kept = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(distinct, out=kept[1:])
    return hashes[distinct], kept[first]


def superminhash(values: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """A SuperMinHash signature of each row's set of values.

    In step j every element offers j + r, r random in [0, 1), to the j-th
    register of its own random permutation. Once the largest register of a
    row is less than j + 1, later steps can't change the row, and it drops
    out; so most elements take part in one or two steps. The permutation is
    Fisher-Yates'; only its swaps are stored, and a register is found by
    tracing them back.
    """
    rows = len(first) - 1
    table_ = np.full(rows * registers, np.iinfo(np.uint64).max, U64)
    row = np.repeat(np.arange(rows), np.diff(first))
    swaps: list[np.ndarray] = []
    for j in range(registers):
        if not len(values):
            break
        x = mix(values ^ mix(np.array([j + 1], U64)))
        swap = (j + (((x & U64(0xFFFFFF)) * U64(registers - j)) >> U64(24)).astype(np.int64)).astype(np.int16)
        register = swap.copy()
        for t in range(j - 1, -1, -1):
            was = swaps[t]
            at_t, at_was = register == t, register == was
            register[at_was] = t
            register[at_t] = was[at_t]
        np.minimum.at(table_, row * registers + register, (U64(j) << _FRACTION) | (x >> U64(24)))
        swaps.append(swap)
        open_ = table_.reshape(rows, registers).max(1, initial=0) >= U64(j + 1) << _FRACTION
        alive = open_[row]
        if not alive.all():
            values, row = values[alive], row[alive]
            swaps = [s[alive] for s in swaps]
    return table_.reshape(rows, registers)


def bands_of(signature: np.ndarray, in_band: int, salt: int = 0) -> np.ndarray:
    """A hash of each band of each row of the signature."""
    parts = signature.reshape(len(signature), -1, in_band)
    band = np.broadcast_to(mix(np.arange(1, parts.shape[1] + 1, dtype=U64) + U64(salt << 32)), parts.shape[:2])
    for k in range(in_band):
        band = mix(band ^ parts[:, :, k])
    return band


def lists_of(values: np.ndarray) -> pa.Array:
    """Rows of longs as an array column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel().view(np.int64)))


def sketch(docs: DataFrame, text: str, doc_id: str, size: int, in_band: int) -> DataFrame:
    """node (the id), key (of the text), n, set (a 128-bit digest of the shingle set) and bands of every row."""
    schema = "node long, key long, n long, set binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), SKETCH_BYTES):
                values, first = shingles(chunk, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                digest = np.zeros((len(n), 2), U64)
                if len(full):
                    with np.errstate(over="ignore"):
                        for k, salt in enumerate((0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)):
                            digest[full, k] = np.add.reduceat(mix(values ^ U64(salt)), first[full])
                band = np.where((n > 0)[:, None], bands_of(superminhash(values, first), in_band), U64(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.lo, len(n)),
                        batch.column(1).slice(chunk.lo, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array([d.tobytes() if k else None for d, k in zip(digest, n)], pa.binary()),
                        lists_of(band),
                    ],
                    names=["node", "key", "n", "set", "bands"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), schema)


def verify(pairs: DataFrame, texts: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts has node and text."""
    least, of = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, good = batch.column(0), batch.column(1), []
            for lo in range(0, len(batch), 64):
                sides = []
                for column in (2, 3):
                    sets: list[np.ndarray] = []
                    for chunk in chunks(batch.column(column).slice(lo, 64)):
                        values, first = shingles(chunk, size)
                        sets += [values[x:y] for x, y in zip(first[:-1], first[1:])]
                    sides.append(sets)
                for x, y in zip(*sides):
                    if len(x) > len(y):
                        x, y = y, x
                    if not len(x):
                        good.append(False)
                        continue
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both = int((y[at] == x).sum())
                    good.append(of * both >= least * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    joined = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long").distinct()


def wide_bands(data: DataFrame, size: int, in_band: int) -> DataFrame:
    """node, key, n, group and band of each row of data (node, key, n, group, text) and wide band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(4), SKETCH_BYTES):
                values, first = shingles(chunk, size)
                own = [c.slice(chunk.lo, chunk.hi - chunk.lo) for c in batch.columns[:4]]
                for k in range(WIDE):
                    bands = bands_of(superminhash(mix(values ^ mix(np.array([k], U64) + U64(1 << 40))), first), in_band, k + 1)
                    yield pa.RecordBatch.from_arrays([*own, lists_of(bands)], names=["node", "key", "n", "group", "bands"])

    lists = data.select("node", "key", "n", "group", "text").mapInArrow(tidy(run), "node long, key long, n long, group long, bands array<long>")
    return lists.select("node", "key", "n", "group", F.explode("bands").alias("band"))


def spread(data: DataFrame, size: int) -> DataFrame:
    """A row for each shingle of each row of data (family, node, key, n, group, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(5), SKETCH_BYTES):
                values, first = shingles(chunk, size)
                row = np.repeat(np.arange(chunk.lo, chunk.hi), np.diff(first))
                own = [np.asarray(c) for c in batch.columns[:5]]
                for lo in range(0, len(values), 50_000):
                    part = slice(lo, lo + 50_000)
                    columns = [pa.array(values[part].view(np.int64)), *(pa.array(c[row[part]]) for c in own)]
                    yield pa.RecordBatch.from_arrays(columns, names=["shingle", "family", "node", "key", "n", "group"])

    return data.select("family", "node", "key", "n", "group", "text").mapInArrow(tidy(run), "shingle long, family long, node long, key long, n long, group long")


def class_base(similar: tuple[int, int]) -> float:
    """The factor from a size class to the next."""
    return max(similar[1] / similar[0], 1.01) ** (1 / CLASSES)


def size_class(n: Column, similar: tuple[int, int]) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(class_base(similar))))


def prefixes(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Of the rows of spread(), the rarest shingles of each set that occur in several groups of its family, with their place `at` in the set.

    Shingles that occur in one group only come first in a set (their number is
    known, so they need no row), then the others, the rarest of the family
    first. Two sets that are linked have a common shingle among the first
    n - least / of * n + 1 of each.
    """
    least, of = similar
    across = rows.groupBy("family", "shingle").agg(F.min("group").alias("x"), F.max("group").alias("y"), F.count(F.lit(1)).alias("df")).filter("x <> y")
    common = rows.join(across.select("family", "shingle", "df"), ["family", "shingle"])
    own = Window.partitionBy("node", "key")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "shingle")) - 1
    return common.withColumn("at", place).filter(F.col("n") * least <= (F.col("n") - F.col("at")) * of).drop("df")


def meetings(prefix: DataFrame, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Rows of prefixes() to join on family, shingle and size class: of the smaller sets (in their class), and of the larger ones (in each class that a smaller one may have).

    Of n + m shingles in two linked sets, least / (least + of) are common.
    After the first common one, at place i and j, min(n - i, m - j) can be at
    most, so a shingle too far behind for even the smallest partner is left out.
    """
    least, of = similar
    n, after = F.col("n"), F.col("n") - F.col("at")
    smaller = prefix.filter(after * (least + of) >= n * 2 * least).withColumn("class", size_class(n, similar))
    lowest = F.ceil(n * least / of)
    larger = prefix.withColumn("class", F.explode(F.sequence(size_class(lowest, similar), size_class(n, similar))))
    low = F.greatest(lowest, F.floor(F.pow(F.lit(class_base(similar)), F.col("class"))) - 1)
    return smaller, larger.filter(after * (least + of) >= (n + low) * least)


def over_prefixes(smaller: DataFrame, larger: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different groups that may be linked, of what meetings() gives."""
    least, of = similar
    x = smaller.select("family", "shingle", "class", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("group").alias("xg"), (F.col("n") - F.col("at")).alias("xa"))
    y = larger.select("family", "shingle", "class", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("group").alias("yg"), (F.col("n") - F.col("at")).alias("ya"))
    on = [F.col("l." + c) == F.col("r." + c) for c in ("family", "shingle", "class")]
    order = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("x") < F.col("y")))
    enough = (F.least("xa", "ya") * (least + of) >= (F.col("xn") + F.col("yn")) * least) & (F.col("xn") * of >= F.col("yn") * least)
    met = x.alias("l").join(y.alias("r"), [*on, F.col("xg") != F.col("yg"), order, enough])
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def over_bands(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different groups that share a wide band; rows has band, node, n and group."""
    least, of = similar
    x = rows.select("band", F.col("node").alias("a"), F.col("n").alias("xn"), F.col("group").alias("xg"))
    y = rows.select(F.col("band").alias("other"), F.col("node").alias("b"), F.col("n").alias("yn"), F.col("group").alias("yg"))
    close = F.least("xn", "yn") * of >= F.greatest("xn", "yn") * least
    return x.join(y, [F.col("band") == F.col("other"), F.col("a") < F.col("b"), F.col("xg") != F.col("yg"), close]).select("a", "b")


def remaining(live: DataFrame, texts: DataFrame, size: int, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame] | None:
    """Pairs (a, b) of different groups that may be linked, and family, prefix and band: how many pairs the ways meet in each family.

    live has node, key, n and group; texts node, key and text. A family is a
    component of the wide bands that several groups share. None if there is none.
    """
    units = materialise(live.select("node", "key", "n", "group").distinct(), "units")
    rows = materialise(wide_bands(texts.join(units, ["node", "key"]), size, rows_in_band(similar, WIDE)), "wide")
    shared = rows.groupBy("band").agg(F.min("group").alias("x"), F.max("group").alias("y"), F.min("node").alias("first"), F.count(F.lit(1)).alias("c")).filter("x <> y")
    buckets = materialise(rows.join(shared.select("band", "first", "c"), "band"), "wide_buckets")
    discard(rows)
    if buckets.isEmpty():
        return None
    families = components(buckets.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "family")
    buckets = buckets.join(families, "node")
    all_shingles = materialise(spread(texts.join(units, ["node", "key"]).join(families, "node"), size), "spread")
    prefix = materialise(prefixes(all_shingles, similar), "prefix")
    discard(all_shingles)
    smaller, larger = meetings(prefix, similar)
    key = ["family", "shingle", "class"]
    met = smaller.groupBy(key).agg(F.count(F.lit(1)).alias("s")).join(larger.groupBy(key).agg(F.count(F.lit(1)).alias("l")), key)
    by_prefix = met.groupBy("family").agg(F.sum(F.col("s") * F.col("l")).alias("prefix"))
    by_band = buckets.groupBy("family").agg(F.sum("c").alias("band"))
    costs = materialise(by_band.join(by_prefix, "family", "left").select("family", F.coalesce("prefix", F.lit(0)).alias("prefix"), "band"), "costs")
    cheaper = costs.filter("band < prefix").select("family")
    pairs = over_prefixes(*(x.join(cheaper, "family", "left_anti") for x in (smaller, larger)), similar)
    return pairs.unionByName(over_bands(buckets.join(cheaper, "family", "left_semi"), similar)).distinct(), costs


def mixed(live: DataFrame) -> DataFrame:
    """The rows of live (band, node, n, group) whose bucket has several groups."""
    several = live.groupBy("band").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y").select("band")
    return live.join(several, "band")


def pivots_of(live: DataFrame, step: int) -> DataFrame:
    """band, pivot, pn and pc (the pivot's n and group): the most central member in step 0, the most central outside its group in step 1, then 2, 4, 8 members outside, more or less."""
    pivot = (F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("group").alias("pc"))
    best = F.struct("central", F.xxhash64("node").alias("o"), *pivot)
    top = live.groupBy("band").agg(F.max(best).alias("p")).select("band", "p.pivot", "p.pn", "p.pc")
    if step == 0:
        return top
    outside = live.join(top.select("band", F.col("pc").alias("top")), "band").filter("group <> top").drop("top")
    if step == 1:
        return outside.groupBy("band").agg(F.max(best).alias("p")).select("band", "p.pivot", "p.pn", "p.pc")
    count = outside.groupBy("band").agg(F.count(F.lit(1)).alias("c"))
    return outside.join(count, "band").filter(F.pmod(F.xxhash64(F.lit(step), "node", "band"), "c") < 1 << (step - 1)).select("band", *pivot)


def link(members: DataFrame, docs: DataFrame, text: str, doc_id: str, size: int, similar: tuple[int, int], repeated: bool = False) -> DataFrame | None:
    """node and component of the members (node, key, n, bands) that similar ones are linked with; None if no band is shared. repeated: docs has rows with the same id and text."""
    least, of = similar
    rows = members.select("node", "n", "key", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    buckets = materialise(rows.join(sizes, "band"), "buckets")
    if buckets.isEmpty():
        return None
    wanted = buckets.select("node", "key").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    texts = texts.join(wanted, ["node", "key"]).select("node", "key", "text")
    texts = materialise(texts.dropDuplicates(["node", "key"]) if repeated else texts, "texts")
    # what most others resemble meets most of them in its buckets
    central = buckets.groupBy("node").agg(F.sum("c").alias("central"))
    live = buckets.select("band", "node", "key", "n", F.col("node").alias("group")).join(central, "node")
    close = F.least("n", "pn") * of >= F.greatest("n", "pn") * least
    tested = groups = None
    temporary = [buckets, texts]

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the pairs that have not been compared before; they count as compared from now on."""
        nonlocal tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = materialise(verify(pairs, texts, size, similar), "links")
        temporary.extend((pairs, links))
        return links

    def joined(links: DataFrame) -> DataFrame:
        edges = links if groups is None else links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return components(edges)

    step = 0
    while True:
        met = live.join(pivots_of(live, step).withColumnRenamed("band", "pband"), (F.col("band") == F.col("pband")) & (F.col("group") != F.col("pc")) & close)
        links = verified(met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
        groups = joined(links)
        now = materialise(live.drop("group").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "now")
        count = F.count_distinct("group").alias("n")
        before, after = live.agg(count).first()["n"], now.agg(count).first()["n"]
        live = materialise(mixed(now), "live")
        discard(now)
        temporary.append(live)
        if live.isEmpty():
            discard(*temporary)
            return groups
        if after > before * (1 - JOINED):
            break
        step += 1
    found = remaining(live, texts, size, similar)
    if found is not None:
        groups = joined(verified(found[0]))
    discard(*temporary)
    return groups


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """node (the id), key (of the text), n (its distinct shingles) and component of every row.

    Words are what ASCII white space separates, ASCII letters lowered; two
    rows are linked if `similar` (a fraction, as two ints) of the union of
    their shingle sets is common. Null and empty texts, and texts without
    words, have no shingles and are linked with nothing: their component is
    their own id. A row without an id gets the component of its equals, or
    null, and links nothing. Rows that repeat an id are one node. An empty
    table gives no rows. Of the pairs just at the threshold, bands miss at most
    MISSED, and wide bands, through which only texts go that pivots left in
    mixed buckets, at most MISSED again; of more similar ones less. Every link
    is confirmed on the full sets.
    """
    rows = materialise(sketch(docs, text, doc_id, size, rows_in_band(similar)), "sketch")
    members = rows.filter("n > 0 and node is not null").groupBy("set").agg(F.min(F.struct("node", "key", "n", "bands")).alias("m")).select("set", "m.*")
    members = materialise(members, "members")
    repeated = not rows.groupBy("node", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    groups = link(members, docs, text, doc_id, size, similar, repeated)
    if groups is None:
        nodes = members.select("set", F.col("node").alias("component"))
    else:
        nodes = members.join(groups, "node", "left").select("set", F.coalesce("component", "node").alias("component"))
    return rows.select("node", "key", "n", "set").join(nodes, "set", "left").select("node", "key", "n", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs with one document of each group, that with the smallest id; the columns of docs.

    Of rows that repeat both id and text one stays; which one's other columns
    are kept is not defined. Rows without an id stay, unless the shingles of a row
    with an id are the same.
    """
    got = near_dedup(docs, text, doc_id, size, similar)
    gone = got.filter("node <> component").select(F.col("node").alias(OWN + "node")).distinct()
    left = docs.join(gone, F.col(doc_id).cast("long") == F.col(OWN + "node"), "left_anti")
    nameless = got.filter("node is null and component is not null").select(F.col("key").alias(OWN + "key")).distinct()
    if not nameless.isEmpty():
        left = left.join(nameless, F.col(doc_id).isNull() & (F.xxhash64(text) == F.col(OWN + "key")), "left_anti")
    return one_of_repeated(left.withColumn(OWN + "text", F.xxhash64(text)), docs, doc_id, F.xxhash64(text), OWN + "text").select(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, similar=(85, 100))
    return got.select(
        F.col("node").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        (F.col("node") == F.col("component")).alias("kept"),
    )


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + least(3, len(ws)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 0) + 2)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, low) AS (
  SELECT a, a FROM ways UNION SELECT ways.b, reach.low FROM reach JOIN ways ON reach.node = ways.a WHERE reach.low < ways.b),
lowest AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low, w.doc_id) AS component_id, coalesce(low, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN lowest ON node = w.doc_id
"""
