"""Exact deduplication against a persistent digest index, with DataFrame functions only.

The index is a table in the shared folder, bucketed and sorted by digest. New
data is first reduced to one candidate a digest (partial aggregates, so a
group of copies never meets in one task as rows). A sort-merge anti-join with
the index, whose bucketed side isn't shuffled, tells the new digests, which
are appended; what the join drops is appended too, as later copies of digests
that are there, so that sizes count all rows. Even a first call adds its rows
in increments, the smaller ids first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import OWN, discard, materialise, new_path, one_of_repeated, table

#: Fixed value: the white space that does not count.
SPACES = " \t\n\x0b\x0c\r"
DIGEST, KEEP, LONG, SIZE, LENGTH, CALL, PART, NEW = (OWN + x for x in ("digest", "keep", "long", "size", "length", "call", "part", "new"))
#: Increments in which one call adds its rows.
INCREMENTS = 2


def digest(text: str | Column) -> Column:
    """SHA-256 of the text without white space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, "").cast("binary"), 256)


def code_points(text: str) -> Column:
    return F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")


class DigestIndex:
    """A persistent set of digests, bucketed and sorted by hash, for one writer at a time.

    path: a folder that all machines share; a new one by default. The same path
    opened later continues the index: the count of buckets is kept beside the
    table, and another one is refused. Each increment is one more file a bucket
    or two, so the sort order holds within a file. An increment counts only
    once a mark that it is complete has been written, so the files of one that
    failed are never read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or new_path(spark, "digests")
        self.marks = self.path + "/_marks"
        kept = next((int(m.split("-")[1]) for m in self._marks() if m.startswith("buckets-")), None)
        if kept and buckets and kept != buckets:
            raise ValueError(f"the index at {self.path} has {kept} buckets, not {buckets}")
        self.buckets = kept or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not kept:
            self._mark(f"buckets-{self.buckets}")
        self.call = 1 + max((call for call, _ in self._done()), default=-1)

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self) -> list[str]:
        where, files = self._files(self.marks)
        return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []

    def _mark(self, name: str) -> None:
        where, files = self._files(f"{self.marks}/{name}")
        files.create(where, False).close()

    def _done(self) -> list[tuple[int, int]]:
        return sorted(tuple(map(int, m.split("-")[1:])) for m in self._marks() if m.startswith("done-"))

    def _table(self) -> str:
        """The name in the catalogue, for as long as a plan is made."""
        name = OWN + "digests_" + uuid.uuid4().hex
        columns = f"{DIGEST} STRING, {KEEP} BIGINT, {LONG} BIGINT, {SIZE} BIGINT, {CALL} INT, {PART} INT, {NEW} BOOLEAN"
        self.spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return name

    def log(self) -> DataFrame:
        """A row for each increment and digest in it; NEW where the index didn't have it before. No shuffle is needed to group it by digest."""
        name = self._table()
        complete = F.struct(CALL, PART).isin([F.struct(F.lit(a).cast("int"), F.lit(b).cast("int")) for a, b in self._done()]) if self._done() else F.lit(False)
        rows = self.spark.table(name).filter(complete)
        rows.schema  # noqa: B018  resolves the plan, which then needs no name
        self.spark.sql(f"DROP TABLE `{name}`")
        return rows

    def read(self) -> DataFrame:
        """One row a digest: KEEP, the row that stays (of the call that first had the digest, the longest text, then the smallest id), LONG, its code points, SIZE, the rows of all calls, CALL, the first call."""
        best = F.max(F.struct((-F.col(CALL)).alias("c"), F.col(LONG).alias("n"), (-F.col(KEEP)).alias("k"))).alias("b")
        return self.log().groupBy(DIGEST).agg(best, F.sum(SIZE).alias(SIZE)).select(DIGEST, (-F.col("b.k")).alias(KEEP), F.col("b.n").alias(LONG), SIZE, (-F.col("b.c")).alias(CALL))

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One row a digest of rows (DIGEST, KEEP, LENGTH): those that the index doesn't have, by a sort-merge anti-join, and those that it has."""
        best = F.max(F.struct(F.col(LENGTH).alias("n"), (-F.col(KEEP)).alias("k"))).alias("b")
        found = rows.groupBy(DIGEST).agg(best, F.count(F.lit(1)).alias(SIZE)).select(DIGEST, (-F.col("b.k")).alias(KEEP), F.col("b.n").alias(LONG), SIZE)
        self.candidates = materialise(found, "candidates")
        found = self.candidates.repartition(self.buckets, DIGEST)
        if not self._done():
            return found, found.limit(0)
        known = self.log().filter(NEW).select(DIGEST).hint("merge")
        return found.join(known, DIGEST, "left_anti"), found.join(known, DIGEST, "left_semi")

    def add(self, rows: DataFrame) -> None:
        """Appends an increment: rows of DIGEST, KEEP (the id) and LENGTH (code points of the text)."""
        part = 1 + max((p for call, p in self._done() if call == self.call), default=-1)
        new, known = self.split(rows)
        columns = {CALL: F.lit(self.call).cast("int"), PART: F.lit(part).cast("int")}
        both = new.withColumns(columns | {NEW: F.lit(True)})
        if self._done():
            both = both.unionByName(known.withColumns(columns | {NEW: F.lit(False)}))
        name = self._table()
        try:
            both.write.bucketBy(self.buckets, DIGEST).sortBy(DIGEST).mode("append").option("path", self.path).saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE `{name}`")
        discard(self.candidates)
        self._mark(f"done-{self.call}-{part}")

    def assign(self, rows: DataFrame) -> DataFrame:
        """rows, which have DIGEST, with KEEP, LONG, SIZE and CALL of the index.

        Both sides are shuffled (the index by an expression of its digest), so
        that Spark can split the partition of a digest that very many rows share.
        """
        index = self.read().select(F.concat(F.col(DIGEST), F.lit("")).alias(DIGEST), KEEP, LONG, SIZE, CALL)
        return rows.join(index, DIGEST, "left")


def digests(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias(KEEP), digest(text).alias(DIGEST), code_points(text).alias(LENGTH))


def indexed(rows: DataFrame, path: str | None = None, increments: int = INCREMENTS) -> DigestIndex:
    """An index to which the rows of digests() have been added, in increments of about as many, the smaller ids first (rows without an id in the first)."""
    index = DigestIndex(rows.sparkSession, path)
    cuts = rows.agg(F.percentile_approx(KEEP, [k / increments for k in range(1, increments)] or [0.5], 1000).alias("q")).first()["q"] or []
    bounds = [None, *dict.fromkeys(cuts[: increments - 1]), None]
    for low, high in zip(bounds, bounds[1:]):
        above = F.lit(True) if low is None else F.col(KEEP) > low
        below = F.lit(True) if high is None else F.col(KEEP) <= high
        index.add(rows.filter((above & below) | F.col(KEEP).isNull() if low is None else above & below))
    return index


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default, doc_id among them) with DIGEST, KEEP (the id that stays), SIZE (of the group) and OWN + "kept".

    Null text counts as empty; all empty texts are one group. A null id is
    kept last (any other id of its group wins among equally long texts); a
    group of null ids only has KEEP null. Rows that repeat both the id that
    stays and a text as long as its are all marked as kept; keep_first()
    leaves one of them. With the path of an index that earlier calls made, a
    text that it had before is kept in no row of docs, KEEP is the id kept
    then, and SIZE counts the rows of all calls. An empty table gives no rows.
    Other columns are passed on as they are.
    """
    rows = materialise(digests(docs, text, doc_id), "digests")
    index = indexed(rows, path)
    keep = docs.columns if keep is None else keep
    if keep == [doc_id]:
        got = index.assign(rows.withColumn(doc_id, F.col(KEEP)).drop(KEEP))
    else:
        discard(rows)
        got = index.assign(docs.withColumns({DIGEST: digest(text), LENGTH: code_points(text)}).select(*keep, DIGEST, LENGTH))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(KEEP)) & (F.col(LENGTH) == F.col(LONG)) & (F.col(CALL) == index.call)
    return got.withColumn(OWN + "kept", same)


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """docs with one row of each group of equal texts, none of a group that the index at path had before; the columns of docs.

    Of rows that repeat both the id and the text one stays; which one's other
    columns are kept is not defined.
    """
    left = exact_dedup(docs, text, doc_id, path).filter(F.col(OWN + "kept"))
    return one_of_repeated(left, docs, doc_id, digest(text), DIGEST).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return got.select(
        "doc_id",
        F.col(KEEP).alias("keep_id"),
        F.col(SIZE).alias("group_size"),
        F.col(OWN + "kept").alias("kept"),
        F.col(DIGEST).alias("text_sha256"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
