"""Shared storage and the helpers that every operator of this package uses."""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path as new_path

#: Names for columns that operators add while they work; inputs may not use this prefix.
OWN = "__rl_"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back.

    It cuts the lineage at a place that survives lost executors. Columns of
    the result have the types of df. The shuffle files of what has been
    written are no longer needed, so Spark's cleaner is told to look for them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    schema = df.schema
    del df
    forget(spark)
    out = spark.read.schema(schema).parquet(path)
    out._recordloom_path = path
    return out


def forget(spark: SparkSession) -> None:
    """Lets the cleaner drop shuffle files whose plans nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes the files of what materialise() gave, once nothing that is still to run reads them."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._recordloom_path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def one_of_repeated(left: DataFrame, docs: DataFrame, doc_id: str, key: Column, name: str) -> DataFrame:
    """left, some rows of docs with key in the column `name`, with one row of those that repeat both id and key.

    Repeated rows are found by counts over docs, and only they are dealt out
    anew. A null id equals another.
    """
    again = docs.select(F.col(doc_id).cast("string").alias(OWN + "id"), key.alias(OWN + "key")).groupBy(OWN + "id", OWN + "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    again = materialise(again, "repeated")
    if again.isEmpty():
        return left
    same = F.col(doc_id).cast("string").eqNullSafe(F.col(OWN + "id")) & (F.col(name) == F.col(OWN + "key"))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([doc_id, name]))


#: Partial tables that one group adds up at most, in the first two of three steps; the last has a table for FAN * FAN tasks.
FAN = 64


def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in as few bytes each as the largest needs: that width, and the bytes."""
    most = int(np.abs(values).max(initial=0))
    width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
    return width, values.astype(f"i{width}").tobytes()


def partial_sums(keys: dict[str, list], parts: list[np.ndarray]) -> pa.RecordBatch:
    """A task's share of tables of sums: rows for summed(), each with its keys."""
    width, sums = zip(*map(narrow, parts))
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in keys.items()} | {"task": pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()), "width": pa.array(width, pa.int32()), "sums": pa.array(sums, pa.binary())})


def summed(shares: DataFrame, keys: list[str]) -> DataFrame:
    """The shares of all tasks (keys, task, width, sums) added up by keys, in three steps, so that no group has many of them."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, f"i{w}").astype(np.int64) for w, x in zip(pdf["width"], pdf["sums"]))
        width, sums = narrow(total)
        return pdf.head(1).assign(width=width, sums=[sums]).astype({"width": np.int32})

    for share in (FAN, FAN, None):
        group = F.lit(0) if share is None else (F.col("task") / share).cast("int")
        shares = shares.withColumn("task", group)
        shares = shares.groupBy(*keys, "task").applyInPandas(add, shares.schema)
    return shares.drop("task")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int = 5):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
