"""A corpus pipeline of five operators: language identification, exact and near deduplication, decontamination, tokenising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, decontaminate, exact_dedup, language_id, minhash
from recordloom.llm.shared import crc_mod, materialise, table

#: The least posterior probability of the predicted language.
SURE = 0.5
#: No SQL can express the stages; tests hold each against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty; those without letters go. Learned from their own lang column."""
    columns = docs.columns
    model = language_id.fit(docs.filter(crc_mod("doc_id") != 0))
    got = language_id.predict(docs, model)
    return got.filter((F.col(language_id.LANG) != "und") & (F.col(language_id.SCORE) >= SURE)).select(*columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space apart."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: shingles of five words, similarity of 0.8 or more."""
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no window of a benchmark item."""
    got = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return got.filter(F.col(decontaminate.N_HIT) == 0).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes that they decode to."""
    return bpe.digests(docs, *bpe.public_vocabulary(), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
