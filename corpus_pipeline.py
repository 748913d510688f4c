"""A corpus pipeline: language ID, line dedup, near-dedup (SimHash links and links by similar shingle sets), mixing to target weights, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``, which has the columns of ``documents``;
all stages but the last return these columns. Other columns are carried along; only names that begin with two
underscores are taken. An empty table goes through every stage and stays empty; rows that repeat are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language, lines, mixing, simhash
from tessera.llm.common import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told go on unchanged; those that the classifier rejects go, null and empty texts with them."""
    fitted, min_margin = language.learn(docs)
    found = language.predict(docs.select("doc_id", "text"), fitted, min_margin, keep=docs, rejected="__rejected")
    return found.filter("NOT __rejected").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has in an aligned block go; a document of which nothing is left goes as well.

    Null texts have no lines and stay; rows without id are left alone; of equal documents the one of smallest id stays.
    """
    out = lines.line_dedup(docs, removed="__gone")
    changed = F.col("__gone").isNotNull()
    out = out.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words) the document with the smallest id stays.

    Rows without id stay; null and empty texts are copies of each other; rows that share an id stay or go together.
    """
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one of its own, a null text has no words and comes once an epoch."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; null and empty texts have no tokens."""
    return bpe.digests(docs.select("doc_id", "text"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No stage but the mixing can be said in SQL. The tests hold line dedup, near-dedup and mixing against brute force, BPE
#: against its library, and language ID against its labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
