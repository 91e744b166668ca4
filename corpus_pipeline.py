"""A training corpus from ``documents``: toxic documents and common lines go, near copies go, sources are mixed, sequences are packed.

Every stage takes the rows that its predecessor kept and, but for the last, returns the columns of documents. An empty table passes
through all stages; extra columns are kept up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import line_runs, mixing, near_copies, packing, toxicity
from lintlake.llm.frames import fresh, stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score, examples = fresh(docs, "score"), fresh(docs, "examples")
    return toxicity.score_toxicity(docs, labels, texts, score, examples).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; ``n_chars`` follows the text."""
    clean = line_runs.drop_lines(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id (one row of it)."""
    return near_copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stretches of documents that the mix takes, once for each time it takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The classifier, the mix and the packing have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
