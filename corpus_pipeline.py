"""From raw documents to an encoded training mixture, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept, and returns the columns of ``documents``; the last returns
the encoded documents.  ``run`` writes each stage's rows as Parquet to the
shared folder and rereads them.  A stage that is lost half-way is computed
again from the last written one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import mixing, pieces, quality, simhash, toxicity
from lumenframe.llm.common import shared_folder
from lumenframe.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger rejects go."""
    return quality.keep(docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; it learns from the labels of the documents still there."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    return simhash.near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights holds them."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, with their piece numbers."""
    return pieces.sample(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("non_toxic", non_toxic),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("encoded", encoded),
]

#: SQL can express neither the classifier nor the lattice search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
