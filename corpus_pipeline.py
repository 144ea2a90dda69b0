"""A training corpus from `documents`: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slateflow.llm import decontaminate, langid, near_dedup, packing, pii
from slateflow.llm.common import new_path, read

#: A document whose best language has a smaller mean probability than this is rejected.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; null and empty texts, texts without letters or of unclear language go.

    Of repeated rows all or none stay; a null doc_id makes no difference. Columns of any name pass through.
    An empty table, or one without labels, gives no rows.
    """
    return langid.keep_known(docs, langid.fit(docs), LEAST_SCORE)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null and empty texts are groups of their own, rows without doc_id stay, and repeated rows of a document
    that stays all do. An empty table gives no rows.
    """
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none, rows without doc_id stay, and repeated rows of a document go together. An
    empty benchmark leaves all documents.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, personal data in its text replaced by its kind; null texts stay null."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids: a row for each piece with its ids (little-endian unsigned 32-bit), its sequence and its place there.

    Null and empty texts are the end id alone; repeated rows are packed one by one.
    """
    return packing.pack_documents(docs, packing.public_tokenizer(), keep_ids=True)


STAGES = [
    ("language_id", language),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("pii", masked),
    ("packing", packed),
]

#: A trained network and a tokenizer decide the rows; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
