"""A corpus from raw documents to token ids, in stages of the operators in siteloom.llm.

Defined results: a null or empty text is scored like any other and, where it is kept, equals other empty texts, is near nothing, has no
words for the mix, so it is taken 0 times or up to twice by its share, and has no ids. Rows that share id and text are one document, which
stays or goes as a whole. Texts of any length stay whole. A table of documents without rows gives none; without
labels nothing is known against a document and all are kept. Further columns of documents are carried to the last stage, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import exact_dedup, minhash_dedup, mixing, quality, sentencepiece_lattice
from siteloom.llm.common import drop_scratch, scratch_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return minhash_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids."""
    return sentencepiece_lattice.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: No SQL: classifier, mix and tokenizer can't be expressed; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again, and dropped when the next has it."""
    docs, before = table(spark, sf_dir, "documents"), None
    top = scratch_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{top}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_scratch(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
