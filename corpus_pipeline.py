"""The corpus pipeline: documents in, token ids of the kept documents out.

Every stage but the last returns rows of its input as they are, with all their columns whatever these
are called, in no set order. Texts are read whole, however long; of an empty table nothing is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscule.llm import bpe, decontaminate, lang_id, quality, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no known language is recognised.

    Texts that are null, empty or without letters go, and those unlike any labelled language's text.
    Repeated rows all stay or all go, equal rates count for the language first in the alphabet, a null
    ``doc_id`` or ``lang`` doesn't matter. If no row has a ``lang``, every text with letters stays.
    """
    return lang_id.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality and toxic ones.

    Null and empty texts stay or go by the models' biases, repeated rows all stay or all go, a score that
    equals a threshold is kept, a null ``doc_id`` doesn't matter. Without labels every row stays.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the smallest ``doc_id``, a null one last.

    Of rows repeated in id and text one stays, that whose columns come first as JSON. Null texts all
    stay; empty texts are a group.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, copied or paraphrased.

    Null and empty texts stay, repeated rows all stay or all go, a null ``doc_id`` doesn't matter. Without
    benchmark items every row stays.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, token_ids, n_tokens, round_trip`` of what is left.

    A null text has null ids and no tokens, an empty one an empty list; repeated rows each give a row, a
    null ``doc_id`` stays null.
    """
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express these stages; tests/llm hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to what the one before it wrote.

    A stage's table is dropped once the next one's is written; the last that is written stays, as the
    result is read from it.
    """
    from corpuscule.llm.common import Scratch
    from corpuscule.plans.tables import spread

    docs, scratch = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.cut(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
