"""Five stages over ``documents``: quality rules, near-duplicates, benchmark passages, personal data, encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and is the next function's ``docs``. All but the last return the columns of ``documents``.

Rows with NULL text are empty texts, which the quality rules reject. Repeated rows count as copies of each other. Columns
besides doc_id, text and n_chars pass through untouched, whatever their names. An empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import bpe, decontam, minhash, pii, quality
from vitrine.llm.common import cut, reach, table
from vitrine.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules."""
    return quality.accepted(docs, quality.references(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the least id."""
    reach(spark)
    return minhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with personal data replaced by its kind; n_chars follows the new text."""
    reach(spark)
    masked = pii.mask(docs, pii.fit(docs))
    if "n_chars" not in docs.columns:
        return masked
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), size))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the number and digest of their tokens and the digest of the decoded tokens."""
    reach(spark)
    return bpe.encode_texts(docs, bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", encoding),
]

#: No SQL: banded alignment, a trained tagger and byte-pair merging have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs, f"stage-{number}")
    return docs
