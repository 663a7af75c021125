"""A training-corpus pipeline over ``documents``; each stage reads what the one before wrote.

1. quality classifier: documents that the additive model rejects go; it learns from the labelled rows among its input.
2. exact dedup: one document of each group of equal texts stays.
3. near dedup: one document of each connected component of near-copies (five-word shingles, Jaccard 0.8 or more) stays.
4. mixing: documents are repeated or left out so that every source's words come near its target.
5. byte-level BPE: every document that is left is encoded and decoded; one row per document and copy.

All stages but the last return the columns of ``documents``. Null texts count as empty, and an empty input passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.llm.bpe import encode_decode
from docmill.llm.exact_dedup import drop_exact_copies
from docmill.llm.mixing import apply_mix
from docmill.llm.near_dedup import drop_near_copies
from docmill.llm.quality_model import keep_good
from docmill.llm.shared import documents, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, size=5, threshold=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("bpe", tokens)]

#: The classifier, the mix and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
