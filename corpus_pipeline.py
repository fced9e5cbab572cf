"""A cleaning pipeline over `documents`: each stage reads what its predecessor kept.

Stages are written as Parquet in the folder that all executors share and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import op01_quality, op06_decontaminate, op08_substring, op09_simhash, op10_bpe
from loomgraph.llm.common import written
from loomgraph.session import importable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    importable(spark)
    return op01_quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id."""
    importable(spark)
    return op09_simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words that a document with a smaller doc_id repeats for 50 words; n_chars follows."""
    importable(spark)
    kept = op08_substring.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return op06_decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), short=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and digest of the decoded text."""
    import public_tokenizers

    importable(spark)
    return op10_bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("substring dedup", substrings), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", tokens)]
#: Not expressible: the classifier's training and BPE. tests/llm/test_pipeline.py holds the sequence against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage{number + 1}")
    return docs
