"""The corpus operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op01_quality as op

    return op.classified(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op02_language as op

    return op.identified(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op03_katz as op

    return op.scored(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0, order=3)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op04_token_files as op

    return op.token_files(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end=1)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op05_media as op

    return op.digest(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op06_decontaminate as op

    return op.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op07_chat as op

    return op.formatted(*op.derived(table(spark, sf_dir, "conversations"))).withColumn("faults", F.concat_ws("; ", "faults"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op08_substring as op

    return op.digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op09_simhash as op

    return op.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op10_bpe as op

    return op.digest(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op11_vector_codes as op

    return op.digest(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op12_prefix_trie as op

    return op.nodes(table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import op13_packing as op

    return op.digest(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_language, op3_katz, op4_token_files, op5_media, op6_decontaminate, op7_chat, op8_substring, op9_simhash, op10_bpe, op11_vector_codes, op12_prefix_trie, op13_packing)}


def oracle_sql() -> dict[str, str]:
    from loomgraph.llm import op06_decontaminate, op11_vector_codes, op12_prefix_trie

    return {"op6_decontaminate": op06_decontaminate.ORACLE_SQL, "op11_vector_codes": op11_vector_codes.ORACLE_SQL, "op12_prefix_trie": op12_prefix_trie.ORACLE_SQL}
