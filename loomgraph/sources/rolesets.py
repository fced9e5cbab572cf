"""Roleset catalog: frame files in XML, and a Parquet cache that holds for one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE = "struct<_n: string, _descr: string>"
SCHEMA = f"_id string, _name string, roles struct<role: array<{ROLE}>>"


def canonical_id(raw: Column) -> Column:
    """`<lemma>.<NN>`: only the separator before the sense number is changed; without a number as it is, lowered."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    number = F.regexp_extract(low, r"[._-](\d{1,2})$", 1)
    return F.when(number == "", low).otherwise(F.concat(F.regexp_replace(low, r"[._-]\d{1,2}$", ""), F.lit("."), F.lpad(number, 2, "0")))


def catalog(rolesets: DataFrame) -> DataFrame:
    """(roleset_id, lemma, name, description, roles): numbered roles only; ids without a sense number are left out."""
    numbered = F.filter(F.coalesce(F.col("roles.role"), F.array().cast(f"array<{ROLE}>")), lambda r: r["_n"].rlike("^[0-9]+$"))
    entries = F.transform(numbered, lambda r: F.struct(F.concat(F.lit(":ARG"), r["_n"]), F.trim(F.coalesce(r["_descr"], F.lit("")))))
    name = F.trim(F.coalesce("_name", F.lit("")))
    last = F.aggregate(entries, F.map_from_entries(F.slice(entries, 1, 0)), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["col1"]), F.map_from_entries(F.array(e))))
    found = rolesets.select(canonical_id(F.col("_id")).alias("roleset_id"), name.alias("name"), name.alias("description"), last.alias("roles"))
    dotted = found.where(F.col("roleset_id").contains("."))
    return dotted.select("roleset_id", F.regexp_replace("roleset_id", r"\.[^.]*$", "").alias("lemma"), "name", "description", "roles")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Frame files of a folder; files that aren't XML give nothing."""
    rows = spark.read.format("xml").option("rowTag", "roleset").option("mode", "DROPMALFORMED").schema(SCHEMA).load(path)
    return catalog(rows)


def write_cache(rolesets: DataFrame, path: str, commit: str) -> None:
    rolesets.withColumn("commit", F.lit(commit)).write.mode("overwrite").partitionBy("commit").parquet(path)


def read_cache(spark: SparkSession, path: str, commit: str) -> DataFrame:
    """The catalog of one commit; empty if the cache is of another."""
    return spark.read.parquet(path).where(F.col("commit") == commit).drop("commit")
