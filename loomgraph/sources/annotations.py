"""Annotation sheets: export of extractions, subsets, reading, and a judge's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import answers
from loomgraph.operators import coerce, stats

FIELDS = ("paragraph_key", "paragraph_text", "event_index", "lemma", "sense_id", "roles", "role_meanings", "time", "place", "event_correct", "roles_correct", "context_correct", "missed_facts")
EVENT = "struct<lemma:string,sense_id:string,roles:map<string,string>,time_context:map<string,string>,spatial_context:map<string,string>>"


def exported(cache: DataFrame, texts: DataFrame, n: int, seed: int, meanings: DataFrame | None = None, extractor: str | None = None) -> DataFrame:
    """Rows of an annotation sheet for n sampled extractions, the text on the first row of each.

    cache: key, payload (JSON); texts: key, model, text; meanings: sense_id, meanings map.
    Texts of several models need an extractor to be named. A paragraph without events has one
    empty row.
    """
    if extractor is None and texts.select("model").distinct().limit(2).count() > 1:
        raise ValueError("the cache has extractions of several models; name one")
    mine = texts.where(F.col("model") == extractor) if extractor is not None else texts
    chosen = stats.seeded_sample(cache.join(mine.select("key"), "key", "left_semi").select("key"), "key", n, seed)
    rows = cache.join(chosen, "key", "left_semi").join(mine.select("key", "text"), "key")
    events = F.from_json(F.get_json_object("payload", "$.events"), f"array<{EVENT}>")
    each = rows.select("key", "text", F.posexplode_outer(F.when(F.size(events) > 0, events)).alias("at", "e")).withColumn("at", F.coalesce("at", F.lit(0)))
    if meanings is not None:
        from loomgraph.operators import senses

        each = each.join(meanings.select(F.col("sense_id").alias("_sense"), "meanings"), F.col("e.sense_id") == F.col("_sense"), "left")
        told = F.when(F.col("e").isNotNull(), senses.role_meanings_json(F.col("e.roles"), F.coalesce("meanings", F.create_map().cast("map<string,string>")))).otherwise("")
    else:
        told = F.lit("")
    text = lambda c: F.coalesce(c, F.lit(""))
    return each.select(
        F.col("key").alias("paragraph_key"), F.when(F.col("at") == 0, F.col("text")).otherwise("").alias("paragraph_text"), F.col("at").cast("string").alias("event_index"), text(F.col("e.lemma")).alias("lemma"), text(F.col("e.sense_id")).alias("sense_id"),
        F.when(F.col("e").isNotNull(), text(F.to_json("e.roles"))).otherwise("").alias("roles"), text(told).alias("role_meanings"), text(F.to_json("e.time_context")).alias("time"), text(F.to_json("e.spatial_context")).alias("place"),
        *[F.lit("").alias(c) for c in FIELDS[9:]],
    )


def subset(sheet: DataFrame, n: int, seed: int) -> DataFrame:
    """All rows of n sampled paragraphs."""
    keys = stats.seeded_sample(sheet.select("paragraph_key").distinct(), "paragraph_key", n, seed)
    return sheet.join(keys, "paragraph_key", "left_semi")


def write_sheet(sheet: DataFrame, path: str) -> None:
    order = sheet.repartition("paragraph_key").sortWithinPartitions("paragraph_key", F.col("event_index").cast("int"))
    order.select(*FIELDS).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as texts; blank cells are empty."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"{c} string" for c in FIELDS)).csv(path)
    return rows.fillna("")


def rules_between(text: Column, start: str, end: str) -> Column:
    """What a guideline has between two markers; null without both."""
    inside = F.regexp_replace(F.substring_index(F.substring(text, F.instr(text, start) + F.lit(len(start)), F.length(text)), end, 1), r"(?U)^\s+|\s+$", "")
    return F.when((F.instr(text, start) > 0) & F.substring(text, F.instr(text, start) + F.lit(len(start)), F.length(text)).contains(end), inside)


def binary(value: Column) -> Column:
    """0 or 1 from a variant that is a number, a truth value or a text of them; else null."""
    kind = coerce.shape(value)
    number = F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind == "number", F.try_variant_get(value, "$", "double")).when(kind == "string", F.when(F.btrim(F.try_variant_get(value, "$", "string")).isin("0", "1"), F.btrim(F.try_variant_get(value, "$", "string")).cast("double")))
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def judged(responses: DataFrame, sheet: DataFrame) -> DataFrame:
    """A judge's answers held against the sheet: (paragraph_key, errors, missed_facts, event_index, event_correct, roles_correct, context_correct).

    responses: paragraph_key, raw. An answer is refused as a whole, with its errors, if it has
    no JSON object, judges an unknown event or one twice, leaves one out, or has a value that
    is no judgment. Roles are judged only where the event is right, and its context only where
    it has one; what is said beyond that is left blank. Refused answers have one row.
    """
    parsed = responses.select("paragraph_key", coerce.cleaned_json(F.col("raw")).alias("v"))
    listed = F.try_variant_get("v", "$.events", "array<variant>")
    missed = F.try_variant_get("v", "$.missed_facts", "variant")
    count = F.when((coerce.shape(missed) == "number") & (F.try_variant_get(missed, "$", "double") % 1 == 0) & (F.try_variant_get(missed, "$", "double") >= 0), F.try_variant_get(missed, "$", "double").cast("int"))
    no_list = F.try_variant_get("v", "$.events", "variant").isNotNull() & (coerce.shape(F.try_variant_get("v", "$.events", "variant")) != "array")
    heads = parsed.select(
        "paragraph_key", count.alias("missed_facts"),
        F.array_compact(F.array(F.when(F.col("v").isNull() | (coerce.shape(F.col("v")) != "object"), "no JSON object in the response"), F.when(no_list, "'events' must be a list"), F.when(F.col("v").isNotNull() & count.isNull(), "missed_facts must be a non-negative integer"))).alias("head_errors"),
    )
    items = parsed.select("paragraph_key", F.explode(listed).alias("i")).select(
        "paragraph_key", F.coalesce(F.try_variant_get("i", "$.index", "double").cast("int"), F.lit(-1)).cast("string").alias("event_index"),
        *[binary(F.try_variant_get("i", f"$.{c}", "variant")).alias(c) for c in ("event_correct", "roles_correct", "context_correct")],
    )
    times = Window.partitionBy("paragraph_key", "event_index")
    numbered = items.withColumn("times", F.count("*").over(times))
    mine = sheet.where("lemma <> ''").select("paragraph_key", "event_index", answers.has_context(F.col("time"), F.col("place")).alias("context"), F.lit(True).alias("asked"))
    both = numbered.join(mine, ["paragraph_key", "event_index"], "full").join(responses.select("paragraph_key"), "paragraph_key", "left_semi")
    right = F.col("event_correct") == 1
    wrong = (
        F.when(F.col("asked").isNull(), F.concat(F.lit("unknown event index "), "event_index")).when(F.col("times").isNull(), F.concat(F.lit("event not judged: "), "event_index")).when(F.col("times") > 1, F.concat(F.lit("event judged twice: "), "event_index"))
        .when(F.col("event_correct").isNull(), F.concat(F.lit("event_correct must be 0 or 1: "), "event_index")).when(right & F.col("roles_correct").isNull(), F.concat(F.lit("roles_correct must be 0 or 1: "), "event_index"))
        .when(right & F.col("context") & F.col("context_correct").isNull(), F.concat(F.lit("context_correct must be 0 or 1: "), "event_index"))
    )
    checked = both.withColumn("error", wrong)
    faults = checked.groupBy("paragraph_key").agg(F.array_sort(F.collect_set("error")).alias("item_errors"))
    whole = heads.join(faults, "paragraph_key", "left").select("paragraph_key", "missed_facts", F.concat("head_errors", F.coalesce("item_errors", F.array().cast("array<string>"))).alias("errors"))
    fine = whole.where(F.size("errors") == 0).join(checked.select("paragraph_key", "event_index", "event_correct", F.when(right, F.col("roles_correct")).alias("roles_correct"), F.when(right & F.col("context"), F.col("context_correct")).alias("context_correct")), "paragraph_key", "left")
    refused = whole.where(F.size("errors") > 0).select("paragraph_key", "errors", F.lit(None).cast("int").alias("missed_facts"), F.lit(None).cast("string").alias("event_index"), *[F.lit(None).cast("int").alias(c) for c in ("event_correct", "roles_correct", "context_correct")])
    return fine.select(*refused.columns).unionByName(refused)
