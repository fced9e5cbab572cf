"""From extracted JSON of many shapes to events of one shape, and rejects."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.functions import vocab as v
from loomgraph.storage import spread


def cleaned_json(raw: Column) -> Column:
    """A variant from model output: without a code fence; the whole, or what its outermost braces hold; else null."""
    text = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def shape(value: Column) -> Column:
    """`array`, `object`, `string`, `number`, `boolean`, or null for nothing.

    Only plain values are asked for their schema: that of an object or a list is made of all that it holds.
    """
    of = lambda kind: F.try_variant_get(value, "$", kind).isNotNull()
    return F.when(of("map<string,variant>"), "object").when(of("array<variant>"), "array").otherwise(t.once(F.schema_of_variant(value), _plain_shape))


def _plain_shape(kind: Column) -> Column:
    return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind != "VOID", "number")


def field(value: Column, *names: str) -> Column:
    """The first of some fields that holds a text or number, as trimmed text; else null."""
    text = lambda n: t.once(F.btrim(F.try_variant_get(value, f"$.{n}", "string")), lambda x: F.when(x != "", x))
    one = lambda n: F.when(~F.schema_of_variant(F.try_variant_get(value, f"$.{n}", "variant")).rlike("^(?:ARRAY|OBJECT|VOID)"), text(n))
    return F.coalesce(*map(one, names))


def time_of(value: Column) -> Column:
    """struct(raw_expression, start_year, end_year) of a time as text, number or object."""
    def parts(kind: Column) -> Column:
        raw = F.when(kind == "object", field(value, "raw_expression", "expression", "text", "time")).when(kind.isin("string", "number"), F.btrim(F.try_variant_get(value, "$", "string")))
        number = F.when(kind == "number", F.try_variant_get(value, "$", "double").cast("bigint"))
        year = lambda name: F.coalesce(number, F.when(kind == "object", field(value, name).try_cast("bigint")))
        return F.struct(raw.alias("raw"), year("start_year").alias("start"), year("end_year").alias("end"))

    def whole(p: Column, found: Column) -> Column:
        first = F.coalesce(p["start"], found["start_year"])
        return F.struct(F.coalesce(p["raw"], F.lit("")).alias("raw_expression"), first.alias("start_year"), F.when(p["start"].isNull() & found["start_year"].isNotNull(), found["end_year"]).otherwise(F.coalesce(p["end"], first)).alias("end_year"))

    return t.once(t.once(shape(value), parts), lambda p: t.once(t.years(p["raw"]), lambda found: whole(p, found)))


def place_of(value: Column) -> Column:
    """struct(location_name, parent_region): the head of a qualified place, its tail before the region; null without a name."""
    some = lambda text: t.once(text, lambda x: F.when(x != "", x))

    def said(kind: Column) -> Column:
        name = F.when(kind == "object", field(value, "location_name", "location", "name", "place")).when(kind == "string", some(F.btrim(F.try_variant_get(value, "$", "string"))))
        return F.struct(name.alias("name"), F.when(kind == "object", field(value, "parent_region")).alias("region"))

    def whole(p: Column, parts: Column) -> Column:
        tail = F.when(parts.isNotNull(), F.array_join(F.slice(parts, 2, 9), ", "))
        return F.struct(F.coalesce(parts[0], p["name"]).alias("location_name"), some(F.concat_ws(", ", tail, p["region"])).alias("parent_region"))

    return t.once(t.once(shape(value), said), lambda p: F.when(p["name"].isNotNull(), t.once(t.split_place(p["name"]), lambda parts: whole(p, parts))))


_SLOTS = json.dumps({f":{n}": role for role, names in v.ROLE_ALIASES.items() for n in names})


def role_slot(key: Column) -> Column:
    """The canonical role that a key names; null for none."""
    k = F.lower(key)
    proper = F.when(k.rlike("^:arg(?:[0-5]|m-[a-z]+)$"), F.upper(k)).when(k.isin(*v.CONTEXT_ROLES), k)
    return F.coalesce(proper, F.try_element_at(F.from_json(F.lit(_SLOTS), "map<string,string>"), k))


def roles_of(entries: Column) -> Column:
    """struct(roles, rejected) from array<struct<key, value>> in order.

    A proper role takes the last value given; a name that stands for a role fills it only
    if it is free so far; keys that name no role are rejected.
    """
    keyed = F.transform(entries, lambda e: F.struct(F.when(e["key"].startswith(":"), F.btrim(e["key"])).otherwise(F.concat(F.lit(":"), F.btrim(e["key"]))).alias("key"), F.btrim(e["value"]).alias("value")))
    fine = F.filter(keyed, lambda e: (e["value"] != "") & (e["key"] != ":"))
    empty = F.struct(F.create_map().cast("map<string,string>").alias("roles"), F.array().cast("array<string>").alias("rejected"))
    proper = lambda k: F.lower(k).rlike(r"^:arg[0-5]$|^:argm-[a-z]+$") | F.lower(k).isin(*v.CONTEXT_ROLES)

    def put(acc: Column, e: Column) -> Column:
        return t.once(role_slot(e["key"]), lambda slot: _put(acc, e, slot))

    def _put(acc: Column, e: Column, slot: Column) -> Column:
        rest = F.map_filter(acc["roles"], lambda k, _: k != slot)
        added = F.map_concat(rest, F.create_map(F.coalesce(slot, F.lit("")), e["value"]))
        keep = slot.isNull() | (~proper(e["key"]) & F.coalesce(F.map_contains_key(acc["roles"], F.coalesce(slot, F.lit(""))), F.lit(False)))
        return F.struct(F.when(keep, acc["roles"]).otherwise(added).alias("roles"), F.when(slot.isNull(), F.concat(acc["rejected"], F.array(e["key"]))).otherwise(acc["rejected"]).alias("rejected"))

    return F.aggregate(fine, empty, put)


def role_entries(value: Column) -> Column:
    """array<struct<key, value>> of roles as an object, or as a list of {role, value} objects; nested values are left out."""
    return t.once(value, _role_entries)


def _role_entries(value: Column) -> Column:
    flat = F.filter(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: shape(e["value"]).isin("string", "number", "boolean"))
    plain = F.transform(flat, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.lit("")).alias("value")))
    listed = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda i: F.struct(F.coalesce(field(i, "role", "argument", "name", "tag", "label"), F.lit("")).alias("key"), F.coalesce(field(i, "value", "entity", "text", "val", "target"), F.lit("")).alias("value")),
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    return t.once(shape(value), lambda kind: F.when(kind == "object", plain).when(kind == "array", listed).otherwise(none))


def events_of(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Events of payloads, one row each, with `rejected` role keys; other columns stay.

    A payload is an object with `events`, a list of events, or one event. Elements that are
    no objects are dropped. Role keys that name no role go to a slot by their words, if it is
    free, or to the next free argument.
    """
    parsed = spread(payloads).withColumn("_v", cleaned_json(F.col(raw)))
    parsed = parsed.withColumn("_kind", shape(F.col("_v")))
    kind, inner = F.col("_kind"), F.try_variant_get("_v", "$.events", "variant")
    one = F.greatest(*[F.try_variant_get("_v", f"$.{n}", "variant").isNotNull() for n in ("roles", "lemma", "sense_id", "frame")])
    events = F.when(kind == "array", F.try_variant_get("_v", "$", "array<variant>")).when(inner.isNotNull(), F.try_variant_get("_v", "$.events", "array<variant>")).when((kind == "object") & one, F.array("_v"))
    rows = parsed.select(*payloads.columns, F.posexplode(F.filter(events, lambda e: shape(e) == "object")).alias("event_ord", "_e"))
    # a step each for what the next one names more than once
    rows = rows.withColumns({"_lemma": field(F.col("_e"), "lemma"), "_given": field(F.col("_e"), "sense_id"), "_roles": F.try_variant_get("_e", "$.roles", "variant")})
    lemma, number, base, given = map(F.col, ("_lemma", "_number", "_base", "_given"))
    rows = rows.withColumn("_number", F.regexp_extract(lemma, r"^\s*[A-Za-z][A-Za-z_\- ]*?[._-](\d{1,2})\s*$", 1))
    rows = rows.withColumn("_base", F.when(number != "", F.btrim(F.regexp_extract(lemma, r"^\s*([A-Za-z][A-Za-z_\- ]*?)[._-]\d{1,2}\s*$", 1))).otherwise(lemma))
    own = F.when((number != "") & ~F.coalesce(F.lower(given).rlike(r"^[a-z_\- ]+\.\d{2}$") & F.lower(given).startswith(F.lower(base)), F.lit(False)), F.concat(base, F.lit("."), F.lpad(number, 2, "0"))).otherwise(given)
    sense = F.coalesce(own, field(F.col("_e"), "frame", "roleset_id", "roleset", "sense"), F.concat(base, F.lit(".01")), F.lit("event.01"))
    keyed = F.transform(role_entries(F.col("_roles")), lambda e: F.struct(F.when(e["key"].startswith(":"), e["key"]).otherwise(F.concat(F.lit(":"), e["key"])).alias("key"), e["value"].alias("value")))
    keyed = F.transform(keyed, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), role_slot(e["key"]).isNotNull().alias("known")))
    plain = lambda entries: F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    rows = rows.withColumns({"_sense": sense, "_keyed": keyed, "_time": F.try_variant_get("_e", "$.time_context", "variant"), "_place": F.try_variant_get("_e", "$.spatial_context", "variant"), "_epistemic": F.try_variant_get("_e", "$.epistemic_context", "variant")})
    shaped = rows.select(
        *payloads.columns,
        "event_ord",
        F.coalesce(field(F.col("_e"), "temp_id", "id"), F.concat(F.lit("ev_"), F.col("event_ord") + 1)).alias("temp_id"),
        t.sense_id(F.col("_sense")).alias("sense_id"),
        F.coalesce(base, F.nullif(F.regexp_replace("_sense", r"[.\-]\d.*$", ""), F.lit("")), F.lit("event")).alias("lemma"),
        roles_of(plain(F.filter("_keyed", lambda e: e["known"]))).alias("_known"),
        plain(F.filter("_keyed", lambda e: ~e["known"] & (F.btrim(e["value"]) != ""))).alias("_other"),
        F.when(shape(F.col("_time")).isin("string", "number", "object"), time_of(F.col("_time"))).alias("time_context"),
        place_of(F.col("_place")).alias("spatial_context"),
        F.struct(
            F.coalesce(field(F.col("_epistemic"), "source"), F.lit("Unattributed")).alias("source"),
            F.coalesce(field(F.col("_epistemic"), "confidence").try_cast("double"), F.lit(1.0)).alias("confidence"),
            F.coalesce(field(F.col("_epistemic"), "is_speculative").try_cast("boolean"), F.lit(False)).alias("is_speculative"),
        ).alias("epistemic_context"),
    )

    def place(acc: Column, e: Column) -> Column:
        wanted = t.role_for_key(e["key"])
        free = F.filter(F.array(*[F.lit(f":ARG{i}") for i in range(6)]), lambda s: ~F.map_contains_key(acc, s))
        slot = F.when(~F.map_contains_key(acc, wanted), wanted).when(wanted.startswith(":ARG"), F.try_element_at(free, F.lit(1)))
        return F.when(slot.isNull(), acc).otherwise(F.map_concat(acc, F.create_map(F.coalesce(slot, F.lit("")), F.btrim(e["value"]))))

    placed = shaped.withColumn("roles", F.aggregate("_other", F.col("_known.roles"), place)).withColumn("rejected", F.col("_known.rejected"))
    return placed.withColumn("valid", F.col("epistemic_context.confidence").between(0, 1)).drop("_known", "_other")


def discourse_of(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """(source_id, target_id, relation) of payloads' discourse links; other columns stay."""
    links = F.try_variant_get(cleaned_json(F.col(raw)), "$.discourse", "array<variant>")
    rows = spread(payloads).select(*payloads.columns, F.posexplode(F.filter(links, lambda e: shape(e) == "object")).alias("link_ord", "_l"))
    end = lambda *names: F.coalesce(field(F.col("_l"), *names), F.lit(""))
    return rows.select(*payloads.columns, "link_ord", end("source_id", "source", "src", "from").alias("source_id"), end("target_id", "target", "tgt", "to").alias("target_id"), t.relation(field(F.col("_l"), "relation", "rel", "type")).alias("relation"))
