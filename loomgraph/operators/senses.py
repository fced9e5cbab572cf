"""Senses from a roleset catalog: candidates of a lemma, the best by its gloss, and roles aligned to what it declares.

rolesets: roleset_id, lemma, name, description, roles map<string,string>, and ord, their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vocab as v
from loomgraph.storage import materialised, spread

CORE = "^:ARG[0-5]$"


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"((?U)\w+)"), F.lit(1)))


def slots_of(roles: Column) -> Column:
    """Core roles that a map declares, in order."""
    return F.array_sort(F.filter(F.map_keys(roles), lambda k: k.rlike(CORE)))


def with_frames(rolesets: DataFrame) -> DataFrame:
    """The catalog with the system frames, which replace rolesets of their names."""
    rows = [(s, s.split(".")[0], s.split(".")[0], " ".join(roles.values()), roles, i) for i, (s, roles) in enumerate(v.FRAMES.items())]
    frames = rolesets.sparkSession.createDataFrame(rows, "roleset_id string, lemma string, name string, description string, roles map<string,string>, ord bigint")
    return rolesets.where(~F.col("roleset_id").isin(*v.FRAMES)).select(*frames.columns).unionByName(frames)


def candidate_senses(lemmas: DataFrame, rolesets: DataFrame) -> DataFrame:
    """(lemma, roleset_id, ord) of the first spelling of each lemma that the catalog has."""
    low = F.lower(F.btrim("lemma"))
    spellings = F.array_distinct(F.array(low, F.replace(low, F.lit("_"), F.lit("-")), F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit(" "), F.lit("_")), F.replace(low, F.lit(" "), F.lit("-"))))
    tried = lemmas.select("lemma").distinct().select(F.col("lemma"), F.posexplode(spellings).alias("rank", "spelling"))
    hits = tried.join(rolesets.select(F.col("lemma").alias("spelling"), "roleset_id", "ord"), "spelling")
    best = hits.groupBy("lemma").agg(F.min("rank").alias("rank"))
    return hits.join(best, ["lemma", "rank"]).select("lemma", "roleset_id", "ord")


def disambiguated(events: DataFrame, rolesets: DataFrame) -> DataFrame:
    """(event_id, roleset_id, overlap): of a lemma's senses the one that shares most words with the context; of equals the first.

    events: event_id, lemma, context. Events without a candidate have no row.
    """
    gloss = words_of(F.concat_ws(" ", "name", "description", F.map_values("roles")))
    # written, so that its size is known and the many events of few lemmas don't meet it by lemma, in a task each
    glossed = materialised(candidate_senses(events, rolesets).join(rolesets.select("roleset_id", gloss.alias("gloss")), "roleset_id"))
    rated = spread(events.select("event_id", "lemma", "context"), "event_id").select("event_id", "lemma", words_of(F.col("context")).alias("words")).join(glossed, "lemma").select("event_id", "roleset_id", "ord", F.size(F.array_intersect("words", "gloss")).alias("overlap"))
    best = rated.groupBy("event_id").agg(F.max(F.struct("overlap", (-F.col("ord")).alias("o"), "roleset_id")).alias("b"))
    return best.select("event_id", "b.roleset_id", "b.overlap")


def aligned_roles(roles: Column, slots: Column) -> Column:
    """Roles aligned to the declared slots; as they are where nothing is declared.

    A frame without ARG0 that is given one takes the arguments in their order. Else
    undeclared arguments move to free declared slots but ARG0, or stay if they are ARG0-2.
    """
    core = F.array_sort(F.filter(F.map_keys(roles), lambda k: k.rlike(CORE)))
    zipped = F.map_from_entries(F.filter(F.transform(core, lambda k, i: F.struct(F.try_element_at(slots, i + 1).alias("key"), F.try_element_at(roles, k).alias("value"))), lambda e: e["key"].isNotNull()))
    strays, free = F.array_except(core, slots), F.filter(F.array_except(slots, core), lambda s: s != ":ARG0")
    place = lambda k, i: F.struct(F.coalesce(F.try_element_at(free, i + 1), F.when(k.isin(":ARG0", ":ARG1", ":ARG2"), k)).alias("key"), F.try_element_at(roles, k).alias("value"))
    moved = F.map_from_entries(F.filter(F.transform(strays, place), lambda e: e["key"].isNotNull()))
    modifiers, declared = F.map_filter(roles, lambda k, _: ~k.rlike(CORE)), F.map_filter(roles, lambda k, _: F.array_contains(slots, k))
    shift = F.array_contains(core, ":ARG0") & ~F.array_contains(slots, ":ARG0")
    return F.when(slots.isNull() | (F.size(slots) == 0), roles).when(shift, F.map_concat(modifiers, zipped)).otherwise(F.map_concat(modifiers, declared, moved))


def role_meanings_json(roles: Column, meanings: Column) -> Column:
    """The meanings of a role map's roles as JSON, in its order; empty where none has one."""
    told = F.filter(F.transform(F.map_keys(roles), lambda k: F.struct(k.alias("key"), F.when(k == ":ARGM-POSS", "possessor").otherwise(F.coalesce(F.try_element_at(meanings, k), F.lit(""))).alias("value"))), lambda e: e["value"] != "")
    return F.when(F.size(told) > 0, F.to_json(F.map_from_entries(told))).otherwise("")


def known_senses(events: DataFrame, rolesets: DataFrame, context: Column) -> DataFrame:
    """Events whose sense isn't in the catalog take the sense that `disambiguated` finds; then roles are aligned to it."""
    catalog = with_frames(rolesets)
    ids = catalog.select(F.col("roleset_id").alias("sense_id"))
    lost = events.join(ids, "sense_id", "left_anti").select("event_id", "lemma", context.alias("context"))
    found = disambiguated(lost, catalog).select("event_id", "roleset_id")
    sensed = events.join(found, "event_id", "left").withColumn("sense_id", F.coalesce("roleset_id", "sense_id")).drop("roleset_id")
    declared = catalog.select(F.col("roleset_id").alias("sense_id"), slots_of(F.col("roles")).alias("_slots"))
    return sensed.join(declared, "sense_id", "left").withColumn("roles", aligned_roles(F.col("roles"), F.col("_slots"))).select(*events.columns)


def unique_ids(events: DataFrame, graph: str = "graph_id") -> DataFrame:
    """Adds `stored_id`: the proposed id, or that with its number among the events that propose it."""
    n = F.row_number().over(Window.partitionBy(graph, "event_id").orderBy("ord"))
    return events.withColumn("_n", n).withColumn("stored_id", F.when(F.col("_n") == 1, F.coalesce("event_id", F.lit("ev"))).otherwise(F.concat_ws("_", F.coalesce("event_id", F.lit("ev")), "_n"))).drop("_n")
