"""The rewrite chain over stated payloads."""

from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators import coerce, rewrite
from loomgraph.plans import event_queries


def test_chain(spark, sf):
    rows = event_queries.w0_stated_payloads(spark, sf).collect()
    found = {(r["sense_id"], r["roles"]) for r in rows}
    assert ("found.01", ":ARG0=Ada Lee; :ARG1=Acme Corp") in {(s, "; ".join(p for p in r.split("; ") if p.startswith(":ARG0") or p.startswith(":ARG1"))) for s, r in found}
    assert any(s == "sibling.01" and ":ARG0=Ann Poe" in r and ":ARG1=Bob Poe" in r for s, r in found)  # from "elder sister of"
    assert not any(s == "parent.01" and "ada" in r for s, r in found)  # nobody is their own parent
    assert any(s == "locate.01" and ":ARG1=Texas; :ARG2=United States" in r for s, r in found)  # from the place's parts
    assert not any("unknown" in r for _, r in found)
    assert all(r["roles"] for r in rows)


def test_payloads_of_one_partition_are_read_on_all_cores(spark):
    payloads = spark.range(40).selectExpr("id", """'{"lemma": "buy", "roles": {"ARG0": "Ann"}}' AS raw""").coalesce(1)
    events = coerce.events_of(payloads)
    assert events.rdd.getNumPartitions() > 4 and events.count() == 40


def _calls(rows, name):
    return rows._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_what_a_rewrite_names_twice_is_evaluated_once(spark, sf, monkeypatch):
    """The steps' plans named a field, a key or a role thousands of times, as each naming repeated what it is made of."""
    monkeypatch.setattr(rewrite, "materialised", lambda df: plans.append(df) or storage.materialised(df))
    plans = []
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        payloads = event_queries._payloads(spark, sf).limit(20)
        event_queries._rewritten(payloads)
        calls = [sum(_calls(p, x) for x in ("regexp_extract(", "regexp_replace(", "variant_get(")) for p in plans]
        assert 7 <= len(calls) and max(calls) < 200, calls
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_shapes_of_values(spark):
    """An object's shape was told by the schema of all that it holds."""
    told = ["{}", "[]", '{"a": {"b": [1, "x"]}}', '[1, {"a": 2}]', '"x"', '""', "1", "1.5", "true", "null", None]
    got = spark.createDataFrame([(x,) for x in told], "raw string").select(coerce.shape(F.try_parse_json("raw")).alias("shape"))
    assert [x.shape for x in got.collect()] == ["object", "array", "object", "array", "string", "string", "number", "number", "boolean", None, None]
    assert "isnotnull(try_variant_get" in got._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_keyed_only_beside_an_owner(spark):
    """All names of every event were keyed, though only those of events with an owner are asked for."""
    rows = spark.createDataFrame([("a", {":ARG0": "Ann Poe", ":ARG1": "Acme's old plant"}), ("b", {":ARG0": "Acme's plant", ":ARG1": "Acme"}), ("c", {":ARG0": "Ann Poe"})], "event_id string, roles map<string,string>")
    linked = rewrite.link_possessors(rows)
    assert {r.event_id: r.roles.get(":ARGM-POSS") for r in linked.collect()} == {"a": "Acme", "b": None, "c": None}
    assert "map_values(roles" in (plan := linked._jdf.queryExecution().analyzed().toString()) and "CASE WHEN (size(_owners" in plan
