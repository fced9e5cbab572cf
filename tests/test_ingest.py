"""Ingestion in batches against a plain insertion one by one, and what is made of the stored graph."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.operators import evidence, graph, ingest, retrieval, stats
from loomgraph.sources import runs

EVENT = "graph_id string, ord bigint, source string, chunk string, original_id string, event_id string, lemma string, sense_id string, roles map<string,string>, time_context struct<raw_expression:string,start_year:bigint,end_year:bigint>, spatial_context struct<location_name:string,parent_region:string>, epistemic_context struct<source:string,confidence:double,is_speculative:boolean>"
NAMES = ["Ann Poe", "ann poe", "The Ann Poe", "Acme Inc.", "Acme", "Bob", "東京", "???", "by hand", "Foo 2", "Foo", "foo!"]


def made(n=150, seed=2):
    r, rows = random.Random(seed), []
    for i in range(n):
        roles = {f":ARG{k}": r.choice(NAMES) for k in r.sample(range(4), r.randint(0, 3))}
        time = r.choice([None, ("1999", 1999, 1999), ("then", None, None), ("", 2001, 2001)])
        place = r.choice([None, ("Bob", None), ("Oslo", "Norway"), (None, None)])
        rows.append((r.choice("gh"), i, "doc", str(i // 20), f"o{i % 20}", r.choice(["e1", "e2", None, "e~1", ""]), r.choice(["wed", "run"]), r.choice(["marry.01", "run.01"]), roles, time, place, (r.choice(["doc", "Ann"]), 0.5, False)))
    return rows


def plain(rows, links, keys, shown, slugs):
    """What one insertion after another stores: events, entities, role edges, discourse."""
    events, entities, roles, by_said, used, original = {}, {}, set(), {}, {}, {}

    def allocate(graph_id, base):
        base = base.replace("~", "-")
        used[graph_id, base] = used.get((graph_id, base), 0) + 1
        return base if used[graph_id, base] == 1 else f"{base}~{used[graph_id, base]}"

    for g, i, source, chunk, oid, eid, lemma, sense, said, time, place, about in sorted(rows, key=lambda x: x[1]):
        bound = sorted((k, x) for k, x in said.items())
        name = place[0] if place else None
        if name and keys[name] not in {keys[x] for _, x in bound}:
            bound.append((":location", name))
        key = (g, sense, frozenset((k, keys[x]) for k, x in bound), time[1:] if time and time[0] else None)
        if key not in by_said:
            by_said[key] = allocate((g, "event"), eid or "ev")
            events[g, by_said[key]] = (i, lemma, sense, about[0], time if time and time[0] else None, place if name else None)
            for k, x in bound:
                if (g, keys[x]) not in entities:
                    entities[g, keys[x]] = (allocate((g, "entity"), "ent_" + slugs[keys[x]]), shown[x])
                roles.add((g, by_said[key], k, entities[g, keys[x]][0]))
        original.setdefault((g, chunk, oid), by_said[key])
    ends = [(g, original.get((g, c, a)), original.get((g, c, b)), rel) for g, c, a, b, rel in links]
    return events, {(g, *x) for (g, _), x in entities.items()}, roles, {(g, a, b, rel) for g, a, b, rel in ends if a and b and a != b}


@pytest.mark.parametrize("cuts", [(), (70,), (30, 31, 140)])
def test_batches_equal_one_by_one(spark, tmp_path, cuts):
    rows = made()
    links = [(g, str(c), f"o{a}", f"o{a + 1}", ":before") for g in "gh" for c in range(8) for a in range(19)]
    names = spark.createDataFrame([(x,) for x in [*NAMES, "Oslo"]], "x string").select("x", t.match_key("x").alias("k"), t.surface(F.col("x")).alias("s"))
    keyed = names.withColumn("slug", t.slug(F.when(F.col("k") == "", "entity").otherwise(F.col("k")))).collect()
    events, entities, roles, discourse = plain(rows, links, {r.x: r.k for r in keyed}, {r.x: r.s for r in keyed}, {r.k: r.slug for r in keyed})
    frame = spark.createDataFrame(rows, EVENT).selectExpr("*", "0 n", "1 base").cache()
    linked = spark.createDataFrame(links, "graph_id string, chunk string, source_id string, target_id string, relation string").withColumn("source", F.lit("doc"))
    folder = str(tmp_path / "graph")
    for n, end in enumerate([*cuts, len(rows)]):
        part = frame.where(F.col("ord") < end)  # each batch gives all that came before again
        # links wait for their ends: all are given each time, those stored already add nothing
        assert ingest.appended(spark, folder, str(n), part.orderBy(F.rand(n)), linked)
        assert not ingest.appended(spark, folder, str(n), part, linked)
    got = ingest.stored_graph(spark, folder)
    when = {(r.graph_id, r.time_id): (r.raw, r.start_year, r.end_year) for r in got["time"].collect()}
    where = {(r.graph_id, r.place_id): (r.location, r.region) for r in got["place"].collect()}
    stored = {(r.graph_id, r.event_id): (r.ord, r.lemma, r.sense, r.source, when.pop((r.graph_id, f"time_{r.event_id}"), None), where.pop((r.graph_id, f"place_{r.event_id}"), None)) for r in got["event"].collect()}
    assert stored == events and not when and not where
    assert sorted((r.graph_id, r.entity, r.name) for r in got["entity"].collect()) == sorted(entities)
    assert sorted((r.graph_id, r.event_id, r.role, r.entity) for r in got["role"].collect()) == sorted(roles)
    assert {(r.graph_id, r.src_event, r.dst_event, r.relation) for r in got["discourse"].collect()} >= discourse
    if not cuts:
        assert {(r.graph_id, r.src_event, r.dst_event, r.relation) for r in got["discourse"].collect()} == discourse
    assert got["in_epistemic"].count() == got["epistemic"].count() == len(events)
    frame.unpersist()


def test_an_interrupted_batch_leaves_no_trace(spark, tmp_path):
    frame = spark.createDataFrame(made(20), EVENT)
    folder = str(tmp_path / "graph")
    added = ingest.ingested(frame)
    added["event"].write.parquet(f"{folder}/event/batch=1")  # a run that broke off here
    assert ingest.stored_graph(spark, folder)["event"].count() == 0
    assert ingest.appended(spark, folder, "1", frame)
    assert ingest.stored_graph(spark, folder)["event"].count() == added["event"].count()


def test_evidence_of_a_stored_graph(spark):
    """Lemma, insertion order, display names and roles reach the text without further work."""
    said = [
        ("g", 9, "doc", "0", "a", "a", "wed", "marry.01", {":ARG0": "The Ann Poe", ":ARG1": "Bob"}, ("1999", 1999, 1999), None, ("doc", 0.5, False)),
        ("g", 10, "doc", "0", "b", "b", "run", "run.01", {":ARG0": "ann poe", ":ARGM-POSS": "Cy"}, None, None, ("doc", 1.0, False)),
    ]
    tables = ingest.ingested(spark.createDataFrame(said, EVENT))
    asked = ingest.resolved(spark.createDataFrame([("g", 1, "ANN POE"), ("g", 2, "nobody")], "graph_id string, question_id bigint, name string"), tables)
    assert sorted((r.question_id, r.entity, r.known_as) for r in asked.collect()) == [(1, "ent_ann_poe", "Ann Poe"), (2, None, None)]
    questions = spark.createDataFrame([(1, "who?")], "question_id bigint, text string")
    row = evidence.bundle(ingest.bindings(tables), asked.where("entity IS NOT NULL"), questions, ingest.contexts(tables), tables["discourse"]).first()
    spouse = [m for s, r, m in ((r.sense, r.role, r.meaning) for r in evidence.role_meanings(spark).collect()) if s == "marry.01"]
    first, second = row.text.split("\n")[1], row.text.split("\n")[4]
    assert first == f"- [a] wed (marry.01): ARG0[{spouse[0]}]=Ann Poe; ARG1[{spouse[1]}]=Bob"
    assert row.event_ids == ["a", "b"] and second == "- [b] run (run.01): ARG0=Ann Poe; ARGM-POSS[possessor]=Cy"
    assert "Bob (Path: Ann Poe | ARG0<-[marry.01]->ARG1 | Bob)" in row.text
    found = graph.explore(ingest.bindings(tables), asked.where("entity IS NOT NULL"))[0]
    shown = graph.pathed(found.where("name = 'Bob'"), found).select(graph.readable_path(False)).first()[0]
    assert shown == "Ann Poe | wed | Bob"


def test_names_are_mentioned_exactly(spark):
    docs = spark.createDataFrame([(1, "In St. Louis, ann POE said C++."), (2, "St Louis and Annpoe; C++11"), (3, None), (4, "")], "doc_id bigint, text string")
    names = spark.createDataFrame([(1, "St. Louis"), (2, "St Louis"), (3, "Ann Poe"), (4, "C++"), (5, ""), (6, None), (7, "ann poe")], "name_id bigint, name string")
    assert sorted(tuple(r) for r in retrieval.mentions(docs, names).collect()) == [(1, 1), (1, 3), (1, 4), (1, 7), (2, 2)]
    assert retrieval.mentions(docs, names.limit(0)).count() == 0


def test_both_ways_of_resampling_agree(spark, monkeypatch):
    r = random.Random(1)
    rows = [(r.choice("ab"), float(r.randint(0, 5))) for _ in range(60)] + [("c", 2.0), (None, 1.0), ("a", None)]
    values = spark.createDataFrame(rows, "grp string, value double")
    few = {(x.grp, x.b): x.mean for x in stats.resampled_means(values, 120).collect()}
    monkeypatch.setattr(stats, "FEW_VALUES", 0)
    many = {(x.grp, x.b): x.mean for x in stats.resampled_means(values, 120).collect()}
    assert few.keys() == many.keys() == {(g, b) for g in "abc" for b in range(120)}
    assert all(abs(few[k] - many[k]) < 1e-12 for k in few)
    assert {x for (g, _), x in few.items() if g == "c"} == {2.0}
    span = {x.grp: (x.lo, x.hi) for x in stats.bootstrap_interval(values, 400).collect()}
    for g in "ab":
        own = [x for k, x in rows if k == g and x is not None]
        mean, wide = sum(own) / len(own), 3 * (sum((x - sum(own) / len(own)) ** 2 for x in own) / len(own) ** 2) ** 0.5
        assert mean - wide < span[g][0] < mean < span[g][1] < mean + wide


def test_a_broken_rewrite_leaves_old_or_new(spark, tmp_path):
    folder, schema = tmp_path / "p", "id string, predicted string"
    line = lambda i: f'{{"id": "{i}", "predicted": "X"}}\n'
    ids = lambda: sorted(r[0] for r in runs.compacted(spark, str(folder), schema).collect())
    folder.mkdir()
    (folder / "part.json").write_text(line("a") + '{"id": "b", "pre')
    half = tmp_path / "p._next"
    half.mkdir()
    (half / "part.json").write_text(line("z"))  # broke off while writing
    assert ids() == ["a"] and not half.exists()
    folder.rename(tmp_path / "p._last")  # broke off between the renames, before the new folder was whole
    assert ids() == ["a"]
    folder.rename(tmp_path / "p._last")
    half.mkdir()
    (half / "part.json").write_text(line("n"))
    (half / "_SUCCESS").write_text("")  # the same, after it was whole
    assert ids() == ["n"] and not (tmp_path / "p._last").exists()


def test_salvage():
    assert runs.salvaged('x {"events": [{"a": "}]{"}, {"b": {"c": 1}}, {"d": ["e') == '{"events": [{"a": "}]{"}, {"b": {"c": 1}}]}'
    assert runs.salvaged('{"events": [{"a": 1}], "discourse": [{"s": 1}, {"t": ') == '{"events": [{"a": 1}], "discourse": [{"s": 1}]}'
    assert runs.salvaged('{"events": [{"a": 1}]} and more') == '{"events": [{"a": 1}]}'
    assert runs.salvaged('{"events": [{"a": "cut \\" he') is None
    assert runs.salvaged('{"events": {}}') is None
    assert runs.salvaged("[" * 9 + '{"events": [' + '{"a": 1}, ' * 20_000 + '{"b') is not None


def test_resampling_is_shared_by_tasks_and_counts_the_numbered_draws(spark):
    import numpy as np

    values = spark.range(900).selectExpr("'x' AS grp", "CAST(id % 7 AS double) AS value")
    means = stats.resampled_means(values, 1000)
    assert means.rdd.getNumPartitions() > 8  # small rows of much work, which adaptive execution puts into one partition
    for n, ends in ((7, [2, 3, 7]), (70_000, [1, 69_999, 70_000]), (70_000, list(range(1000, 70_001, 1000)))):
        keys = np.array([1, 5, (1 << 32) - 1], np.uint64)
        plain = [np.bincount(np.searchsorted(ends, stats._places(k, 0, n, n), "right"), minlength=len(ends)) for k in keys]
        assert (stats._counted(keys, np.array(ends), n) == plain).all()


def test_events_are_noted_by_the_search_and_kinds_of_events_are_broadcast(spark):
    row = "g string, event_id string, ord bigint, lemma string, sense string, role string, entity string".replace("g ", "graph_id ", 1)
    said = [("g", f"e{i}", i, "buy", "buy.01", role, entity) for i in range(30) for role, entity in ((":ARG0", f"a{i % 3}"), (":ARG1", f"b{i % 7}"))] + [("g", "alone", 99, "sleep", "sleep.01", ":ARG0", "a0")]
    bindings = spark.createDataFrame(said, row).withColumn("name", F.col("entity"))
    anchors = spark.createDataFrame([("g", 1, "a0")], "graph_id string, question_id bigint, entity string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    entities, events = graph.explore(bindings, anchors, 1)
    assert "Join" not in plan(events)  # the whole graph isn't joined once more
    assert {x.event_id for x in events.collect()} == {"alone", *(f"e{i}" for i in range(0, 30, 3))}
    assert {x.entity for x in entities.collect()} == {"a0", *(f"b{i}" for i in range(7))}
    rated = evidence.with_relevance(events, spark.createDataFrame([(1, "who buys")], "question_id bigint, text string"), bindings)
    assert "hashpartitioning(lemma" not in plan(rated)  # all events of a kind would go to one task
