"""What the graph queries' plans do once."""

import pytest
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators import evidence, graph
from loomgraph.plans import event_queries, fixture, graph_queries


def test_the_first_events_are_ranked_once_for_their_text(spark, sf):
    """The ranking, with all that it hangs on, stood in the plan twice: for the blocks and for the rows beside them."""
    plan = graph_queries.k2_evidence_budget(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 0


def test_events_that_come_with_their_members_are_not_put_together_again(spark, sf):
    """Triples and lines of events were grouped by event, a shuffle of the whole graph, though a row of the tables has all of an event."""
    for query in (graph_queries.e2a_triples, graph_queries.e2_rendered_events):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [graph_id" not in plan or "src_event" in plan.split("Aggregate [graph_id")[1].split("\n")[0]


def _graph(spark):
    row = "graph_id string, event_id string, ord bigint, lemma string, sense string, role string, entity string, name string"
    told = [("e1", "alias", "alias.01", "N", "a"), ("e2", "buy", "buy.01", "a", "b"), ("e3", "buy", "buy.01", "b", "c"), ("e4", "alias", "alias.01", "c", "C"), ("e5", "sell", "sell.01", "c", "d"), ("e6", "buy", "buy.01", "C", "x"), ("e7", "buy", "buy.01", "b", "hub")]
    told += [(f"h{i}", "buy", "buy.01", "hub", f"far{i}") for i in range(9)]
    said = [("g", e, i, lemma, sense, role, x, x.upper()) for i, (e, lemma, sense, first, second) in enumerate(told) for role, x in ((":ARG0", first), (":ARG1", second))]
    return spark.createDataFrame(said, row), spark.createDataFrame([("g", 1, "N"), ("g", 2, "a"), ("g", 3, "lost"), ("g", 4, "hub")], "graph_id string, question_id bigint, entity string")


def test_what_is_wanted_of_a_search_alone_is_the_same_as_with_the_rest(spark, monkeypatch):
    bindings, anchors = _graph(spark)
    got = lambda df, *columns: sorted(tuple(r) for r in df.select("question_id", *columns).collect())
    entities, events = graph.explore(bindings, anchors, 3, 5)
    assert got(graph.explore(graph.gathered(bindings), anchors, 3, 5, "entities")[0], "entity", "dist") == got(entities, "entity", "dist")
    monkeypatch.setattr(graph, "FEW_REACHED", 0)  # the graph is dealt by entity, where a level of few is sent to every task
    assert got(graph.explore(bindings, anchors, 3, 5, "events")[1], "event_id", "dist") == got(events, "event_id", "dist")
    assert {(x.question_id, x.event_id) for x in events.collect() if x.event_id.startswith("h")} == {(4, f"h{i}") for i in range(9)}
    shown = lambda df: got(df, "entity", graph.readable_path(), "dist")
    assert shown(graph.all_pathed(entities)) == shown(graph.pathed(entities, entities))
    with pytest.raises(ValueError):
        graph.explore(bindings, anchors, want="all")


def test_degrees_are_counted_for_the_asked_anchors_only(spark, sf):
    """Every entity of the graph was counted, though only the anchors' degrees are asked for."""
    plan = graph_queries.p8_specific_anchors(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("count(1)") :]


def test_glosses_of_few_lemmas_are_sent_to_the_events(spark, sf):
    """Events met their senses by lemma, so that all events of a lemma went to one task."""
    assert "hashpartitioning(lemma" not in event_queries.a7_disambiguated(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_a_task_gets_a_bounded_number_of_purchases(spark, sf, monkeypatch):
    """Degrees, nodes and anchors were counted over whole parts of the orders' file, with a task's memory growing with it."""
    monkeypatch.setattr(storage, "HELD_ROWS", 100)
    per_task = fixture.events(spark, sf).where("sense = 'buy.01'").groupBy(F.spark_partition_id()).count()
    assert per_task.agg(F.max("count")).first()[0] < 300


def test_nodes_are_told_apart_in_tasks_by_their_number(spark, sf, monkeypatch):
    """Event ids were exchanged in a fixed number of parts, so that what a task held grew with the graph."""
    monkeypatch.setattr(storage, "HELD_ROWS", 100)
    plan = graph_queries.g9_node_listing(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    most = fixture.most_events(spark, sf)
    assert "RepartitionByExpression [id#" in plan and f", {most // 100 + 1}" in plan
    assert most >= fixture.events(spark, sf).count()


def test_usual_roles_are_placed_without_patterns(spark):
    """Each member's role of each event went through two patterns."""
    roles = [":ARG0", ":ARG5", "ARG1", ":arg2", ":ARG6", ":ARGM-LOC", "argm-x", ":location", "", ":", "::ARG1"]
    got = spark.createDataFrame([(r,) for r in roles], "role string").select("role", evidence.role_place(F.col("role")).alias("at"))
    assert [x.at for x in got.collect()] == [0, 5, 1, 2, 20, 10, 10, 20, 20, 20, 20]
    assert "(role#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.index("= :ARG0)") < plan.index("RLIKE")
