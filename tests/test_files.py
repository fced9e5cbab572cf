"""Manifests, predictions, annotation sheets, a judge's answers, and report tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import file_queries
from loomgraph.sources import annotations, reports, runs
from loomgraph.storage import fresh_folder


def test_manifest_is_drawn_once(spark, tmp_path):
    q = spark.createDataFrame([(f"q{i}", i, i % 4 > 0) for i in range(40)], "id string, ord bigint, answerable boolean")
    path = str(tmp_path / "manifest")
    one = runs.manifest(spark, path, "r", q, 10, 13, 5, "c1").collect()[0]
    assert runs.manifest(spark, path, "r", q.limit(3), 10, 99, 5, "c1").collect()[0] == one
    assert one["dev_ids"] == sorted(f"q{i}" for i in (1, 2, 3, 5, 6)) and len(one["test_ids"]) == 10 and not set(one["dev_ids"]) & set(one["test_ids"])
    with pytest.raises(ValueError):
        runs.manifest(spark, path, "r", q, 10, 13, 5, "c2")
    dev, drawn = runs.draw_sample(q, 3, 1, 5, "dev")
    assert {r[0] for r in drawn.collect()} <= {r[0] for r in dev.collect()}


def test_errors_are_kept_and_broken_lines_dropped(spark, tmp_path):
    q = spark.createDataFrame([("a", "x"), ("b", "boom")], "id string, text string")

    def answer(row):
        if row["text"] == "boom":
            raise KeyError("boom")
        return row["text"].upper()

    got = {r["id"]: (r["predicted"], r["error"]) for r in runs.predicted(q, answer).collect()}
    assert got == {"a": ("X", None), "b": (None, "KeyError: 'boom'")}
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "part.json").write_text('{"id": "a", "predicted": "X"}\n{"id": "b", "pred')
    assert [r[0] for r in runs.compacted(spark, str(folder), "id string, predicted string").collect()] == ["a"]
    assert spark.read.text(str(folder)).count() == 1


def test_sizes_events_ablations_salvage(spark, tmp_path):
    (tmp_path / "db").write_bytes(b"x" * 10)
    (tmp_path / "db.wal").write_bytes(b"x" * 5)
    (tmp_path / "dbother").write_bytes(b"x" * 99)
    assert runs.stored_bytes(spark, str(tmp_path / "db")) == 15
    assert len({tuple(sorted(r[0].items())) for r in runs.synthetic_events(spark, 100).select("roles").collect()}) == 100
    assert runs.ablated("hub_pruning", "triples_only")["hub_pruning"] is False and runs.ablated("triples_only")["triples_only"] is True
    with pytest.raises(ValueError):
        runs.ablated("no_such")
    cut = '{"events": [{"lemma": "a", "roles": {}}, {"lemma": "b", "ro'
    df = spark.createDataFrame([(cut,), ("no json",), (None,), ('{"events": "x"}',)], "raw string")
    got = [r[0] for r in df.select(runs.salvaged_json("raw")).collect()]
    assert json.loads(got[0]) == {"events": [{"lemma": "a", "roles": {}}]} and got[1:] == [None, None, None]


PAYLOAD = {"events": [{"lemma": "found", "sense_id": "found.01", "roles": {":ARG0": "Ann"}, "time_context": {"raw_expression": "1990"}}, {"lemma": "run", "sense_id": "run.01", "roles": {}}]}


def sheet(spark):
    cache = spark.createDataFrame([("k1", json.dumps(PAYLOAD)), ("k2", '{"events": []}'), ("k3", "{}")], "key string, payload string")
    texts = spark.createDataFrame([("k1", "m", 'One, "two"\nlines'), ("k2", "m", "Two")], "key string, model string, text string")
    meanings = spark.createDataFrame([("found.01", {":ARG0": "founder"})], "sense_id string, meanings map<string,string>")
    return annotations.exported(cache, texts, 5, 1, meanings)


def test_sheet_goes_out_and_comes_back(spark, tmp_path):
    rows = sheet(spark)
    annotations.write_sheet(rows, str(tmp_path / "s"))
    back = annotations.read_sheet(spark, str(tmp_path / "s"))
    key = lambda df: sorted(tuple(r) for r in df.select(*annotations.FIELDS).collect())
    assert key(back) == key(rows)
    by = {(r["paragraph_key"], r["event_index"]): r for r in rows.collect()}
    assert set(by) == {("k1", "0"), ("k1", "1"), ("k2", "0")}
    assert by["k1", "0"]["role_meanings"] == '{":ARG0":"founder"}' and by["k1", "1"]["paragraph_text"] == "" and by["k2", "0"]["lemma"] == ""
    assert annotations.subset(rows, 1, 3).select("paragraph_key").distinct().count() == 1
    several = spark.createDataFrame([("k1", "m", "x"), ("k1", "n", "y")], "key string, model string, text string")
    with pytest.raises(ValueError):
        annotations.exported(spark.createDataFrame([("k1", "{}")], "key string, payload string"), several, 1, 1)


@pytest.mark.parametrize(
    "raw, errors",
    [
        ({"events": [{"index": 0, "event_correct": 1, "roles_correct": "1", "context_correct": True}, {"index": 1, "event_correct": "0", "roles_correct": 1}], "missed_facts": 2}, 0),
        ({"events": [{"index": 0, "event_correct": 1, "roles_correct": 1, "context_correct": 0}], "missed_facts": 0}, 1),
        ({"events": [{"index": 0, "event_correct": 0}, {"index": 0, "event_correct": 0}, {"index": 1, "event_correct": 0}], "missed_facts": 0}, 1),
        ({"events": [{"index": 0, "event_correct": 0}, {"index": 1, "event_correct": 0}, {"index": 7, "event_correct": 0}], "missed_facts": 0}, 1),
        ({"events": [{"index": 0, "event_correct": 2}, {"index": 1, "event_correct": 1}], "missed_facts": -1}, 3),
        ("nothing", 3),
    ],
)
def test_judgments_are_checked(spark, raw, errors):
    text = raw if isinstance(raw, str) else "```json\n" + json.dumps(raw) + "\n```"
    got = annotations.judged(spark.createDataFrame([("k1", text)], "paragraph_key string, raw string"), sheet(spark)).collect()
    if errors:
        assert len(got) == 1 and len(got[0]["errors"]) == errors
    else:
        by = {r["event_index"]: r for r in got}
        assert (by["0"]["roles_correct"], by["0"]["context_correct"], by["0"]["missed_facts"]) == (1, 1, 2)
        assert (by["1"]["event_correct"], by["1"]["roles_correct"], by["1"]["context_correct"]) == (0, None, None)


def test_rules_between_markers(spark):
    df = spark.createDataFrame([("a <<r>> the rules <<e>> b",), ("no <<r>> end",)], "t string")
    assert [r[0] for r in df.select(annotations.rules_between(F.col("t"), "<<r>>", "<<e>>")).collect()] == ["the rules", None]


def test_report_tables(spark, tmp_path):
    for system, hits in (("full", (1, 1, 1, 0)), ("base_1", (1, 0, 0, 0))):
        (tmp_path / system).mkdir()
        lines = [json.dumps({"id": f"q{i}", "em": float(h), "f1": float(h), "answerable": True, "refused": not h, "hops": 2, "failure_stage": "success" if h else "x", "usage": {"index_tokens": 10, "seconds": 2.0}}) for i, h in enumerate(hits)]
        (tmp_path / system / "predictions.jsonl").write_text("\n".join(lines))
    ids = spark.createDataFrame([(f"q{i}", i) for i in range(3)], "id string, place bigint")
    r = reports.flat(reports.load(spark, str(tmp_path), ids))
    assert r.count() == 6
    rows = {x["system"]: x for x in reports.main_table(r, "full", 50).collect()}
    assert rows["full"]["p"] == "ref." and rows["base_1"]["em"].startswith("33.3 [") and rows["base_1"]["p"] == "0.500"
    reports.write_table(reports.ablation_table(r, "full", 50), str(tmp_path / "out"), "tex")
    text = [x[0] for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert text[0].startswith("\\begin{tabular}") and text[-1] == "\\end{tabular}" and "base\\_1 & 3 & -66.7" in text[2]
    assert {x["n"] for x in reports.hops_table(r).collect()} == {3} and reports.failures_table(r).count() == 3 and reports.cost_table(r).count() == 2
    labelled = r.withColumn("label", F.lit("a"))
    both = spark.createDataFrame([("a", "q1"), ("b", "q2")], "label string, id string")
    with pytest.raises(ValueError):
        reports.models_table(labelled, both, "full", "base_1")
    assert reports.models_table(labelled, both.where("label = 'a'"), "full", "base_1").collect()[0]["d_em"] == "+66.7"


def test_frames_share_files(spark, sf, monkeypatch):
    """A file was written about each supplier, so that files, which take a while each, grew with the suppliers."""
    made = []
    monkeypatch.setattr(file_queries, "fresh_folder", lambda *a: made.append(fresh_folder(*a)) or made[-1])
    assert file_queries.s11_roleset_files(spark, sf).count() == 9
    assert len([f for f in os.listdir(made[0].removeprefix("file://") + "/xml") if f.startswith("part-")]) < 5
