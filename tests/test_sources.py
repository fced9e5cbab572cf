"""Sources over small files."""

import json

from pyspark.sql import functions as F

from loomgraph.sources import questions, rolesets


def test_questions(spark, tmp_path):
    records = [
        {"id": "2hop__1_2", "question": " Who? ", "answer": "Ada", "answer_aliases": ["A. Lee", "Ada"], "paragraphs": [{"idx": 4, "title": " T ", "paragraph_text": "x ", "is_supporting": True}, {"wikipedia_title": "W", "text": "y"}]},
        {"id": "q2", "composed_question_text": "What?", "answer_text": "B", "answerable": False, "contexts": [{"title": "C"}]},
        {"id": "q3", "question": "", "answer": "C"},
        {"id": "", "question": "x", "answer": "C"},
        {"id": "q5", "question": "no answer"},
    ]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, records)) + '\n{"id": "q6", "ques')
    found = {r["id"]: r for r in questions.read_questions(spark, str(tmp_path / "q.jsonl"), unanswerable=True).collect()}
    assert set(found) == {"2hop__1_2", "q2"}
    first = found["2hop__1_2"]
    assert (first["question"], first["answer_aliases"], first["hops"], first["answerable"]) == ("Who?", ["Ada", "A. Lee"], 2, True)
    assert [tuple(p) for p in first["paragraphs"]] == [(4, "T", "x", True), (1, "W", "y", False)]
    only = questions.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert [r["id"] for r in only.collect()] == ["2hop__1_2"]
    assert [tuple(r) for r in questions.documents(only).select("source", "ord", "text").orderBy("ord").collect()] == [("para_4", 0, "x"), ("para_1", 1, "y")]


def test_resume(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "a", "em": 1.0}\n{"id": "b", "predicted": "x"}\n{"id": "c", "pre')
    done = questions.finished(spark, str(tmp_path / "p.jsonl"))
    assert sorted(r[0] for r in done.collect()) == ["a", "b"]
    left = questions.unfinished(spark.createDataFrame([("a",), ("c",)], "id string"), done)
    assert [r[0] for r in left.collect()] == ["c"]


def test_rolesets(spark, tmp_path):
    good = '<frameset><predicate lemma="found"><roleset id="found-1" name=" set up "><roles><role n="0" descr="founder"/><role n="m" descr="x"/><role n="1" descr=" thing "/></roles></roleset><roleset id="found" name="none"/></predicate></frameset>'
    (tmp_path / "a.xml").write_text(good)
    (tmp_path / "b.xml").write_text("<frameset><predicate")
    rows = rolesets.read_xml(spark, str(tmp_path)).collect()
    assert [(r["roleset_id"], r["lemma"], r["name"], r["roles"]) for r in rows] == [("found.01", "found", "set up", {":ARG0": "founder", ":ARG1": "thing"})]
    ids = spark.createDataFrame([("add_up.1",), ("co-write-02",), ("run",), (None,)], "r string").select(rolesets.canonical_id(F.col("r"))).collect()
    assert [r[0] for r in ids] == ["add_up.01", "co-write.02", "run", ""]
