"""Queries that go through files in the shared folder and come back: questions, predictions, sheets, catalogs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import answers
from loomgraph.functions import vocab as v
from loomgraph.operators import coerce, rewrite
from loomgraph.plans.text_queries import VALUES_SQL, lists, over_values
from loomgraph.session import table
from loomgraph.sources import annotations, questions, reports, rolesets, runs
from loomgraph.storage import fresh_folder

SEED = 13


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """A question a part, in the field names that files have, with paragraphs about it; some lack what makes a question."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    para = lambda at, title, wiki, long, short, good: F.struct(at.cast("string").alias("idx"), title.alias("title"), wiki.alias("wikipedia_title"), long.alias("paragraph_text"), short.alias("text"), good.alias("is_supporting"))
    none = F.lit(None).cast("string")
    both = F.array(
        para(F.when(k % 2 == 0, 10 + k % 7), F.concat(F.lit(" "), "p_name"), none, F.concat("p_type", F.lit(" ")), none, k % 3 == 0),
        para(F.lit(None).cast("int"), F.lit(""), F.col("p_brand"), none, F.col("p_name"), F.lit(None).cast("boolean")),
    )
    said = F.concat(F.lit(" Who made the "), "p_name", F.lit("? "))
    return p.select(
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(1 + k % 4, F.lit("hop__"), k, F.lit("_1"))).alias("id"), F.when(k % 2 == 0, said).alias("question"), F.when(k % 2 == 1, said).alias("composed_question_text"),
        F.when(k % 3 == 0, F.col("p_brand")).alias("answer"), F.when(k % 3 == 1, F.col("p_brand")).alias("answer_text"), F.array(F.col("p_type"), F.col("p_brand"), none).alias("answer_aliases"), F.when(k % 5 == 0, False).alias("answerable"), F.lit(None).cast("array<string>").alias("question_decomposition"),
        F.when(k % 4 < 2, both).alias("paragraphs"), F.when(k % 4 == 2, both).alias("contexts"), k.alias("ord"),
    )


def _files(spark: SparkSession, sf: str) -> str:
    """The questions as a folder of JSON lines, and in it lines that broke off."""
    path = fresh_folder(spark, "questions") + "/lines"
    whole = _asked(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    broken = table(spark, sf, "nation").select(F.concat(F.lit('{"id": "broken'), "n_nationkey", F.lit('", "ques')).alias("value"))
    whole.unionByName(broken).write.text(path)
    return path


def s7_question_files(spark: SparkSession, sf: str) -> DataFrame:
    found = questions.read_questions(spark, _files(spark, sf), unanswerable=True)
    return found.select("id", "question", "answer", F.array_join("answer_aliases", "|").alias("aliases"), F.size("paragraphs").alias("n_paragraphs"), "answerable", "hops")


def s9_question_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of the answerable questions."""
    return questions.documents(questions.read_questions(spark, _files(spark, sf)))


def s8_first_answerable(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred answerable questions."""
    found = questions.normalized(_asked(spark, sf)).join(_asked(spark, sf).select("id", "ord"), "id")
    return runs.first_answerable(found, 100).select("id", "ord")


def s17_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A run's manifest, drawn once and then read."""
    found = questions.normalized(_asked(spark, sf)).join(_asked(spark, sf).select("id", "ord"), "id")
    path = fresh_folder(spark, "manifest") + "/rows"
    drawn = lambda: runs.manifest(spark, path, "first", found, 60, SEED, 40, "config")
    once, again = drawn(), drawn()
    every = once.unionByName(again).distinct()
    return every.select("run", "seed", "pool", "config", F.explode(F.concat(F.transform("dev_ids", lambda x: F.struct(F.lit("dev").alias("side"), x.alias("id"))), F.transform("test_ids", lambda x: F.struct(F.lit("test").alias("side"), x.alias("id"))))).alias("x")).select("run", "seed", "pool", "config", "x.side", "x.id")


def _answered(row: dict) -> str:
    if row["id"].startswith("3"):
        raise KeyError(row["id"])
    return row["answer"].upper()


def s18_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions in two runs, of which the second makes what the first left; errors are kept."""
    found = questions.normalized(_asked(spark, sf))
    path = fresh_folder(spark, "predictions") + "/rows"
    first = found.where("hops < 3")
    for batch in (first, found):
        left = questions.unfinished(batch, questions.finished(spark, path)) if batch is found else batch
        questions.append_predictions(runs.predicted(left.select("id", "answer"), _answered), path)
    return spark.read.schema("id string, predicted string, error string").json(path)


def s19_finished(spark: SparkSession, sf: str) -> DataFrame:
    """Finished ids of a prediction folder with lines that broke off, which a rewrite drops."""
    path = fresh_folder(spark, "finished") + "/rows"
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    line = F.to_json(F.struct(F.concat(F.lit("q"), k).alias("id"), F.col("p_name").alias("predicted")))
    p.select(F.when(k % 6 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    done = runs.compacted(spark, path, "id string, predicted string")
    return done.join(spark.read.text(path).agg(F.count("*").alias("n_lines")))  # one row


def s20_run_files(spark: SparkSession, sf: str) -> DataFrame:
    """What a run writes, as it is read again: rows and characters by file."""
    p = table(spark, sf, "part")
    path = fresh_folder(spark, "run")
    gold, said = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("answer")), p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("predicted"))
    runs.write_run(path, said, gold, gold.agg(F.count("*").alias("n")), said.join(gold, "id").where("id % 2 = 0"))
    out = None
    for name in ("predictions", "gold", "metrics", "cases"):
        one = spark.read.text(f"{path}/{name}").agg(F.lit(name).alias("file"), F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))
        out = one if out is None else out.unionByName(one)
    return out


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet of a hundred suppliers' extractions: two events, one, or none."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    event = lambda lemma, other: F.struct(F.lit(lemma).alias("lemma"), F.lit(f"{lemma}.01").alias("sense_id"), F.create_map(F.lit(":ARG0"), F.col("s_name"), F.lit(":ARG1"), other).alias("roles"), F.when(k % 2 == 0, F.create_map(F.lit("raw_expression"), F.lit("1999"))).alias("time_context"))
    events = F.when(k % 3 == 0, F.array(event("sell", F.lit("a \"thing\", of 1")), event("found", F.lit("Hall")))).when(k % 3 == 1, F.array(event("found", F.lit("Hall")))).otherwise(F.slice(F.array(event("sell", F.lit(""))), 1, 0))
    cache = s.select(F.concat(F.lit("p"), k).alias("key"), F.to_json(F.struct(events.alias("events"))).alias("payload"))
    texts = s.select(F.concat(F.lit("p"), k).alias("key"), F.lit("m").alias("model"), F.concat(F.lit("About\n\""), "s_name", F.lit("\", x")).alias("text"))
    meanings = spark.createDataFrame([("found.01", {":ARG0": "founder"})], "sense_id string, meanings map<string,string>")
    return annotations.exported(cache, texts, 100, SEED, meanings)


def s21_annotation_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf)


def s23_sheet_read(spark: SparkSession, sf: str) -> DataFrame:
    """The sheet after it was written as CSV and read."""
    path = fresh_folder(spark, "sheet") + "/rows"
    annotations.write_sheet(_sheet(spark, sf), path)
    return annotations.read_sheet(spark, path)


def s22_sheet_subset(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of thirty paragraphs of it."""
    return annotations.subset(_sheet(spark, sf), 30, 5).select("paragraph_key", "event_index", "lemma")


def s25_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What stands between two markers."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    text = F.concat(F.lit("Intro "), F.when(k % 3 != 0, "<<rules>> ").otherwise(""), "p_name", F.lit(" \n"), F.when(k % 4 != 0, "<<end>> more").otherwise(""), F.when(k % 5 == 0, " <<end>>").otherwise(""))
    return p.select("p_partkey", annotations.rules_between(text, "<<rules>>", "<<end>>").alias("rules"))


def c17_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """A judge's answers about the sheet, of which many break a rule."""
    sheet = _sheet(spark, sf)
    k = F.regexp_extract("paragraph_key", r"(\d+)", 1).cast("int")
    keys = sheet.groupBy("paragraph_key").agg(F.count_if(F.col("lemma") != "").alias("n"))
    item = lambda i, ok, roles: F.struct(F.lit(i).alias("index"), ok.alias("event_correct"), roles.alias("roles_correct"), F.lit("1").alias("context_correct"))
    own = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < F.col("n")), lambda i: F.struct(i.alias("index"), F.lit(1).alias("event_correct"), F.lit(1).alias("roles_correct"), F.lit("1").alias("context_correct")))
    listed = F.when(k % 7 == 1, F.concat(own, F.array(item(9, F.lit(0), F.lit(0))))).when(k % 7 == 2, F.concat(own, own)).when(k % 7 == 3, F.transform(own, lambda e: e.withField("event_correct", F.lit(2)))).when(k % 7 == 4, F.transform(own, lambda e: e.withField("event_correct", F.lit(0)))).otherwise(own)
    raw = F.when(k % 7 == 5, F.lit("nothing")).otherwise(F.to_json(F.struct(listed.alias("events"), F.when(k % 7 == 6, F.lit(-1)).otherwise(k % 4).alias("missed_facts"))))
    return annotations.judged(keys.select("paragraph_key", raw.alias("raw")), sheet).withColumn("errors", F.array_join("errors", "; "))


def c18_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, truth values and texts as judgments."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    text = F.when(k % 5 == 0, (k % 3).cast("string")).when(k % 5 == 1, F.when(k % 2 == 0, "true").otherwise("false")).when(k % 5 == 2, F.concat(F.lit('" '), k % 3, F.lit('"'))).when(k % 5 == 3, "null").otherwise('{"a": 1}')
    return p.select("p_partkey", annotations.binary(F.parse_json(text)).alias("judgment"))


def c15_salvaged(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of the orders that broke off, with the events that are whole."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    one = lambda name: F.concat(F.lit('{"temp_id": "'), F.lit(name), k, F.lit('", "lemma": "buy", "roles": {":ARG0": "a } \\" b"}}'))
    head, first, second = F.lit('Sure: {"events": ['), one("x"), one("y")
    whole = F.concat(head, first, F.lit(", "), second)
    raw = F.when(k % 4 == 0, F.concat(whole, F.lit('], "discourse": []}'))).when(k % 4 == 1, F.substring(whole, F.lit(1), F.length(whole) - 3 - k % 20)).when(k % 4 == 2, F.substring(whole, F.lit(1), F.length(head) + 8 + k % 20)).otherwise(F.concat(whole, F.lit('], "discourse": [{"source": "x"')))
    events = coerce.events_of(o.select("o_orderkey", runs.salvaged_json(raw).alias("raw")))
    return events.select("o_orderkey", "event_ord", "temp_id", F.element_at("roles", ":ARG0").alias("agent"))


def c11_null_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads whose lists are null, empty, missing or there."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    event = '{"lemma": "buy", "roles": {"ARG0": "x"}}'
    raw = F.when(k % 4 == 0, '{"events": null, "discourse": null}').when(k % 4 == 1, '{"events": [], "discourse": []}').when(k % 4 == 2, f'{{"events": [{event}, null, 3]}}').otherwise(f'{{"events": [{event}], "discourse": null}}')
    rows = o.select("o_orderkey", raw.alias("raw"))
    events = coerce.events_of(rows).groupBy("o_orderkey").agg(F.count("*").alias("n_events"))
    links = coerce.discourse_of(rows).groupBy("o_orderkey").agg(F.count("*").alias("n_links"))
    both = o.select("o_orderkey").join(events, "o_orderkey", "left").join(links, "o_orderkey", "left")
    return both.fillna(0, ["n_events", "n_links"])


def s11_roleset_files(spark: SparkSession, sf: str) -> DataFrame:
    """Frames about each supplier, written as XML files and read, beside files that aren't XML."""
    path = fresh_folder(spark, "frames") + "/xml"
    p, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    ends = F.when(k % 3 == 0, F.concat(F.lit("."), k % 100)).when(k % 3 == 1, F.concat(F.lit("-"), k % 9)).otherwise("")
    xml = F.concat(F.lit("<frameset><predicate><roleset id=\"verb_"), k, ends, F.lit("\" name=\" "), "s_name", F.lit(" \"><roles><role n=\"0\" descr=\" maker \"/><role n=\"m\" descr=\"no\"/><role n=\"2\" descr=\""), "s_name", F.lit("\"/></roles></roleset></predicate></frameset>"))
    each = p.select(F.when(k % 10 == 9, "<frameset><predicate").otherwise(xml).alias("xml"), (k % 10 == 9).alias("broken"), F.floor(k / 500).alias("file"))
    # some hundred framesets a file: a file a supplier takes longer to write, list and open than to read
    whole = each.groupBy("broken", "file").agg(F.concat(F.lit("<frames>"), F.concat_ws("", F.collect_list("xml")), F.lit("</frames>")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return rolesets.read_xml(spark, path).select("roleset_id", "lemma", "name", F.array_join(F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ").alias("roles"))


def s12_catalog_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog's cache, asked for its own commit and for another one."""
    path = fresh_folder(spark, "cache") + "/rows"
    p = table(spark, sf, "part").select(F.concat("p_name", F.lit("."), "p_partkey").alias("roleset_id"), "p_name")
    rolesets.write_cache(p, path, "abc")
    asked = [rolesets.read_cache(spark, path, commit).groupBy("p_name").agg(F.count("*").alias("n")).withColumn("commit", F.lit(commit)) for commit in ("abc", "other")]
    return asked[0].unionByName(asked[1])


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Two systems' records of every part, written as a run leaves them, and loaded."""
    path = fresh_folder(spark, "report")
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    for n, system in enumerate(("full", "base_1")):
        em = ((k + n) % 3 > n).cast("double")
        usage = F.struct((k % 50).cast("double").alias("index_tokens"), (k % 7).cast("double").alias("query_tokens"), (k % 57).cast("double").alias("total_tokens"), F.lit(1.5).alias("index_seconds"), F.lit(0.5).alias("query_seconds"), F.lit(2.0).alias("seconds"))
        stage = F.when(em == 1, "success").when(k % 2 == 0, "partial").otherwise("refusal_in_evidence")
        p.select(F.concat(F.lit("q"), k).alias("id"), em.alias("em"), em.alias("f1"), F.lit(True).alias("answerable"), (em == 0).alias("refused"), stage.alias("failure_stage"), (2 + k % 3).cast("int").alias("hops"), usage.alias("usage")).write.json(f"{path}/{system}/predictions.jsonl")
    ids = p.where("p_partkey % 4 <> 3").select(F.concat(F.lit("q"), k).alias("id"), k.alias("place"))
    return reports.load(spark, path, ids)


def s26_report_records(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("system", "id", "place", "em", "hops", "failure_stage")


def t1_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Hops, costs and failures as lines of Markdown and TeX files."""
    flat, path, out = reports.flat(_records(spark, sf)), fresh_folder(spark, "tables"), None
    for name, rows in (("hops", reports.hops_table(flat)), ("cost", reports.cost_table(flat)), ("failures", reports.failures_table(flat))):
        for style in ("markdown", "tex"):
            reports.write_table(rows, f"{path}/{name}.{style}", style)
            one = spark.read.text(f"{path}/{name}.{style}").select(F.lit(name).alias("table_name"), F.lit(style).alias("style"), F.col("value").alias("line"))
            out = one if out is None else out.unionByName(one)
    return out


def t2_models(spark: SparkSession, sf: str) -> DataFrame:
    """Two configurations, over the same questions."""
    flat = reports.flat(_records(spark, sf))
    number = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    second = flat.withColumn("em", F.when(number % 6 == 0, 0.0).otherwise(F.col("em")))
    both = flat.withColumn("label", F.lit("small")).unionByName(second.withColumn("label", F.lit("large")))
    return reports.models_table(both, both.select("label", "id"), "full", "base_1")


def s28_synthetic_events(spark: SparkSession, sf: str) -> DataFrame:
    """As many storage events as there are customers."""
    made = runs.synthetic_events(spark, table(spark, sf, "customer").count())
    return made.select("event_id", "sense_id", F.element_at("roles", ":ARG0").alias("institution"), F.element_at("roles", ":ARG1").alias("researcher"), "time_context.start_year", F.col("spatial_context.location_name").alias("city"), "epistemic_context.confidence")


def f36_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Characters that fit contexts of many sizes."""
    p = table(spark, sf, "part")
    context = F.col("p_partkey") * 37 % 16384
    return p.select("p_partkey", answers.fitting_chars(context, F.lit(2048)).alias("chars"))


def p6_self_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Events of customers with themselves, by name or by another spelling."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    own = F.concat(F.lit("Customer "), k)
    other = F.when(k % 3 == 0, F.concat(F.lit("the customer "), k)).otherwise(F.concat(F.lit("Customer "), k + 1))
    sense = F.when(k % 2 == 0, "marry.01").otherwise("meet.01")
    events = c.select(k.alias("event_id"), F.split_part(sense, F.lit("."), F.lit(1)).alias("lemma"), sense.alias("sense_id"), F.create_map(F.lit(":ARG0"), own, F.lit(":ARG1"), other, F.lit(":ARG2"), F.upper(own), F.lit(":manner"), own).alias("roles"))
    return rewrite.drop_self_relations(events).select("event_id", F.array_join(F.array_sort(F.map_keys("roles")), " ").alias("kept"))


def p9_possessors(spark: SparkSession, sf: str) -> DataFrame:
    """Owners in "X's Y" that count as entities: abbreviations, known ones, and those that the text has alone."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    owner = F.when(k % 4 == 0, "ACME").when(k % 4 == 1, "Harbor").when(k % 4 == 2, "Lowland").otherwise("Oslo")
    text = F.when(k % 8 < 4, "There lies Oslo now. Port Lowland's Hall stands.").otherwise("It rained in Lowland, at Port Oslo too.")
    none = F.array().cast("array<struct<lemma:string,sense_id:string,roles:map<string,string>>>")
    events = c.select(k.alias("event_id"), F.create_map(F.lit(":ARG1"), F.concat(owner, F.lit("'s Town Hall"))).alias("roles"), text.alias("_text"), none.alias("derived"))
    known = spark.createDataFrame([("harbor",)], "key string")
    done = rewrite.associate_possessors(events, None, F.col("_text"), known)
    return done.select("event_id", F.array_join(F.transform("derived", lambda d: F.element_at(d["roles"], ":ARG0")), "|").alias("owners"))


QUERIES = {f.__name__: f for f in (s7_question_files, s9_question_documents, s8_first_answerable, s17_manifest, s18_predictions, s19_finished, s20_run_files, s21_annotation_sheet, s22_sheet_subset, s23_sheet_read, s25_rules, c17_judgments, c18_binary, c15_salvaged, c11_null_lists, s11_roleset_files, s12_catalog_cache, s26_report_records, t1_report_lines, t2_models, s28_synthetic_events, f36_budgets, p6_self_relations, p9_possessors)} | {
    "c8_role_slots": over_values(slot=lambda c: coerce.role_slot(F.concat(F.lit(":"), F.lower(c)))),
    "c19_roleset_ids": over_values(roleset=rolesets.canonical_id, lemma=lambda c: F.regexp_replace(rolesets.canonical_id(c), r"\.[^.]*$", "")),
}

_ASKED = """asked AS (SELECT p_partkey AS k, (1 + p_partkey % 4) || 'hop__' || p_partkey || '_1' AS id, 'Who made the ' || p_name || '?' AS question, p_brand, p_type, p_name, p_partkey % 5 <> 0 AS answerable, 1 + p_partkey % 4 AS hops FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 3 < 2)"""
_SAMPLE = "ORDER BY md5('{seed}:' || {key}), {key} LIMIT {n}"
_SHEET = f"""chosen AS (SELECT s_suppkey AS k, s_name, 'p' || s_suppkey AS key FROM supplier {_SAMPLE.format(seed=SEED, key="('p' || s_suppkey)", n=100)}),
each AS (SELECT *, 0 AS i, CASE k % 3 WHEN 0 THEN 'sell' WHEN 1 THEN 'found' ELSE '' END AS lemma FROM chosen UNION ALL SELECT *, 1, 'found' FROM chosen WHERE k % 3 = 0),
sheet AS (SELECT key AS paragraph_key, CASE WHEN i = 0 THEN 'About' || chr(10) || '"' || s_name || '", x' ELSE '' END AS paragraph_text, CAST(i AS VARCHAR) AS event_index, lemma, CASE WHEN lemma = '' THEN '' ELSE lemma || '.01' END AS sense_id,
  CASE lemma WHEN '' THEN '' WHEN 'sell' THEN '{{":ARG0":"' || s_name || '",":ARG1":"a \\"thing\\", of 1"}}' ELSE '{{":ARG0":"' || s_name || '",":ARG1":"Hall"}}' END AS roles, CASE WHEN lemma = 'found' THEN '{{":ARG0":"founder"}}' ELSE '' END AS role_meanings,
  CASE WHEN lemma <> '' AND k % 2 = 0 THEN '{{"raw_expression":"1999"}}' ELSE '' END AS time, '' AS place, '' AS event_correct, '' AS roles_correct, '' AS context_correct, '' AS missed_facts, k FROM each)"""
_RECORDS = " UNION ALL ".join(
    f"SELECT '{system}' AS system, 'q' || p_partkey AS id, p_partkey AS place, CASE WHEN (p_partkey + {n}) % 3 > {n} THEN 1.0 ELSE 0.0 END AS em, CAST(2 + p_partkey % 3 AS INTEGER) AS hops, CASE WHEN (p_partkey + {n}) % 3 > {n} THEN 'success' WHEN p_partkey % 2 = 0 THEN 'partial' ELSE 'refusal_in_evidence' END AS failure_stage FROM part WHERE p_partkey % 4 <> 3"
    for n, system in enumerate(("full", "base_1"))
)
_TEX = lambda x: f"replace({x}, '_', '\\_')"
_LINES = f"""records AS ({_RECORDS}), cells AS (
  SELECT 'hops' AS table_name, [system, CAST(hops AS VARCHAR), CAST(count(*) AS VARCHAR), printf('%.1f', 100 * avg(em)), printf('%.1f', 100 * avg(em))] AS c FROM records GROUP BY system, hops
  UNION ALL SELECT 'cost', [system, printf('%.0f', avg(place % 50)), printf('%.0f', avg(place % 7)), '1.5', '0.5'] FROM records GROUP BY system
  UNION ALL SELECT 'failures', [system, failure_stage, CAST(count(*) AS VARCHAR)] FROM records GROUP BY system, failure_stage),
heads AS (SELECT 'hops' AS table_name, ['system', 'hops', 'n', 'em', 'f1'] AS c UNION ALL SELECT 'cost', ['system', 'index tokens', 'query tokens', 'index seconds', 'query seconds'] UNION ALL SELECT 'failures', ['system', 'failure stage', 'n'])
SELECT table_name, 'markdown' AS style, '| ' || array_to_string(c, ' | ') || ' |' AS line FROM (SELECT * FROM cells UNION ALL SELECT * FROM heads) UNION ALL SELECT table_name, 'markdown', '|' || repeat('---|', len(c)) FROM heads
UNION ALL SELECT table_name, 'tex', array_to_string(list_prepend({_TEX('c[1]')}, c[2:]), ' & ') || ' \\\\' FROM cells UNION ALL SELECT table_name, 'tex', array_to_string(c, ' & ') || ' \\\\' FROM heads
UNION ALL SELECT table_name, 'tex', '\\begin{{tabular}}{{l' || repeat('r', len(c) - 1) || '}}' FROM heads UNION ALL SELECT table_name, 'tex', '\\end{{tabular}}' FROM heads"""
_SLOT = "CASE " + " ".join(f"WHEN lower(v) IN {lists(names)} THEN '{role}'" for role, names in v.ROLE_ALIASES.items()) + " END"
ORACLES = {
    "s7_question_files": f"WITH {_ASKED} SELECT id, question, p_brand AS answer, p_brand || '|' || p_type AS aliases, CASE WHEN k % 4 < 3 THEN 2 ELSE 0 END AS n_paragraphs, answerable, hops FROM asked",
    "s9_question_documents": f"""WITH {_ASKED} SELECT id AS graph_id, 'para_' || CASE WHEN k % 2 = 0 THEN 10 + k % 7 ELSE 0 END AS source, 0 AS ord, p_name AS title, p_type AS text, k % 3 = 0 AS is_supporting FROM asked WHERE answerable AND k % 4 < 3
  UNION ALL SELECT id, 'para_1', 1, p_brand, p_name, false FROM asked WHERE answerable AND k % 4 < 3""",
    "s8_first_answerable": f"WITH {_ASKED} SELECT id, k AS ord FROM asked WHERE answerable ORDER BY k LIMIT 100",
    "s17_manifest": f"""WITH {_ASKED}, dev AS (SELECT id FROM asked WHERE answerable ORDER BY k LIMIT 40), drawn AS (SELECT id FROM asked WHERE id NOT IN (SELECT id FROM dev) {_SAMPLE.format(seed=SEED, key='id', n=60)})
  SELECT 'first' AS run, {SEED} AS seed, 'test' AS pool, 'config' AS config, side, id FROM (SELECT 'dev' AS side, id FROM dev UNION ALL SELECT 'test', id FROM drawn)""",
    "s18_predictions": f"WITH {_ASKED} SELECT id, CASE WHEN hops <> 3 THEN upper(p_brand) END AS predicted, CASE WHEN hops = 3 THEN 'KeyError: ''' || id || '''' END AS error FROM asked",
    "s19_finished": "SELECT 'q' || p_partkey AS id, (SELECT count(*) FROM part WHERE p_partkey % 6 <> 0) AS n_lines FROM part WHERE p_partkey % 6 <> 0",
    "s20_run_files": """SELECT 'predictions' AS file, count(*) AS n, sum(length('{"id":' || p_partkey || ',"predicted":"' || p_brand || '"}')) AS chars FROM part UNION ALL SELECT 'gold', count(*), sum(length('{"id":' || p_partkey || ',"answer":"' || p_name || '"}')) FROM part
  UNION ALL SELECT 'metrics', 1, length('{"n":' || count(*) || '}') FROM part UNION ALL SELECT 'cases', count(*), sum(length('{"id":' || p_partkey || ',"predicted":"' || p_brand || '","answer":"' || p_name || '"}')) FROM part WHERE p_partkey % 2 = 0""",
    "s21_annotation_sheet": f"WITH {_SHEET} SELECT * EXCLUDE (k) FROM sheet",
    "s23_sheet_read": f"WITH {_SHEET} SELECT * EXCLUDE (k) FROM sheet",
    "s22_sheet_subset": f"WITH {_SHEET}, few AS (SELECT DISTINCT paragraph_key AS p FROM sheet {_SAMPLE.format(seed=5, key='p', n=30)}) SELECT paragraph_key, event_index, lemma FROM sheet WHERE paragraph_key IN (SELECT p FROM few)",
    "s25_rules": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND (p_partkey % 4 <> 0 OR p_partkey % 5 = 0) THEN p_name END AS rules FROM part",
    "c17_judgments": f"""WITH {_SHEET}, own AS (SELECT *, CAST(event_index AS INTEGER) AS i FROM sheet WHERE lemma <> ''), keys AS (SELECT DISTINCT paragraph_key, k FROM sheet),
  faults AS (
    SELECT paragraph_key, 'no JSON object in the response' AS error, 0 AS o FROM keys WHERE k % 7 = 5
    UNION ALL SELECT paragraph_key, 'missed_facts must be a non-negative integer', 1 FROM keys WHERE k % 7 = 6
    UNION ALL SELECT paragraph_key, 'unknown event index 9', 2 FROM keys WHERE k % 7 = 1 UNION ALL SELECT paragraph_key, 'event judged twice: ' || i, 2 FROM own WHERE k % 7 = 2
    UNION ALL SELECT paragraph_key, 'event_correct must be 0 or 1: ' || i, 2 FROM own WHERE k % 7 = 3 UNION ALL SELECT paragraph_key, 'event not judged: ' || i, 2 FROM own WHERE k % 7 = 5),
  wrong AS (SELECT paragraph_key, string_agg(error, '; ' ORDER BY o, error) AS errors FROM faults GROUP BY 1)
  SELECT paragraph_key, '' AS errors, CAST(keys.k % 4 AS INTEGER) AS missed_facts, event_index, CASE WHEN lemma IS NOT NULL THEN CASE WHEN keys.k % 7 = 4 THEN 0 ELSE 1 END END AS event_correct, CASE WHEN lemma IS NOT NULL AND keys.k % 7 <> 4 THEN 1 END AS roles_correct,
    CASE WHEN lemma IS NOT NULL AND keys.k % 7 <> 4 AND time <> '' THEN 1 END AS context_correct FROM keys LEFT JOIN own USING (paragraph_key) WHERE paragraph_key NOT IN (SELECT paragraph_key FROM wrong)
  UNION ALL SELECT paragraph_key, errors, NULL, NULL, NULL, NULL, NULL FROM wrong""",
    "c18_binary": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 3 END WHEN 1 THEN 1 - p_partkey % 2 WHEN 2 THEN CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 3 END END AS judgment FROM part",
    "c15_salvaged": """SELECT o_orderkey, 0 AS event_ord, 'x' || o_orderkey AS temp_id, 'a } " b' AS agent FROM orders WHERE o_orderkey % 4 <> 2 UNION ALL SELECT o_orderkey, 1, 'y' || o_orderkey, 'a } " b' FROM orders WHERE o_orderkey % 4 IN (0, 3)""",
    "c11_null_lists": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 0 ELSE 1 END AS n_events, 0 AS n_links FROM orders",
    "s11_roleset_files": """WITH ids AS (SELECT s_name, s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'verb_' || s_suppkey WHEN 1 THEN 'verb_' || s_suppkey WHEN 2 THEN CASE WHEN s_suppkey < 100 THEN 'verb' END END AS lemma, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey % 100 WHEN 1 THEN s_suppkey % 9 ELSE s_suppkey END AS n FROM supplier WHERE s_suppkey % 10 <> 9)
  SELECT lemma || '.' || lpad(n::VARCHAR, 2, '0') AS roleset_id, lemma, s_name AS name, ':ARG0=maker; :ARG2=' || s_name AS roles FROM ids WHERE lemma IS NOT NULL""",
    "s12_catalog_cache": "SELECT p_name, count(*) AS n, 'abc' AS commit FROM part GROUP BY 1",
    "s26_report_records": _RECORDS,
    "t1_report_lines": f"WITH {_LINES}",
    "t2_models": f"""WITH records AS ({_RECORDS}), labelled AS (SELECT 'small' AS label, * FROM records UNION ALL SELECT 'large' AS label, * REPLACE (CASE WHEN place % 6 = 0 THEN 0.0 ELSE em END AS em) FROM records), f1s AS (SELECT b.*, r.em AS f1 FROM labelled b JOIN records r USING (system, id))
  SELECT label, printf('%.1f', 100 * avg(em) FILTER (system = 'full')) AS em, printf('%.1f', 100 * avg(f1) FILTER (system = 'full')) AS f1, printf('%.1f', 100 * avg(em) FILTER (system = 'base_1')) AS against_em, printf('%+.1f', 100 * avg(em) FILTER (system = 'full') - 100 * avg(em) FILTER (system = 'base_1')) AS d_em FROM f1s GROUP BY 1""",
    "s28_synthetic_events": "SELECT 'ev_' || i AS event_id, 'employ.01' AS sense_id, 'Institution_' || i % 20 AS institution, 'Researcher_' || i AS researcher, 2000 + i % 25 AS start_year, 'City_' || i % 10 AS city, 0.95::DOUBLE AS confidence FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS i)",
    "f36_budgets": "SELECT p_partkey, greatest(2000, CAST(floor((p_partkey * 37 % 16384 - 2048 - 700) * 3.5) AS BIGINT)) AS chars FROM part",
    "p6_self_relations": "SELECT c_custkey AS event_id, CASE WHEN c_custkey % 3 = 0 THEN ':ARG1 :manner' ELSE ':ARG1 :ARG2 :manner' END AS kept FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 3 = 0)",
    "p9_possessors": "SELECT c_custkey AS event_id, CASE c_custkey % 4 WHEN 0 THEN 'ACME' WHEN 1 THEN 'Harbor' WHEN 2 THEN CASE WHEN c_custkey % 8 >= 4 THEN 'Lowland' ELSE '' END ELSE CASE WHEN c_custkey % 8 < 4 THEN 'Oslo' ELSE '' END END AS owners FROM customer",
    "c8_role_slots": VALUES_SQL + f"SELECT v, coalesce(CASE WHEN regexp_full_match(':' || lower(v), ':arg(?:[0-5]|m-[a-z]+)') THEN ':' || upper(v) WHEN ':' || lower(v) IN {lists(v.CONTEXT_ROLES)} THEN ':' || lower(v) END, {_SLOT}) AS slot FROM vals",
    "c19_roleset_ids": VALUES_SQL + "SELECT v, CASE WHEN n = '' THEN low ELSE regexp_replace(low, '[._-]\\d{1,2}$', '') || '.' || lpad(n, 2, '0') END AS roleset, regexp_replace(CASE WHEN n = '' THEN low ELSE regexp_replace(low, '[._-]\\d{1,2}$', '') || '.' || lpad(n, 2, '0') END, '\\.[^.]*$', '') AS lemma FROM (SELECT v, lower(trim(v)) AS low, regexp_extract(lower(trim(v)), '[._-](\\d{1,2})$', 1) AS n FROM vals)",
}
