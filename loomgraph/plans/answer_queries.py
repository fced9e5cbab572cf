"""Queries of answers, scores, comparisons, costs and annotations, over cases made of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import answers as a
from loomgraph.operators import metrics
from loomgraph.plans.evaluation_queries import interval_sql, means_sql, paired_sql
from loomgraph.session import table
from loomgraph.storage import spread

#: Answers as models give them; {} is the true one.
FORMS = (
    "{}", "The {}.", "ANSWER: {}", "\"{}\"", "unknown", "", "Based on the evidence, {}", "STATUS: NOT_IN_EVIDENCE", "the answer is: {}", "{}, Texas", "Unknown Pleasures", "{} Inc.", "<entity name>", "no evidence of it",
    "It is not stated", "I don't have that", "{} of the North Sea, Europe",
)
QUESTIONS = ("Who made it?", "In which state is it?", "Which county holds it?")


def _form(i, given):
    out = F.lit(FORMS[-1])
    for n, form in enumerate(FORMS[:-1]):
        out = F.when(i == n, form).otherwise(out)
    return F.replace(out, F.lit("{}"), given)


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """A case a part: what two systems say of its name, brand and type."""
    p, i = spread(table(spark, sf, "part")), F.col("p_partkey")
    question = F.when(i % 3 == 0, QUESTIONS[0]).when(i % 3 == 1, QUESTIONS[1]).otherwise(QUESTIONS[2])
    return p.select(
        i.alias("id"), question.alias("question"), F.col("p_name").alias("answer"), F.array("p_brand", F.concat(F.lit("the "), "p_type")).alias("more"), (F.col("p_size") % 5 != 0).alias("answerable"),
        _form(i % len(FORMS), F.when(i % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand"))).alias("raw"), _form((i + 3) % len(FORMS), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("other"),
        F.concat(F.lit("Found: "), F.when(i % 4 < 2, F.col("p_name")).otherwise(F.col("p_type")), F.lit(", it says.")).alias("evidence"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
    )


def _scored(spark, sf, said: str):
    c = cases(spark, sf).withColumn("predicted", F.coalesce(a.clean_answer(F.col(said), F.col("question")), F.lit("")))
    return c.withColumn("s", a.score(F.col("predicted"), F.concat(F.array("answer"), "more"), F.col("answerable")))


def f30_clean_answer(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", a.clean_answer(F.col("raw"), F.col("question")).alias("answer"))


def f31_final_answer(spark: SparkSession, sf: str) -> DataFrame:
    """The last of several answer lines."""
    text = F.concat(F.lit("Thinking.\nANSWER: first\nthen\n  final answer : "), "raw", F.when(F.col("id") % 7 == 0, F.lit("\nno line")).otherwise(F.lit("\n")))
    return cases(spark, sf).select("id", a.final_answer(F.when(F.col("id") % 5 == 0, F.col("evidence")).otherwise(text), F.col("question")).alias("answer"))


def f32_snapped(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in the form of the evidence's names."""
    names = F.array(F.initcap("answer"), F.element_at("more", 1), F.concat("answer", F.lit(" Ltd")))
    response = F.when(F.col("id") % 4 == 0, F.concat(F.lit("ANSWER: the "), "answer")).when(F.col("id") % 4 == 1, F.concat(F.lit("ANSWER: "), F.upper(F.element_at("more", 1)))).when(F.col("id") % 4 == 2, F.lit("ANSWER: nowhere")).otherwise(a.NOTHING)
    return cases(spark, sf).select("id", a.snapped(response, names).alias("answer"))


def f26_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "raw").select("id", "s.em", F.round("s.f1", 9).alias("f1"), "s.refused")


def f24_matches(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", a.exact_match(F.col("raw"), F.col("answer")).alias("exact"), a.strict_match(F.concat(F.lit(" "), "raw"), F.col("answer")).alias("strict"))


def p11_gold_in_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", a.gold_in_evidence(F.col("evidence"), F.concat(F.array("answer"), "more")).alias("inside"))


def _staged(spark, sf):
    stage = F.when(F.col("size") % 11 == 0, "graph_no_anchors").when(F.col("predicted") == "", "qa_refusal").otherwise("qa")
    c = _scored(spark, sf, "raw").withColumn("stage", stage)
    return c.select("id", a.outcome(F.col("predicted"), F.concat(F.array("answer"), "more"), F.col("size") % 13, F.col("size") % 7, F.col("stage"), F.col("evidence")).alias("stage"))


def f34_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _staged(spark, sf)


def k15_stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stage_counts(_staged(spark, sf))


def a4_dataset_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of predictions, of which a third has no gold record."""
    c = cases(spark, sf)
    return metrics.dataset_metrics(c.select("id", F.col("raw").alias("predicted_answer")), c.where("id % 3 > 0").select("id", "answer", F.col("more").alias("answer_aliases")))


def j14_scored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    c = cases(spark, sf)
    return metrics.case_scores(c.select("id", F.col("raw").alias("predicted_answer")), c.where("id % 3 > 0").select("id", "answer", F.col("more").alias("answer_aliases"))).select("id", "strict_em", "normalized_em", "alias_em", F.round("f1", 9).alias("f1"))


def _records(spark, sf):
    """Two systems' records."""
    out = None
    for name, said in (("first", "raw"), ("second", "other")):
        c = _scored(spark, sf, said)
        ids = lambda *xs: F.array(*[F.when(x, F.lit(n)) for n, x in enumerate(xs)])
        support = F.array_compact(ids(F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("size") % 2 == 0)), F.array_compact(ids(F.col("id") % 2 == 0, F.col("size") % 3 == 0, F.col("size") % 2 == 0))
        one = c.select(F.lit(name).alias("system"), "id", "s.em", "s.f1", "s.refused", "answerable", support[0].alias("support_pred"), support[1].alias("support_gold"), F.length("raw").alias("tokens"), F.col("price").alias("seconds"))
        out = one if out is None else out.unionByName(one.where("id % 10 > 0"))
    return out


def r7_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The second system against the first, on their common questions."""
    found = metrics.compared(_records(spark, sf), "first")
    return found.select("system", "n", F.round("d_em", 6).alias("d_em"), F.round("p_em", 9).alias("p_em"), F.round("d_f1", 6).alias("d_f1"), "p_f1")


def a3_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.system_summary(_records(spark, sf))
    return found.select("system", "n", *[F.round(c, 6).alias(c) for c in ("em", "em_lo", "em_hi", "support_f1", "refusal_rate", "tokens_per_q", "seconds_per_q")])


def _calls(spark, sf):
    """Model calls: an event each, of a user's questions."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "extract").when(F.col("event_id") % 3 == 1, "answer").when(F.col("event_id") % 4 == 2, "finalize").otherwise("other")
    return e.select(F.col("user_id").alias("question_id"), kind.alias("kind"), (F.col("event_id") % 900).alias("prompt_tokens"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 70).alias("completion_tokens"), (F.col("event_id") % 40).alias("seconds"), (F.col("event_id") % 6 == 0).alias("cached"), "event_type")


def a6_usage(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.usage(_calls(spark, sf))


def a10_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Mean costs of a question, by kind of event."""
    each = metrics.usage(_calls(spark, sf).withColumn("key", F.concat_ws("/", "event_type", "question_id")), "key").withColumn("system", F.split_part("key", F.lit("/"), F.lit(1)))
    return metrics.costs(each).select("system", *[F.round(c, 6).alias(c) for c in ("index_tokens", "query_tokens", "index_seconds", "query_seconds")])


def a12_judge_usage(spark: SparkSession, sf: str) -> DataFrame:
    attempts = F.transform(F.sequence(F.lit(0), (F.col("turn") % 3).cast("int")), lambda i: F.struct((F.length("text") + i).alias("prompt_tokens"), F.when(i > 0, F.lit(7)).alias("completion_tokens")))
    return metrics.judge_usage(table(spark, sf, "conversations").select(attempts.alias("attempts")))


def a15_axis_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every customer has bought, as tests that pass."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("bought")).distinct()
    return metrics.axis_totals(c.join(o, "c_custkey", "left").select(F.coalesce("bought", F.lit(False)).alias("passed")))


def _annotations(spark, sf):
    """Three annotators' judgments of documents' labels, of which they leave some out."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("who", F.explode(F.array(F.lit("ann"), F.lit("bob"), F.lit("cyd"))))
    i, who = F.col("doc_id"), F.col("who")
    flip = F.when(who == "ann", 7).when(who == "bob", 5).otherwise(3)
    judge = lambda x, off: F.when((i + off) % flip == 0, " ").otherwise(F.when((i + off) % 11 == 0, 1 - x).otherwise(x).cast("string"))
    rows = d.where((who == "ann") | (i % 4 > 0)).select(
        who.alias("annotator"), F.floor(i / 4).cast("string").alias("paragraph_key"), (i % 4).alias("event_index"), F.when(i % 9 > 0, F.col("lang")).otherwise("").alias("lemma"),
        judge(F.col("quality"), 0).alias("event_correct"), judge(1 - F.col("toxic"), 1).alias("roles_correct"), judge(F.col("quality"), 2).alias("context_correct"), F.when(i % 4 == 0, (i % 5).cast("string")).otherwise("").alias("missed_facts"),
    )
    return rows.where((F.col("annotator") == "ann") | (F.col("paragraph_key").cast("int") % 6 > 0))


def r8_annotation_scores(spark: SparkSession, sf: str) -> DataFrame:
    shared, full, _ = metrics.annotation_scores(_annotations(spark, sf))
    shown = lambda df, kind: df.select(F.lit(kind).alias("rows"), "annotator", "n_paragraphs", "n_events", "n_context", *[F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ("event_precision", "role_accuracy", "context_accuracy", "missed_per_paragraph")])
    return shown(shared, "shared").unionByName(shown(full, "full"))


def r5_pair_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.annotation_scores(_annotations(spark, sf))[2].select("pair", "field", "n", F.round("kappa", 6).alias("kappa"))


def p13_has_context(spark: SparkSession, sf: str) -> DataFrame:
    time, place = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy")), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", a.has_context(time, place).alias("context"))


def f38_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Prices and small shares as they are printed."""
    p = F.when(F.col("p_partkey") % 9 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 9 > 1, F.col("p_size") / 40000)
    return table(spark, sf, "part").select("p_partkey", a.figure(F.when(F.col("p_partkey") % 7 > 0, F.col("p_size") + 0.25), 2).alias("price"), a.p_value(p).alias("p"), a.tex(F.concat("p_brand", F.lit("_50% & \\"))).alias("tex"))


def f40_annotations(spark: SparkSession, sf: str) -> DataFrame:
    r = _annotations(spark, sf)
    return r.select("annotator", "paragraph_key", "event_index", a.annotation(F.col("event_correct")).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (f24_matches, f26_scores, f30_clean_answer, f31_final_answer, f32_snapped, f34_outcomes, f38_figures, f40_annotations, p11_gold_in_evidence, p13_has_context, k15_stage_counts, a3_summary, a4_dataset_metrics, a6_usage, a10_costs, a12_judge_usage, a15_axis_totals, j14_scored_predictions, r5_pair_kappa, r7_comparison, r8_annotation_scores)
}


def _cased(i: str, given: str) -> str:
    quoted = [f.replace("'", "''") for f in FORMS]
    return "replace(CASE " + i + " " + " ".join(f"WHEN {n} THEN '{f}'" for n, f in enumerate(quoted[:-1])) + f" ELSE '{quoted[-1]}' END, '{{}}', {given})"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^\\w\\s]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


_RE = lambda p: p.replace("(?i)", "").replace("'", "''")
_BARE = lambda x: f"trim(trim({x}), '\"''`*,;: ')"


def _clean(raw: str) -> str:
    """Steps from `c` (id, question, raw...) to `cleaned`, with `answer_` as the cleaned answer."""
    abbreviations = "('inc', 'corp', 'co', 'ltd', 'jr', 'sr', 'st', 'dr', 'bros', 'no', 'mr', 'mrs', 'ms', 'u.s', 'd.c')"
    return f"""c1 AS (SELECT *, trim(regexp_replace({_BARE(raw)}, '^(?:STATUS\\s*:\\s*)+', '', 'i')) AS x1 FROM c),
c2 AS (SELECT *, {_BARE(f"regexp_replace(x1, '{_RE(a.PREAMBLE)}', '', 'i')")} AS x2 FROM c1),
c3 AS (SELECT *, regexp_extract(regexp_replace(x2, '\\.$', ''), '(\\S+)$', 1) AS last FROM c2),
c4 AS (SELECT *, CASE WHEN ends_with(x2, '.') AND length(last) > 2 AND NOT contains(last, '.') AND lower(last) NOT IN {abbreviations} THEN rtrim(x2[:-2]) ELSE x2 END AS x3 FROM c3),
cleaned AS (SELECT *, CASE WHEN x3 = '' OR starts_with(x3, '<') OR contains(lower(x3), 'entity name') OR regexp_matches(x3, '{_RE(a.REFUSAL)}', 'i') THEN NULL
  WHEN contains(x3, ',') AND NOT regexp_matches(question, '\\b(state|country|province|region|county)\\b', 'i') AND len(string_split_regex(trim(split_part(x3, ',', 1)), '\\s+')) <= 3 AND regexp_matches(trim(substr(x3, instr(x3, ',') + 1)), '^\\p{{Lu}}') THEN trim(split_part(x3, ',', 1)) ELSE x3 END AS answer_ FROM c4)"""


_CASES = f"""c AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '{QUESTIONS[0]}' WHEN 1 THEN '{QUESTIONS[1]}' ELSE '{QUESTIONS[2]}' END AS question, p_name AS answer, p_brand AS brand, 'the ' || p_type AS kind, p_size % 5 <> 0 AS answerable,
  {_cased(f"p_partkey % {len(FORMS)}", "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END")} AS raw, {_cased(f"(p_partkey + 3) % {len(FORMS)}", "split_part(p_name, ' ', 1)")} AS other,
  'Found: ' || CASE WHEN p_partkey % 4 < 2 THEN p_name ELSE p_type END || ', it says.' AS evidence, p_size AS size, p_retailprice AS price FROM part)"""


def _f1(p: str, g: str) -> str:
    p, g = (f"list_filter(string_split({x}, ' '), lambda z: z <> '')" for x in (p, g))
    same = f"coalesce(list_sum(list_transform(list_distinct({p}), lambda w: least(len(list_filter({p}, lambda z: z = w)), len(list_filter({g}, lambda z: z = w))))), 0)"
    return f"CASE WHEN {same} = 0 THEN 0.0 ELSE 2.0 * {same} / (len({p}) + len({g})) END"


def _score(said: str) -> str:
    """Steps from `c` to `s` (id, em, f1, refused, predicted)."""
    best = lambda f: "greatest(" + ", ".join(f(g) for g in ("ga", "gb", "gk")) + ")"
    return _clean(said) + f""", n AS (SELECT *, coalesce(answer_, '') AS predicted, {_norm("coalesce(answer_, '')")} AS np, {_norm('answer')} AS ga, {_norm('brand')} AS gb, {_norm('kind')} AS gk FROM cleaned),
b AS (SELECT *, {best(lambda g: f"CASE WHEN np = {g} THEN 1.0 ELSE 0.0 END")} AS best_em, {best(lambda g: _f1('np', g))} AS best_f1 FROM n),
s AS (SELECT *, predicted = '' AS refused, CASE WHEN NOT answerable THEN CASE WHEN predicted = '' THEN 1.0 ELSE 0.0 END WHEN predicted = '' THEN 0.0 ELSE best_em END AS em, CASE WHEN NOT answerable THEN CASE WHEN predicted = '' THEN 1.0 ELSE 0.0 END WHEN predicted = '' THEN 0.0 ELSE best_f1 END AS f1 FROM b)"""


_INSIDE = " OR ".join(f"contains(' ' || {_norm('evidence')} || ' ', ' ' || {_norm(g)} || ' ')" for g in ("answer", "brand", "kind"))
_STAGES = f"""WITH {_CASES}, {_score('raw')}, i AS (SELECT *, {_INSIDE} AS inside FROM s), stages AS (SELECT id, CASE WHEN predicted <> '' AND best_em = 1 THEN 'success' WHEN size % 13 = 0 THEN 'retrieval_empty' WHEN size % 7 = 0 THEN 'extraction_zero_events'
  WHEN size % 11 = 0 THEN 'graph_no_anchors' WHEN predicted = '' THEN CASE WHEN inside THEN 'qa_refusal_answer_in_evidence' ELSE 'qa_refusal_answer_not_in_evidence' END WHEN best_f1 > 0 THEN 'answer_partial_match'
  WHEN inside THEN 'answer_mismatch_answer_in_evidence' ELSE 'answer_mismatch_answer_not_in_evidence' END AS stage FROM i)"""
_GOLD = f"""WITH {_CASES}, g AS (SELECT *, {_norm('raw')} AS np, {_norm('answer')} AS ga, {_norm('brand')} AS gb, {_norm('kind')} AS gk FROM c WHERE id % 3 > 0),
m AS (SELECT id, CASE WHEN trim(raw) = trim(answer) THEN 1.0 ELSE 0.0 END AS strict_em, CASE WHEN np = ga THEN 1.0 ELSE 0.0 END AS normalized_em, CASE WHEN np IN (ga, gb, gk) THEN 1.0 ELSE 0.0 END AS alias_em, greatest({_f1('np', 'ga')}, {_f1('np', 'gb')}, {_f1('np', 'gk')}) AS f1 FROM g)"""
_CALLS = "calls AS (SELECT user_id AS question_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'extract' WHEN event_id % 3 = 1 THEN 'answer' WHEN event_id % 4 = 2 THEN 'finalize' ELSE 'other' END AS kind, event_id % 900 + CASE WHEN event_id % 5 > 0 THEN event_id % 70 ELSE 0 END AS tokens, event_id % 40 AS seconds, event_id % 6 = 0 AS cached FROM events)"
_USAGE = "coalesce(sum(tokens) FILTER (kind = 'extract'), 0) AS index_tokens, coalesce(sum(tokens) FILTER (kind IN ('answer', 'finalize')), 0) AS query_tokens, coalesce(sum(seconds) FILTER (kind = 'extract'), 0) AS index_seconds, coalesce(sum(seconds) FILTER (kind IN ('answer', 'finalize')), 0) AS query_seconds"
_JUDGED = "CASE WHEN (doc_id + {off}) % flip = 0 THEN NULL WHEN (doc_id + {off}) % 11 = 0 THEN 1 - ({x}) ELSE {x} END"
_ROWS = f"""who AS (SELECT * FROM (VALUES ('ann', 7), ('bob', 5), ('cyd', 3)) w(annotator, flip)),
ann AS (SELECT annotator, CAST(doc_id // 4 AS VARCHAR) AS paragraph_key, doc_id % 4 AS event_index, CASE WHEN doc_id % 9 > 0 THEN lang ELSE '' END AS lemma, {_JUDGED.format(off=0, x='quality')} AS event_correct, {_JUDGED.format(off=1, x='1 - toxic')} AS roles_correct, {_JUDGED.format(off=2, x='quality')} AS context_correct,
  CASE WHEN doc_id % 4 = 0 THEN doc_id % 5 END AS missed FROM documents JOIN labels USING (doc_id), who WHERE (annotator = 'ann' OR doc_id % 4 > 0) AND (annotator = 'ann' OR doc_id // 4 % 6 > 0)),
done AS (SELECT DISTINCT annotator, paragraph_key FROM ann WHERE coalesce(event_correct, roles_correct, context_correct, missed) IS NOT NULL),
shared AS (SELECT * FROM ann WHERE paragraph_key IN (SELECT paragraph_key FROM done GROUP BY 1 HAVING count(*) = 3) AND (paragraph_key, event_index) IN (SELECT (paragraph_key, event_index) FROM ann GROUP BY paragraph_key, event_index HAVING count(DISTINCT annotator) = 3)),
more AS (SELECT annotator FROM done GROUP BY 1 HAVING count(*) > (SELECT count(DISTINCT paragraph_key) FROM shared)), whole AS (SELECT * FROM ann WHERE annotator IN (SELECT annotator FROM more) AND (annotator, paragraph_key) IN (SELECT (annotator, paragraph_key) FROM done))"""
_MEASURES = """count(DISTINCT paragraph_key) AS n_paragraphs, count(event_correct) FILTER (lemma <> '') AS n_events, count(context_correct) FILTER (lemma <> '' AND event_correct = 1) AS n_context, coalesce(round(100 * avg(event_correct) FILTER (lemma <> ''), 6), -1.0) AS event_precision,
  coalesce(round(100 * avg(roles_correct) FILTER (lemma <> '' AND event_correct = 1), 6), -1.0) AS role_accuracy, coalesce(round(100 * avg(context_correct) FILTER (lemma <> '' AND event_correct = 1), 6), -1.0) AS context_accuracy, coalesce(round(avg(missed) FILTER (event_index = 0), 6), -1.0) AS missed_per_paragraph"""
_TWO = f"WITH {_CASES}, {_score('raw')}, first AS (SELECT * FROM s), " + _score("other").replace("c1 AS", "d1 AS").replace("c2 AS", "d2 AS").replace("c3 AS", "d3 AS").replace("c4 AS", "d4 AS").replace("FROM c1)", "FROM d1)").replace("FROM c2)", "FROM d2)").replace("FROM c3)", "FROM d3)").replace("FROM c4)", "FROM d4)").replace("cleaned AS", "dcleaned AS").replace("FROM cleaned", "FROM dcleaned").replace("n AS (SELECT *, coalesce", "dn AS (SELECT *, coalesce").replace("FROM n)", "FROM dn)").replace("b AS (SELECT *, greatest", "db AS (SELECT *, greatest").replace("FROM b)", "FROM db)").replace("s AS (SELECT *, predicted", "ds AS (SELECT *, predicted") + ", second AS (SELECT * FROM ds WHERE id % 10 > 0)"
_TAIL = "list_sum(list_transform(range(0, least(b01, b10) + 1), lambda i: exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1) - (b01 + b10) * ln(2))))"
_SETS = "list_filter([CASE WHEN id % 2 = 0 THEN 0 END, CASE WHEN {x} % 3 = 0 THEN 1 END, CASE WHEN size % 2 = 0 THEN 2 END], lambda z: z IS NOT NULL)"
_SUPPORT = f"CASE WHEN len({_SETS.format(x='id')}) = 0 AND len({_SETS.format(x='size')}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({_SETS.format(x='id')}, {_SETS.format(x='size')})) / (len({_SETS.format(x='id')}) + len({_SETS.format(x='size')})) END"
_BOTH = f"""{_TWO}, records AS (SELECT 'first' AS system, * FROM first UNION ALL SELECT 'second', * FROM second), {means_sql("SELECT system AS grp, em AS value FROM records")}, spans AS (SELECT grp, 100 * lo AS lo, 100 * hi AS hi FROM ({interval_sql()}))"""
ORACLES = {
    "f24_matches": f"WITH {_CASES} SELECT id, CASE WHEN {_norm('raw')} = {_norm('answer')} THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN trim(raw) = trim(answer) THEN 1.0 ELSE 0.0 END AS strict FROM c",
    "f26_scores": f"WITH {_CASES}, {_score('raw')} SELECT id, em, round(f1, 9) AS f1, refused FROM s",
    "f30_clean_answer": f"WITH {_CASES}, {_clean('raw')} SELECT id, answer_ AS answer FROM cleaned",
    "f31_final_answer": f"WITH {_CASES}, {_clean("CASE WHEN raw = '' AND id % 7 = 0 THEN 'no line' ELSE raw END")} SELECT id, CASE WHEN id % 5 = 0 OR answer_ IS NULL THEN '{a.NOTHING}' ELSE 'ANSWER: ' || answer_ END AS answer FROM cleaned",
    "f32_snapped": f"WITH {_CASES} SELECT id, CASE id % 4 WHEN 0 THEN 'ANSWER: ' || array_to_string(list_transform(string_split(answer, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') WHEN 1 THEN 'ANSWER: ' || brand WHEN 2 THEN 'ANSWER: nowhere' ELSE '{a.NOTHING}' END AS answer FROM c",
    "f34_outcomes": _STAGES + " SELECT id, stage FROM stages",
    "k15_stage_counts": _STAGES + " SELECT stage, n, row_number() OVER (ORDER BY n DESC, stage) AS rank FROM (SELECT stage, count(*) AS n FROM stages GROUP BY 1)",
    "p11_gold_in_evidence": f"WITH {_CASES} SELECT id, {_INSIDE} AS inside FROM c",
    "j14_scored_predictions": _GOLD + " SELECT id, strict_em, normalized_em, alias_em, round(f1, 9) AS f1 FROM m",
    "a4_dataset_metrics": _GOLD + " SELECT round(100 * avg(strict_em), 2) AS strict_em, round(100 * avg(normalized_em), 2) AS normalized_em, round(100 * avg(alias_em), 2) AS answer_em, round(100 * avg(alias_em), 2) AS alias_em, round(100 * avg(f1), 2) AS answer_f1, count(*) AS evaluated_cases FROM m",
    "r7_comparison": f"{_TWO}, pairs AS (SELECT a.em AS ea, b.em AS eb, a.f1 AS fa, b.f1 AS fb FROM second a JOIN first b USING (id)), f1_pairs AS (SELECT 'second' AS grp, fa AS a, fb AS b FROM pairs), {paired_sql('f1_pairs')}, counts AS (SELECT count(*) AS n, count(*) FILTER (ea <> 1 AND eb = 1) AS b01, count(*) FILTER (ea = 1 AND eb <> 1) AS b10, round(100 * (avg(ea) - avg(eb)), 6) AS d_em, round(100 * (avg(fa) - avg(fb)), 6) AS d_f1 FROM pairs) SELECT 'second' AS system, n, d_em, round(CASE WHEN b01 + b10 = 0 THEN 1.0 ELSE least(1.0, 2 * {_TAIL}) END, 9) AS p_em, d_f1, p AS p_f1 FROM counts, paired",
    "a3_summary": f"{_BOTH} SELECT system, count(*) AS n, round(100 * avg(em), 6) AS em, round(any_value(lo), 6) AS em_lo, round(any_value(hi), 6) AS em_hi, round(100 * avg(CASE WHEN answerable THEN {_SUPPORT} END), 6) AS support_f1, round(100 * avg(CASE WHEN refused THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate, round(avg(length(raw)), 6) AS tokens_per_q, round(avg(price), 6) AS seconds_per_q FROM records JOIN spans ON grp = system GROUP BY 1",
    "a6_usage": f"WITH {_CALLS} SELECT question_id, {_USAGE}, coalesce(sum(tokens) FILTER (kind <> 'other'), 0) AS total_tokens, coalesce(sum(seconds) FILTER (kind <> 'other'), 0) AS seconds, count(*) FILTER (kind <> 'other' AND NOT cached) AS llm_calls, count(*) FILTER (kind = 'extract' AND cached) AS extract_cache_hits, count(*) FILTER (kind = 'finalize') AS finalize_calls FROM calls GROUP BY 1",
    "a10_costs": f"WITH {_CALLS}, each AS (SELECT event_type AS system, question_id, {_USAGE} FROM calls GROUP BY 1, 2) SELECT system, round(avg(index_tokens), 6) AS index_tokens, round(avg(query_tokens), 6) AS query_tokens, round(avg(index_seconds), 6) AS index_seconds, round(avg(query_seconds), 6) AS query_seconds FROM each GROUP BY 1",
    "a12_judge_usage": "SELECT sum((turn % 3 + 1) * length(text) + (turn % 3) * (turn % 3 + 1) // 2) AS prompt_tokens, sum(7 * (turn % 3)) AS completion_tokens FROM conversations",
    "a15_axis_totals": "SELECT count(*) FILTER (b) AS passed, count(*) AS total, round(100 * count(*) FILTER (b) / count(*), 2) AS accuracy FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS b FROM customer)",
    "r8_annotation_scores": f"WITH {_ROWS} SELECT 'shared' AS rows, annotator, {_MEASURES} FROM shared GROUP BY annotator UNION ALL SELECT 'full', annotator, {_MEASURES} FROM whole GROUP BY annotator",
    "r5_pair_kappa": f"WITH {_ROWS}, long AS (SELECT annotator, paragraph_key, event_index, 'event_correct' AS field, event_correct AS x FROM shared UNION ALL SELECT annotator, paragraph_key, event_index, 'roles_correct', roles_correct FROM shared), pairs AS (SELECT l.annotator || ' / ' || r.annotator AS pair, l.field, l.x AS a, r.x AS b FROM long l JOIN long r USING (paragraph_key, event_index, field) WHERE l.annotator < r.annotator AND l.x IS NOT NULL AND r.x IS NOT NULL), k AS (SELECT pair, field, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, (sum(a) * sum(b) + sum(1 - a) * sum(1 - b)) / (count(*) * count(*)) AS pe FROM pairs GROUP BY 1, 2) SELECT pair, field, n, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k",
    "p13_has_context": "SELECT o_orderkey, o_orderkey % 3 = 1 OR o_orderkey % 4 = 0 AS context FROM orders",
    "f38_figures": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '--' ELSE printf('%.2f', p_size + 0.25) END AS price, CASE WHEN p_partkey % 9 <= 1 THEN '--' WHEN p_size / 40000 < 0.001 THEN '$<$0.001' ELSE printf('%.3f', p_size / 40000) END AS p, replace(p_brand, '#', '\\#') || '\\_50\\% \\& \\textbackslash{}' AS tex FROM part",
    "f40_annotations": f"WITH {_ROWS} SELECT annotator, paragraph_key, event_index, event_correct AS value FROM ann",
}
