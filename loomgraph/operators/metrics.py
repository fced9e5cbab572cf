"""Metrics of question answering systems, comparisons, costs, and agreement of annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import answers as a
from loomgraph.functions import text as t
from loomgraph.operators import stats
from loomgraph.storage import materialised

#: Kinds of model calls by the side that pays for them.
INDEX_CALLS, QUERY_CALLS = ("extract",), ("answer", "finalize")
JUDGMENTS = ("event_correct", "roles_correct", "context_correct", "missed_facts")


def case_scores(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of predictions that have a gold record, by id.

    predictions: id, predicted_answer; gold: id, answer, answer_aliases. The answer leads its
    aliases; a missing prediction is empty. Gold records without a prediction don't count.
    """
    both = predictions.select("id", F.coalesce("predicted_answer", F.lit("")).alias("p")).join(gold, "id")
    every = F.concat(F.array(F.coalesce("answer", F.lit(""))), F.coalesce("answer_aliases", F.array().cast("array<string>")))
    split = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    normal = both.select("id", "p", "answer", a.normal(F.col("p")).alias("n"), a.normal_all(every).alias("g"))
    return normal.select(
        "id",
        a.strict_match(F.col("p"), F.coalesce("answer", F.lit(""))).alias("strict_em"),
        (F.col("n") == F.element_at("g", 1)).cast("double").alias("normalized_em"),
        F.array_contains("g", F.col("n")).cast("double").alias("alias_em"),
        F.array_max(F.transform("g", lambda x: t.token_f1(split(F.col("n")), split(x)))).alias("f1"),
    )


def dataset_metrics(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: strict, normalized and alias-aware exact match and F1 in percent, and the number of cases."""
    s = case_scores(predictions, gold)
    share = lambda c: F.coalesce(F.round(100 * F.avg(c), 2), F.lit(0.0))
    return s.agg(share("strict_em").alias("strict_em"), share("normalized_em").alias("normalized_em"), share("alias_em").alias("answer_em"), share("alias_em").alias("alias_em"), share("f1").alias("answer_f1"), F.count("*").alias("evaluated_cases"))


def stage_counts(cases: DataFrame) -> DataFrame:
    """(stage, n), the most frequent first by `rank`."""
    from pyspark.sql import Window

    counted = cases.groupBy("stage").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "stage")))


def system_summary(records: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """A system's figures: n, em and f1 in percent with bootstrap intervals, support F1 of answerable cases, refusals, cost.

    records: system, em, f1, answerable, support_pred, support_gold, refused, tokens, seconds.
    """
    records = materialised(records)  # read thrice
    support = F.when(F.coalesce("answerable", F.lit(True)), t.set_f1(F.col("support_pred"), F.col("support_gold")))
    out = records.groupBy("system").agg(
        F.count("*").alias("n"), (100 * F.avg("em")).alias("em"), (100 * F.avg("f1")).alias("f1"), (100 * F.avg(support)).alias("support_f1"),
        (100 * F.avg(F.col("refused").cast("double"))).alias("refusal_rate"), F.avg(F.coalesce("tokens", F.lit(0))).alias("tokens_per_q"), F.avg(F.coalesce("seconds", F.lit(0.0))).alias("seconds_per_q"),
    )
    for name in ("em", "f1"):
        span = stats.bootstrap_interval(records.select(F.col("system").alias("grp"), F.col(name).cast("double").alias("value")), resamples, seed=seed)
        out = out.join(span.select(F.col("grp").alias("system"), (100 * F.col("lo")).alias(f"{name}_lo"), (100 * F.col("hi")).alias(f"{name}_hi")), "system", "left")
    return out


def compared(records: DataFrame, reference: str, resamples: int = 10_000) -> DataFrame:
    """Each system against the reference on their common questions: system, n, d_em, p_em, d_f1, p_f1.

    Differences are in percent; p of exact matches by McNemar's test, of F1 by the paired bootstrap.
    """
    records = materialised(records.select("system", "id", "em", "f1"))
    of = records.where(F.col("system") != reference).select("system", "id", F.col("em").alias("em_a"), F.col("f1").alias("f1_a"))
    ref = records.where(F.col("system") == reference).select("id", F.col("em").alias("em_b"), F.col("f1").alias("f1_b"))
    pairs = materialised(of.join(ref, "id").withColumnRenamed("system", "grp"))
    exact = stats.mcnemar(pairs.select("grp", (F.col("em_a") == 1).alias("a"), (F.col("em_b") == 1).alias("b")))
    f1 = stats.paired_bootstrap(pairs.select("grp", F.col("f1_a").alias("a"), F.col("f1_b").alias("b")), resamples)
    means = pairs.groupBy("grp").agg(F.count("*").alias("n"), (100 * (F.avg("em_a") - F.avg("em_b"))).alias("d_em"), (100 * (F.avg("f1_a") - F.avg("f1_b"))).alias("d_f1"))
    found = means.join(exact.select("grp", F.col("p").alias("p_em")), "grp").join(f1.select("grp", F.col("p").alias("p_f1")), "grp")
    every = records.where(F.col("system") != reference).select(F.col("system").alias("grp")).distinct()
    return every.join(found, "grp", "left").select(F.col("grp").alias("system"), F.coalesce("n", F.lit(0)).alias("n"), "d_em", "p_em", "d_f1", "p_f1")


def usage(calls: DataFrame, by: str = "question_id") -> DataFrame:
    """Tokens, seconds and calls of indexing and of answering, by question.

    calls: question_id, kind, prompt_tokens, completion_tokens, seconds, cached. A cached
    result is charged what it cost first.
    """
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    total = lambda x, *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), x)), F.lit(0))
    both = (*INDEX_CALLS, *QUERY_CALLS)
    return calls.groupBy(by).agg(
        total(tokens, *INDEX_CALLS).alias("index_tokens"), total(tokens, *QUERY_CALLS).alias("query_tokens"), total(tokens, *both).alias("total_tokens"),
        total(F.col("seconds"), *INDEX_CALLS).alias("index_seconds"), total(F.col("seconds"), *QUERY_CALLS).alias("query_seconds"), total(F.col("seconds"), *both).alias("seconds"),
        total(F.when(~F.col("cached"), 1).otherwise(0), *both).alias("llm_calls"), total(F.col("cached").cast("int"), *INDEX_CALLS).alias("extract_cache_hits"), total(F.lit(1), "finalize").alias("finalize_calls"),
    )


def costs(records: DataFrame) -> DataFrame:
    """Mean cost of a question, by system."""
    return records.groupBy("system").agg(*[F.avg(F.coalesce(c, F.lit(0))).alias(c) for c in ("index_tokens", "query_tokens", "index_seconds", "query_seconds")])


def judge_usage(log: DataFrame) -> DataFrame:
    """One row: tokens of all attempts of a judge's log (attempts array<struct<prompt_tokens, completion_tokens>>)."""
    each = log.select(F.explode("attempts").alias("x"))
    return each.agg(F.coalesce(F.sum("x.prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("x.completion_tokens"), F.lit(0)).alias("completion_tokens"))


def axis_totals(axes: DataFrame) -> DataFrame:
    """One row: passed axes, all axes, and the share in percent; 0 where there are none."""
    n = F.count("*")
    return axes.agg(F.count_if("passed").alias("passed"), n.alias("total"), F.coalesce(F.round(100 * F.count_if("passed") / F.nullif(n, F.lit(0)), 2), F.lit(0.0)).alias("accuracy"))


def _numbers(rows: DataFrame) -> DataFrame:
    return rows.select("annotator", "paragraph_key", F.col("event_index").cast("string").alias("event_index"), F.coalesce("lemma", F.lit("")).alias("lemma"), *[a.annotation(F.col(c)).alias(c) for c in JUDGMENTS])


def measures(rows: DataFrame, by: Column | str = "annotator") -> DataFrame:
    """Precision of events, accuracy of roles and context among correct ones, and missed facts a paragraph.

    Rows as from `_numbers`. A figure without judgments is null.
    """
    event, right = F.col("lemma") != "", (F.col("lemma") != "") & (F.col("event_correct") == 1)
    share = lambda c, where: 100 * F.avg(F.when(where, F.col(c)))
    return rows.groupBy(by).agg(
        F.countDistinct("paragraph_key").alias("n_paragraphs"), F.count(F.when(event, F.col("event_correct"))).alias("n_events"), share("event_correct", event).alias("event_precision"),
        share("roles_correct", right).alias("role_accuracy"), share("context_correct", right).alias("context_accuracy"), F.count(F.when(right, F.col("context_correct"))).alias("n_context"),
        F.avg(F.when(F.col("event_index") == "0", F.col("missed_facts"))).alias("missed_per_paragraph"),
    )


def annotated(rows: DataFrame) -> DataFrame:
    """(annotator, paragraph_key) of paragraphs in which an annotator judged something."""
    some = F.coalesce(*JUDGMENTS).isNotNull()
    return rows.where(some).select("annotator", "paragraph_key").distinct()


def shared_rows(rows: DataFrame) -> DataFrame:
    """Rows whose paragraph every annotator judged and whose key every annotator has."""
    n = F.broadcast(rows.agg(F.countDistinct("annotator").alias("all")))  # one row
    paragraphs = annotated(rows).groupBy("paragraph_key").agg(F.count("*").alias("k")).join(n).where("k = all").select("paragraph_key")
    keys = rows.groupBy("paragraph_key", "event_index").agg(F.countDistinct("annotator").alias("k")).join(n).where("k = all").select("paragraph_key", "event_index")
    return rows.join(paragraphs, "paragraph_key", "left_semi").join(keys, ["paragraph_key", "event_index"], "left_semi")


def pair_kappa(rows: DataFrame, *fields: str) -> DataFrame:
    """(pair, field, n, kappa) of every two annotators of shared rows."""
    one = rows.select("annotator", "paragraph_key", "event_index", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in fields])).alias("j")).select("annotator", "paragraph_key", "event_index", "j.field", "j.x")
    left, right = one.withColumnsRenamed({"annotator": "la", "x": "a"}), one.withColumnsRenamed({"annotator": "lb", "x": "b"})
    pairs = left.join(right, ["paragraph_key", "event_index", "field"]).where("la < lb")
    return stats.kappa(pairs.select(F.concat_ws(" / ", "la", "lb", "field").alias("grp"), "a", "b")).select(F.substring_index("grp", " / ", 2).alias("pair"), F.substring_index("grp", " / ", -1).alias("field"), "n", "kappa")


def annotation_scores(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Measures on what all annotators judged, on what each judged where that is more, and kappas.

    rows: annotator, paragraph_key, event_index, lemma and the judgments as texts, blank where open.
    """
    whole = _numbers(rows)
    shared = shared_rows(whole)
    own = annotated(whole)
    common = F.broadcast(shared.agg(F.countDistinct("paragraph_key").alias("common")))  # one row
    more = own.groupBy("annotator").agg(F.count("*").alias("k")).join(common).where("k > common").select("annotator")
    full = whole.join(own, ["annotator", "paragraph_key"], "left_semi").join(more, "annotator", "left_semi")
    return measures(shared), measures(full), pair_kappa(shared, "event_correct", "roles_correct")
