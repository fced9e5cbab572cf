"""Answers of models: refusals, cleaning, normal forms, scores, outcome stages, and how figures are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import text as t

#: What a refusal looks like as a whole answer, and what may stand before an answer.
REFUSAL = (
    r"(?i)^(?:status\s*:\s*)?(?:not[_ ]in[_ ]evidence|unknown|unsupported|none|n/?a|not|no answer|no (?:explicit )?evidence\b.*|(?:i )?(?:cannot|can't|can not) (?:be )?determined?\b.*|"
    r"there is no\b.*|(?:it is |this is )?not (?:explicitly )?(?:provided|stated|mentioned|specified|available)\b.*|(?:the )?(?:evidence|context|graph) does not\b.*|i don'?t have\b.*|insufficient (?:evidence|information)\b.*)$"
)
PREAMBLE = r"(?i)^(?:based\s+on\s+the\s+(?:evidence|context|facts|graph)\s*,?\s*|the\s+answer\s+is\s*:?\s*|answer\s*:\s*)+"
ANSWER_LINE = r"(?imd)^\s*(?:FINAL[ _]ANSWER|ANSWER)\s*:\s*(.+?)\s*$"
STATUS_LINE = r"(?imd)^\s*(?:STATUS\s*:\s*)?NOT_IN_EVIDENCE\s*$"
STATUS_PREFIX, REGION_ASKED = r"(?i)^(?:STATUS\s*:\s*)+", r"(?i)\b(state|country|province|region|county)\b"
QUOTES = "\"'`*,;: "
NOTHING = "STATUS: NOT_IN_EVIDENCE"
#: Roles that modify an event beside every :ARGM-.
MODIFIERS = (":manner", ":purpose", ":direction", ":location", ":time")


def is_refusal(answer: Column) -> Column:
    return answer.rlike(REFUSAL)


def has_status(text: Column) -> Column:
    return text.rlike(STATUS_LINE)


def has_preamble(answer: Column) -> Column:
    return answer.rlike(PREAMBLE)


def is_modifier(role: Column) -> Column:
    return F.lower(role).isin(*MODIFIERS) | F.lower(role).startswith(":argm-")


def has_context(time: Column, place: Column) -> Column:
    return (F.length(F.btrim(F.coalesce(time, F.lit("")))) > 0) | (F.length(F.btrim(F.coalesce(place, F.lit("")))) > 0)


def clean_answer(candidate: Column, question: Column) -> Column:
    """An answer without quotes, lead-in and sentence period; null for a refusal or a template.

    "City, Region" is cut to the city, unless the question asks for a region.
    """
    bare = lambda c: F.btrim(F.btrim(c), F.lit(QUOTES))
    text = F.btrim(F.regexp_replace(bare(F.coalesce(candidate, F.lit(""))), STATUS_PREFIX, ""))
    text = t.without_period(bare(F.regexp_replace(text, PREAMBLE, "")))
    head, tail = F.split_part(text, F.lit(","), F.lit(1)), F.btrim(F.regexp_extract(text, r"(?s)^[^,]*,(.*)$", 1))
    cut = text.contains(",") & ~F.coalesce(question, F.lit("")).rlike(REGION_ASKED) & (F.size(F.split(F.btrim(head), r"\s+")) <= 3) & tail.rlike(r"^\p{Lu}")
    nothing = (text == "") | text.startswith("<") | F.lower(text).contains("entity name") | is_refusal(text)
    return F.when(~nothing, F.when(cut, F.btrim(head)).otherwise(text))


def final_answer(text: Column, question: Column) -> Column:
    """`ANSWER: ...` from the last answer line of a text, cleaned; else the status that there is none."""
    last = F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANSWER_LINE), F.lit(1)), F.lit(-1))
    answer = clean_answer(last, question)
    return F.when(last.isNotNull() & answer.isNotNull(), F.concat(F.lit("ANSWER: "), answer)).otherwise(NOTHING)


def snapped(response: Column, names: Column) -> Column:
    """A response in the form of the first of an array of names that means the same."""
    answer = F.btrim(F.regexp_replace(response, "^ANSWER:", ""))
    at = F.array_position(t.match_keys(names), t.match_key(answer))
    return F.when(response.startswith("ANSWER:") & (at > 0), F.concat(F.lit("ANSWER: "), F.try_element_at(names, at.cast("int")))).otherwise(response)


def normal(text: Column) -> Column:
    """An answer's normal form: its tokens with single spaces."""
    return F.array_join(t.answer_tokens(text), " ")


def normal_all(texts: Column) -> Column:
    """Normal forms of an array of answers, folded together."""
    one = lambda x: F.array_join(t.tokens_of_folded(x), " ")
    joined = F.array_join(F.transform(texts, lambda x: F.regexp_replace(x, "\x1f", " ")), "\x1f")
    return F.when(F.size(texts) > 0, F.transform(F.split(t.fold(joined), "\x1f"), one)).otherwise(F.array().cast("array<string>"))


def exact_match(predicted: Column, gold: Column) -> Column:
    return (normal(predicted) == normal(gold)).cast("double")


def strict_match(predicted: Column, gold: Column) -> Column:
    return (F.btrim(predicted) == F.btrim(gold)).cast("double")


def _beside(text: Column, others: Column, pair) -> Column:
    """`pair` of each other text's normal form and the text's own, folded together."""
    every = normal_all(F.concat(F.array(F.coalesce(text, F.lit(""))), others))
    n = F.size(every) - 1
    return F.zip_with(F.slice(every, F.lit(2), n), F.array_repeat(F.element_at(every, 1), n), pair)


def _best(predicted: Column, aliases: Column) -> tuple[Column, Column]:
    """Best exact match and F1 of an answer with an array of answers."""
    split = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    return F.array_max(_beside(predicted, aliases, lambda g, p: (g == p).cast("double"))), F.array_max(_beside(predicted, aliases, lambda g, p: t.token_f1(split(p), split(g))))


def score(predicted: Column, aliases: Column, answerable: Column) -> Column:
    """struct(em, f1, refused): the best over the aliases; a refusal is right where there is no answer."""
    refused = F.coalesce(predicted, F.lit("")) == ""
    em, f1 = _best(predicted, aliases)
    of = lambda x: F.when(~answerable, refused.cast("double")).when(refused, 0.0).otherwise(x)
    return F.struct(of(em).alias("em"), of(f1).alias("f1"), refused.alias("refused"))


def gold_in_evidence(evidence: Column, aliases: Column) -> Column:
    """Whether an alias' normal form is in the evidence's, as whole tokens."""
    spaced = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.exists(_beside(evidence, aliases, lambda g, e: (g != "") & spaced(e).contains(spaced(g))), lambda x: x)


def outcome(predicted: Column, aliases: Column, ingested: Column, extracted: Column, stage: Column, evidence: Column) -> Column:
    """The pipeline stage that decided a case."""
    given = F.coalesce(predicted, F.lit("")) != ""
    em, f1 = _best(predicted, aliases)
    inside = gold_in_evidence(evidence, aliases)
    in_or_out = lambda name: F.when(inside, f"{name}_answer_in_evidence").otherwise(f"{name}_answer_not_in_evidence")
    return (
        F.when(given & (em == 1.0), "success").when(ingested == 0, "retrieval_empty").when(extracted == 0, "extraction_zero_events")
        .when(stage.isin("graph_no_anchors", "graph_empty_blueprint"), stage).when(stage == "qa_refusal", in_or_out("qa_refusal"))
        .when(given & (f1 > 0), "answer_partial_match").otherwise(in_or_out("answer_mismatch"))
    )


def char_budget(context_tokens: int, reserved_tokens: int, least: int = 2000) -> int:
    """Characters of evidence that a context window has room for."""
    return max(least, int((context_tokens - reserved_tokens - 700) * 3.5))


def fitting_chars(context_tokens: Column, reserved_tokens: Column, least: int = 2000) -> Column:
    """`char_budget` of a row's own context window."""
    return F.greatest(F.lit(least).cast("bigint"), F.floor((context_tokens - reserved_tokens - 700) * 3.5))


def annotation(value: Column) -> Column:
    """A judgment as a number; null where it is blank."""
    return F.nullif(F.btrim(F.coalesce(value, F.lit(""))), F.lit("")).try_cast("int")


def figure(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull() | F.isnan(x), "--").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def p_value(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "--").when(p < 0.001, "$<$0.001").otherwise(F.format_string("%.3f", p))


def tex(text: Column) -> Column:
    """Text with the characters escaped that TeX reads as commands."""
    out = F.replace(text, F.lit("\\"), F.lit("\\textbackslash{}"))
    for c in "_%&#":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out
