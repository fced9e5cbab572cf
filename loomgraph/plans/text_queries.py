"""Queries of the text functions, over stated values and over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import answers
from loomgraph.functions import text as t
from loomgraph.functions import vocab as v
from loomgraph.session import importable, table
from loomgraph.storage import materialised

#: Values that show each function's cases.
VALUES = (
    "May 4, 1948", "2010–11 season", "500 BC", "early spring", "born in 1999", "the year", "28,556", "about 1850 to 1860", "Canyon, Texas, United States", "Paris, France",
    "Smith, 12 Main St", "Duke of York, England", "one, Two", "A, B, C, D, E, F", "unknown", "The Others", "network executives (implied)", "somebody.", "Grant Green", "They",
    "elder sister of Anna Lee", "Son of John and Mary", "children of Bob", "born to Ada and Max", "younger son", "eldest daughters", "DLR's Lander Control Center", "Swift's frustrations",
    "A and B", "Tom, Dick and Harry", "cats and dogs", "guitarist Grant Green", "\"The Book.\"", "in the Dark (album)", "Acme Inc.", "City of London", "The Who", "Sir Paul McCartney Jones",
    "Liverpool F.C.", "Acme Holdings Ltd", "Dr Who", "co-found", "be_located", "Give  Birth", "operations", "running", "writers", "As", "bear.02", "Be Located-3", "???", ":before", "prior event", "aftermath", "because",
    "film_director", "release date", "owned by", "headquarters city", "2hop__12_34", "double__x", "q__1_2_3", "plain", "doc:17", "ANSWER: Paris", "STATUS: NOT_IN_EVIDENCE", "", "who founded the record label?", "Where was her wife born",
)


#: Names and types in the tables.
NAMED = (("supplier", "s_name"), ("customer", "c_name"), ("part", "p_name"), ("part", "p_type"), ("nation", "n_name"), ("region", "r_name"), ("orders", "o_orderpriority"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    """The stated values, the tables' names, and every word of the documents; distinct."""
    importable(spark)
    out = spark.createDataFrame([(x,) for x in VALUES], "v string")
    for name, column in NAMED:
        out = out.unionByName(table(spark, sf, name).select(F.col(column).alias("v")))
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")).alias("v"))
    return out.unionByName(words).distinct()


def over_values(**columns):
    """A query that gives functions' results for those values."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _values(spark, sf).select("v", *[f(F.col("v")).alias(k) for k, f in columns.items()])

    return query


def joined(array):
    return F.array_join(array, "|")


def lists(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


VALUES_SQL = "WITH vals AS (SELECT unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in VALUES) + "]) AS v" + "".join(f" UNION SELECT {c} FROM {t}" for t, c in NAMED) + " UNION SELECT unnest(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+')) FROM documents) "
_STEM = lambda w: "CASE " + " ".join(f"WHEN length({w}) > {len(s) + 2} AND ends_with({w}, '{s}') THEN left({w}, length({w}) - {len(s)})" for s in v.STEM_SUFFIXES) + f" ELSE {w} END"
_KEY = "trim(regexp_replace(lower(v), '[_\\s]+', ' ', 'g'))"
_DATE = f"""SELECT v, len(t) > 0 AND len(list_filter(t, lambda x: NOT (regexp_full_match(x, '\\d+') OR x IN {lists(v.DATE_WORDS)}))) = 0
  AND len(list_filter(t, lambda x, i: CASE WHEN regexp_full_match(x, '\\d+') THEN regexp_full_match(x, '1\\d{{3}}|20\\d{{2}}') OR coalesce(t[i + 1] IN {lists(v.ERAS)}, false) ELSE x IN {lists(v.MONTHS)} END)) > 0 AS date_like
  FROM (SELECT v, list_transform(regexp_extract_all(v, '[A-Za-z]+|\\d+'), lambda x: lower(x)) AS t FROM vals)"""
_PLACE = f"""SELECT v, CASE WHEN contains(v, ',') AND NOT regexp_matches(v, '\\d,\\d{{3}}') AND len(p) BETWEEN 2 AND 5 AND len(list_filter(p, lambda x: NOT (regexp_matches(x, '^\\p{{Lu}}') AND NOT regexp_matches(x, '\\d') AND lower(split_part(x, ' ', 1)) NOT IN {lists(v.TITLE_WORDS)} AND len(string_split_regex(x, '\\s+')) <= 5))) = 0 THEN array_to_string(p, '|') END AS parts
  FROM (SELECT v, list_transform(string_split(v, ','), lambda x: trim(x)) AS p FROM vals)"""


def f20_document_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Content stems of every document."""
    return table(spark, sf, "documents").select("doc_id", F.size(t.content_stems(F.col("text"))).alias("n_stems"), F.md5(joined(F.array_sort(t.content_stems(F.col("text"))))).alias("stems"))


def k16_chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence-aligned chunks of every document."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(t.sentence_chunks(F.col("text"))).alias("chunk", "text")).select("doc_id", "chunk", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def w16_document_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of documents, and the names that they go by."""
    title = table(spark, sf, "documents").select("doc_id", t.title_of(F.col("text")).alias("title")).where("title IS NOT NULL")
    return title.select("doc_id", "title", joined(t.title_names(F.col("title"))).alias("names"))


def c2_order_years(spark: SparkSession, sf: str) -> DataFrame:
    """Years read from a time expression about each order."""
    raw = F.concat_ws(" ", F.lit("from"), F.date_format("o_orderdate", "yyyy"), F.lit("to"), F.date_format(F.add_months("o_orderdate", 18), "yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", t.years(raw).alias("y")).select("o_orderkey", "y.start_year", "y.end_year")


def f6_entity_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Match key, display form and id of the values."""
    # written between the two foldings: in one plan every mention of a value is a column of its own in the rows that wait for Python
    keyed = materialised(_values(spark, sf).select("v", t.surface(F.col("v")).alias("surface"), t.match_key(F.col("v")).alias("key")))
    return keyed.withColumn("id", F.concat(F.lit("ent_"), t.slug(F.col("key"))))


def f25_answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Exact match and token F1 of each value with itself, cut after its first word."""
    pairs = _values(spark, sf).select(F.col("v").alias("predicted"), F.split_part("v", F.lit(" "), F.lit(1)).alias("gold"))
    a = pairs.withColumn("p", t.answer_tokens(F.col("predicted"))).withColumn("g", t.answer_tokens(F.col("gold")))
    return a.select("predicted", "gold", (F.col("p") == F.col("g")).cast("double").alias("em"), t.token_f1(F.col("p"), F.col("g")).alias("f1"), t.set_f1(F.col("p"), F.col("g")).alias("set_f1"))


QUERIES = {
    "p1_is_date_like": over_values(date_like=t.is_date_like),
    "p2_numeric_quantity": over_values(quantity=t.is_numeric_quantity),
    "p3_placeholder": over_values(placeholder=t.is_placeholder),
    "p5_frame_contract": over_values(locates=lambda c: t.frame_accepts(F.lit("locate.01"), c), founds=lambda c: t.frame_accepts(F.lit("found.01"), c), runs=lambda c: t.frame_accepts(F.lit("run.01"), c)),
    "p7_mentionable": over_values(mentionable=t.is_mentionable),
    "p14_capitalised": over_values(capitalised=t.is_capitalised),
    "f10_name_variants": over_values(variants=lambda c: joined(t.name_variants(c))),
    "f11_name_tokens": over_values(tokens=lambda c: joined(t.name_tokens(c))),
    "f12_subsequence": over_values(back=lambda c: t.is_subsequence(F.split(F.lower(F.substring(c, 1, 3)), ""), F.split(F.reverse(F.lower(c)), "")), inside=lambda c: t.is_subsequence(F.split(F.lower(F.substring(c, 1, 9)), ""), F.split(F.lower(F.concat(F.lit("the "), c)), ""))),
    "p10_refusals": over_values(refusal=answers.is_refusal, status=answers.has_status, preamble=answers.has_preamble),
    "p12_modifiers": over_values(modifier=answers.is_modifier),
    "f1_possessives": over_values(stripped=t.strip_possessives),
    "f2_fold": over_values(folded=t.fold),
    "f6_entity_keys": f6_entity_keys,
    "f7_lower_first": over_values(lowered=t.lower_first),
    "f8_conjoined": over_values(parts=lambda c: joined(t.split_conjoined(c))),
    "f14_place_parts": over_values(parts=lambda c: joined(t.split_place(c))),
    "f15_kinship_phrase": over_values(relation=lambda c: t.kinship_phrase(c)["relation"], targets=lambda c: joined(t.kinship_phrase(c)["targets"])),
    "f16_bare_kin_noun": over_values(relation=t.bare_kin_noun),
    "f17_possessive_association": over_values(owner=lambda c: t.possessive_association(c)["owner"], owned=lambda c: t.possessive_association(c)["owned"]),
    "f19_stem": over_values(stem=t.stem),
    "f20_document_stems": f20_document_stems,
    "f21_lemma_key": over_values(key=t.lemma_key),
    "f22_hop_count": over_values(hops=lambda c: t.hop_count(c, F.lit(None).cast("array<string>"))),
    "f25_answer_scores": f25_answer_scores,
    "f28_clean_prediction": over_values(answer=t.clean_prediction),
    "f29_source_index": over_values(idx=t.source_index),
    "f33_relations": over_values(relations=lambda c: joined(t.relations(c))),
    "c2_order_years": c2_order_years,
    "c6_sense_id": over_values(sense=t.sense_id),
    "c9_role_for_key": over_values(role=t.role_for_key),
    "c13_relation": over_values(relation=t.relation),
    "k16_chunk_documents": k16_chunk_documents,
    "w16_document_titles": w16_document_titles,
}
_CLEAN = "lower(trim(v))"
_SENSE = f"trim(regexp_replace(trim(regexp_replace({_CLEAN}, '[.\\-_]\\d{{1,2}}$', '')), '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g'), '_-')"
_REL = f"CASE WHEN starts_with({_CLEAN}, ':') THEN {_CLEAN} ELSE ':' || {_CLEAN} END"
_ROLE = "CASE " + " ".join(f"WHEN list_has_any(w, {str(list(k))}) THEN '{r}'" for r, k in t.ROLE_WORDS.items()) + " ELSE ':ARG2' END"
_POSS = "regexp_replace(regexp_replace(v, '([\\p{L}\\p{N}_])[''’]s\\b', '\\1', 'g'), '(s)[''’](\\s|$)', '\\1\\2', 'g')"
_BASE = f"trim({_POSS})"
_NO_PAREN = f"trim(regexp_replace({_BASE}, '\\s*\\([^)]*\\)', '', 'g'))"
_LOWERED = "lower(left(trim(v), 1)) || substr(trim(v), 2)"
_PLACEHOLDER = f"regexp_matches(lower(v), '\\(({'|'.join(v.INVENTED)})\\)') OR lower(trim(regexp_replace(trim(trim(v), '.,;:\"'''), '^(?:the|a|an)\\s+', '', 'i'))) IN {lists(('', *v.PLACEHOLDERS))}"
_RELATION = lambda noun: "CASE " + " ".join(f"WHEN {noun} IN {lists([k for k, x in v.KIN_NOUNS.items() if x == r and k not in v.PLURAL_KIN])} THEN '{r}'" for r in ("child", "parent", "spouse", "sibling")) + " END"
_QUOTED = lambda pattern: pattern.replace("'", "''")
_KINDRED = _QUOTED(t._KIN)


def _parts(x: str) -> str:
    """Names of a conjoined phrase, or the whole."""
    parts = f"list_filter(list_transform(string_split_regex({x}, ',\\s*|\\s+and\\s+|\\s*&\\s*'), lambda q: trim(q)), lambda q: q <> '')"
    return f"CASE WHEN len({parts}) > 1 AND len(list_filter({parts}, lambda q: NOT regexp_matches(q, '^\\p{{Lu}}'))) = 0 THEN {parts} ELSE [trim({x})] END"


_NAMES = t._NAME.replace("\\w", "\\p{L}\\p{N}_")
#: Without marks and case, as far as the tables' letters go.
_FOLD = lambda x: f"replace(lower(strip_accents({x})), 'ß', 'ss')"
_WORDS = lambda x, kept="": f"list_filter(string_split_regex({x}, '[^\\p{{L}}\\p{{N}}_{kept}]+'), lambda w: w <> '')"
_ANSWER = lambda x: f"list_filter(string_split_regex(trim(regexp_replace(regexp_replace({_FOLD(x)}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g')), '\\s+'), lambda w: w <> '')"
_LIKE = lambda short: f"'%' || array_to_string(list_transform(string_split({short}, ''), lambda c: regexp_replace(c, '([%_\\\\])', '\\\\\\1')), '%') || '%'"


def _steps(source: str, column: str, *steps: str) -> str:
    """`source` with each step, an expression over x, applied to a column in turn."""
    for step in steps:
        source = f"SELECT * REPLACE ({step.replace('{x}', column)} AS {column}) FROM ({source})"
    return source


def _cut(pattern: str, flags: str = "", into: str = "") -> str:
    return f"trim(regexp_replace({{x}}, '{pattern}', '{into}'{flags and f", '{flags}'"}))"


_ABBREVIATED = f"CASE WHEN ends_with({{x}}, '.') AND length(regexp_extract({{x}}, '(\\S*)\\.$', 1)) > 2 AND NOT contains(regexp_extract({{x}}, '(\\S*)\\.$', 1), '.') AND lower(regexp_extract({{x}}, '(\\S*)\\.$', 1)) NOT IN {lists(v.ABBREVIATIONS)} THEN rtrim({{x}}[:-2]) ELSE {{x}} END"
_SURFACE = _steps(
    "SELECT v, trim(v) AS whole, trim(trim(trim(v), '\"''“”‘’,;:')) AS s FROM vals", "s", _ABBREVIATED, _cut("^(?:with|by|from|to|at|for|in|on|as)\\s+", "i"), _cut("[''’]s$"), _cut("^(?:the|a|an)\\s+", "i"), _cut("^(?:his|her|their|its)\\s+", "i"),
    _cut(f"^(?:{'|'.join(v.DESCRIPTORS)})\\s+([A-Z])", "", "\\1"), _cut("\\s*\\([^)]*\\)\\s*$"), "regexp_replace({x}, '\\s+', ' ', 'g')", "CASE WHEN {x} = '' THEN whole ELSE {x} END",
)
_SUFFIX = f"regexp_replace({{x}}, '^(\\S+(?: \\S+)*?)(?: (?:{'|'.join(v.LEGAL_SUFFIXES)}))+$', '\\1')"
_LONE = lambda x: f"regexp_full_match({x}, '\\p{{L}}')"
_MATCH_KEY = _steps(
    f"SELECT *, {_FOLD(f"regexp_replace(s, '^({'|'.join(v.ADMIN_NOUNS)})\\s+of\\s+(.+)$', '\\2 \\1', 'i')")} AS k FROM ({_SURFACE})", "k", f"array_to_string({_WORDS('{x}')}, ' ')",
    "CASE WHEN len(list_filter(string_split({x}, ' '), lambda w: w NOT IN ('the', 'a', 'an', 'of', 'and'))) = 0 THEN {x} ELSE array_to_string(list_filter(string_split({x}, ' '), lambda w: w NOT IN ('the', 'a', 'an', 'of', 'and')), ' ') END",
    f"regexp_replace({{x}}, '^(?:{'|'.join(v.HONORIFICS)}) (\\S+ \\S)', '\\1')", _SUFFIX,
    f"trim(array_to_string(list_transform(string_split({{x}}, ' '), lambda w, i: CASE WHEN i > 1 AND {_LONE('w')} AND {_LONE("string_split({x}, ' ')[i - 1]")} THEN w ELSE ' ' || w END), ''))", _SUFFIX,
)
_OWNER = f"^({_NAMES}(?:\\s+{_NAMES})*)[''’]s\\s+({_NAMES}(?:\\s+(?:of|for|and|the|{_NAMES}))*)$"
ORACLES = {
    "f2_fold": VALUES_SQL + f"SELECT v, {_FOLD('v')} AS folded FROM vals",
    "f6_entity_keys": VALUES_SQL + f"SELECT v, s AS surface, k AS key, 'ent_' || CASE WHEN u = '' THEN 'h' || left(sha1(k), 12) WHEN length(u) > 60 THEN regexp_replace(left(u, 60), '_+$', '') || '_' || left(sha1(k), 6) ELSE u END AS id FROM (SELECT *, trim(regexp_replace({_FOLD('k')}, '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '_') AS u FROM ({_MATCH_KEY}))",
    "f11_name_tokens": VALUES_SQL + f"SELECT v, array_to_string(list_filter({_WORDS(_FOLD(_POSS), kept="''")}, lambda w: w NOT IN ('the', 'a', 'an')), '|') AS tokens FROM vals",
    "f12_subsequence": VALUES_SQL + f"SELECT v, reverse(lower(v)) LIKE {_LIKE('lower(left(v, 3))')} ESCAPE '\\' AS back, v <> '' AND lower('the ' || v) LIKE {_LIKE('lower(left(v, 9))')} ESCAPE '\\' AS inside FROM vals",
    "f25_answer_scores": VALUES_SQL + f""", words AS (SELECT v, split_part(v, ' ', 1) AS gold, {_ANSWER('v')} AS p, {_ANSWER("split_part(v, ' ', 1)")} AS g FROM vals),
  counted AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda w: least(len(list_filter(p, lambda z: z = w)), len(list_filter(g, lambda z: z = w))))), 0) AS same, len(list_distinct(list_intersect(p, g))) AS n_both FROM words)
  SELECT v AS predicted, gold, CASE WHEN p = g THEN 1.0::DOUBLE ELSE 0.0 END AS em, CASE WHEN same = 0 THEN 0.0::DOUBLE ELSE 2 * same / (len(p) + len(g)) END AS f1, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN n_both = 0 THEN 0.0 ELSE 2 * n_both / (len(list_distinct(p)) + len(list_distinct(g))) END AS set_f1 FROM counted""",
    "k16_chunk_documents": """WITH cut AS (SELECT doc_id, string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])[\\s\\v]+([A-Z0-9"“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS sentences, trim(coalesce(text, '')) AS whole FROM documents),
  packed AS (SELECT doc_id, CASE WHEN length(whole) <= 900 THEN [whole] ELSE list_reduce(list_transform(sentences, lambda s: [s]), lambda a, s: CASE WHEN a[-1] <> '' AND length(a[-1]) + 1 + length(s[1]) > 900 THEN list_concat(a, s) ELSE list_append(a[1:len(a) - 1], trim(a[-1] || ' ' || s[1])) END) END AS chunks FROM cut)
  SELECT doc_id, CAST(nth - 1 AS INTEGER) AS chunk, length(chunks[nth]) AS n_chars, md5(chunks[nth]) AS digest FROM packed, LATERAL (SELECT unnest(range(1, len(chunks) + 1)) AS nth) WHERE chunks[nth] <> ''""",
    "w16_document_titles": """WITH raws AS (SELECT doc_id, trim(regexp_extract(trim(text), '^([A-Z0-9][^\\n]{0,120}?)\\.[\\s\\v]+[A-Z]', 1)) AS raw FROM documents), bares AS (SELECT *, trim(regexp_replace(raw, '\\s*\\([^)]*\\)$', '')) AS bare FROM raws WHERE raw <> ''),
  titles AS (SELECT doc_id, CASE WHEN bare <> '' THEN bare ELSE raw END AS title FROM bares), forms AS (SELECT *, trim(title) AS a, trim(regexp_replace(title, '\\s*\\([^)]*\\)\\s*$', '')) AS b, trim(split_part(title, ',', 1)) AS c FROM titles)
  SELECT doc_id, title, array_to_string(list_filter([a, CASE WHEN b <> a THEN b ELSE '' END, CASE WHEN c NOT IN (a, b) THEN c ELSE '' END], lambda x: x <> ''), '|') AS names FROM forms""",
    "f1_possessives": VALUES_SQL + f"SELECT v, {_POSS} AS stripped FROM vals",
    "f8_conjoined": VALUES_SQL + f"SELECT v, array_to_string({_parts('v')}, '|') AS parts FROM vals",
    "f10_name_variants": VALUES_SQL + f"SELECT v, CASE WHEN {_NO_PAREN} NOT IN ('', {_BASE}) THEN {_BASE} || '|' || {_NO_PAREN} ELSE {_BASE} END AS variants FROM vals",
    "f15_kinship_phrase": VALUES_SQL + f""", said AS (SELECT v, regexp_extract({_LOWERED}, '^(?:born|borne)\\s+to\\s+(.+)$', 1) AS born, regexp_extract({_LOWERED}, '^{_KINDRED}\\s+(?:of|to)\\s+(.+)$', 1) AS noun, regexp_extract({_LOWERED}, '^{_KINDRED}\\s+(?:of|to)\\s+(.+)$', 2) AS rest FROM vals),
  told AS (SELECT v, CASE WHEN born <> '' THEN 'child' WHEN regexp_matches(rest, '^\\p{{Lu}}') THEN {_RELATION('noun')} END AS relation, CASE WHEN born <> '' THEN born ELSE rest END AS target FROM said)
  SELECT v, relation, CASE WHEN relation IS NOT NULL THEN array_to_string({_parts('target')}, '|') END AS targets FROM told""",
    "f16_bare_kin_noun": VALUES_SQL + f"SELECT v, {_RELATION(f"regexp_extract({_LOWERED}, '^{_KINDRED}$', 1)")} AS relation FROM vals",
    "f17_possessive_association": VALUES_SQL + f"SELECT v, nullif(regexp_extract(trim(v), '{_OWNER}', 1), '') AS owner, nullif(regexp_extract(trim(v), '{_OWNER}', 2), '') AS owned FROM vals",
    "f22_hop_count": VALUES_SQL + "SELECT v, CASE WHEN regexp_matches(v, '^\\dhop') THEN CAST(left(v, 1) AS INTEGER) WHEN split_part(v, '__', 1) = 'double' THEN 2 WHEN split_part(v, '__', 1) = 'triple' THEN 3 WHEN split_part(v, '__', 1) = 'quadruple' THEN 4 ELSE greatest(1, len(regexp_extract_all(CASE WHEN contains(v, '__') THEN substr(v, instr(v, '__') + 2) ELSE v END, '\\d+'))) END AS hops FROM vals",
    "p7_mentionable": VALUES_SQL + f"SELECT v, length(v) >= 4 AND regexp_matches(v, '\\p{{Lu}}') AND NOT ({_PLACEHOLDER}) AS mentionable FROM vals",
    "p10_refusals": VALUES_SQL + f"SELECT v, regexp_matches(v, '{_QUOTED(answers.REFUSAL)}') AS refusal, regexp_matches(v, '^\\s*(?:status\\s*:\\s*)?not_in_evidence\\s*$', 'i') AS status, regexp_matches(v, '{_QUOTED(answers.PREAMBLE)}') AS preamble FROM vals",
    "p12_modifiers": VALUES_SQL + f"SELECT v, lower(v) IN {lists(answers.MODIFIERS)} OR starts_with(lower(v), ':argm-') AS modifier FROM vals",
    "p1_is_date_like": VALUES_SQL + _DATE,
    "p2_numeric_quantity": VALUES_SQL + "SELECT v, regexp_matches(v, '\\d,\\d{3}') AS quantity FROM vals",
    "p3_placeholder": VALUES_SQL + f"SELECT v, regexp_matches(lower(v), '\\(({'|'.join(v.INVENTED)})\\)') OR lower(trim(regexp_replace(trim(trim(v), '.,;:\"'''), '^(?:the|a|an)\\s+', '', 'i'))) IN {lists(('', *v.PLACEHOLDERS))} AS placeholder FROM vals",
    "p5_frame_contract": VALUES_SQL + f"SELECT v, {_KEY} IN {lists(v.FRAME_VERBS['locate.01'])} AS locates, {_KEY} IN {lists(v.FRAME_VERBS['found.01'])} AS founds, true AS runs FROM vals",
    "p14_capitalised": VALUES_SQL + "SELECT v, regexp_matches(v, '^[\\p{Lu}\\p{Nd}]') AS capitalised FROM vals",
    "f7_lower_first": VALUES_SQL + "SELECT v, lower(left(trim(v), 1)) || substr(trim(v), 2) AS lowered FROM vals",
    "f14_place_parts": VALUES_SQL + _PLACE,
    "f19_stem": VALUES_SQL + f"SELECT v, {_STEM('lower(v)')} AS stem FROM vals",
    "f20_document_stems": f"""SELECT doc_id, len(s) AS n_stems, md5(array_to_string(s, '|')) AS stems FROM (SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: length(w) > 2 AND lower(w) NOT IN {lists(v.RELEVANCE_STOP)}), lambda w: {_STEM('lower(w)')}))) AS s FROM documents)""",
    "f21_lemma_key": VALUES_SQL + f"SELECT v, {_KEY} AS key FROM vals",
    "f28_clean_prediction": VALUES_SQL + "SELECT v, CASE WHEN a = 'NOT_IN_EVIDENCE' THEN '' ELSE a END AS answer FROM (SELECT v, trim(regexp_replace(v, '^(?:ANSWER|STATUS)\\s*:\\s*', '')) AS a FROM vals)",
    "f29_source_index": VALUES_SQL + "SELECT v, try_cast(nullif(regexp_extract(v, ':(\\d+)$', 1), '') AS BIGINT) AS idx FROM vals",
    "f33_relations": VALUES_SQL + "SELECT v, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(v), '\\b(?:{'|'.join(x)})\\b') THEN '{k}' END" for k, x in t.RELATION_TERMS.items()) + "], lambda x: x IS NOT NULL), '|') AS relations FROM vals",
    "c2_order_years": "SELECT o_orderkey, year(o_orderdate) AS start_year, year(o_orderdate + INTERVAL 18 MONTH) AS end_year FROM orders",
    "c6_sense_id": VALUES_SQL + f"SELECT v, CASE WHEN l = '' THEN 'event' ELSE l END || '.' || CASE WHEN n = '' THEN '01' ELSE lpad(n, 2, '0') END AS sense FROM (SELECT v, {_SENSE} AS l, regexp_extract({_CLEAN}, '[.\\-_](\\d{{1,2}})$', 1) AS n FROM vals)",
    "c9_role_for_key": VALUES_SQL + f"SELECT v, {_ROLE} AS role FROM (SELECT v, string_split_regex(lower(v), '[^a-z]+') AS w FROM vals)",
    "c13_relation": VALUES_SQL + f"SELECT v, CASE WHEN r IN {lists([f':{x}' for x in v.RELATIONS])} THEN r WHEN contains(r, 'before') OR contains(r, 'prior') THEN ':before' WHEN contains(r, 'after') THEN ':after' ELSE ':cause' END AS relation FROM (SELECT v, {_REL} AS r FROM vals)",
}
