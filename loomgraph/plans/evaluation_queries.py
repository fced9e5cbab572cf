"""Queries of retrieval, aggregates and statistics over the text and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import hops, retrieval, stats
from loomgraph.plans.text_queries import lists
from loomgraph.session import table

TOP, RESAMPLES = 10, 10_000


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def _names(spark, sf):
    """Names to find: the first three words of each item, as they stand there."""
    first = F.regexp_extract("text", r"(?U)^\W*(\w+\W+\w+\W+\w+)", 1)
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("name_id"), F.coalesce(first, F.lit("")).alias("name"))


def a8_term_weights(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.term_weights(*retrieval.postings(table(spark, sf, "documents")))[0].select("term", "df", F.round("idf", 6).alias("idf"))


def e7_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf, "documents"), _questions(spark, sf)).select("question_id", "doc_id", F.round("score", 6).alias("score"))


def k6_bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieval.top_k(retrieval.bm25(table(spark, sf, "documents"), _questions(spark, sf)), TOP)
    return best.select("question_id", "doc_id", "rank")


def j9_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.mentions(table(spark, sf, "documents"), _names(spark, sf)).select("doc_id", "name_id")


def _links(spark, sf):
    """Title links: a document that begins with the name; mention links: one that has it."""
    found = retrieval.mentions(table(spark, sf, "documents"), _names(spark, sf)).withColumnRenamed("name_id", "question_id")
    docs = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"))
    near = found.join(docs, "doc_id")
    return near.where("lines < 5").select("question_id", "doc_id", F.lit(1).alias("dist")), near.select("question_id", "doc_id", F.when(F.col("lines") < 20, 1).otherwise(2).alias("dist"))


def k5_best_link(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.best_links(*_links(spark, sf))


def k4_source_rank(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.source_ranks(retrieval.best_links(*_links(spark, sf)))


def k7_graph_then_bm25(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieval.top_k(retrieval.bm25(table(spark, sf, "documents"), _questions(spark, sf)), TOP)
    return retrieval.filled(k4_source_rank(spark, sf), best, TOP)


def k8_passages(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieval.top_k(retrieval.bm25(table(spark, sf, "documents"), _questions(spark, sf)), TOP)
    return retrieval.passages(best, table(spark, sf, "documents"), 4000).select("question_id", "n_passages", F.md5("text").alias("digest"))


def _paragraphs(spark, sf):
    """Twenty questions, the others' documents as their paragraphs, by remainder."""
    d = table(spark, sf, "documents")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    title = F.concat(F.array_join(F.slice(words, 1, 2), " "), F.when(F.col("doc_id") % 3 == 0, " (film)").otherwise(""))
    rows = d.select((F.col("doc_id") % 20).alias("question_id"), F.col("doc_id").alias("ord"), title.alias("title"), "text", words.alias("w"))
    first = rows.where("ord < 20").withColumn("w", F.when(F.size("w") > 7, F.col("w")).otherwise(F.array(*map(F.lit, "one two three four five six seven eight".split()))))
    text = F.concat_ws(" ", F.lit("Which director was born in"), F.element_at("w", 1), F.element_at("w", 2), F.lit("near the"), F.element_at("w", 4), F.lit("club of"), F.element_at("w", 6))
    return first.select("question_id", text.alias("text")), rows.drop("w"), first.select("question_id", F.explode(F.array(F.concat_ws(" ", F.element_at("w", 3)), F.concat_ws(" ", F.element_at("w", 1), F.element_at("w", 2)), F.element_at("w", 5))).alias("name"))


def k9_first_hop(spark: SparkSession, sf: str) -> DataFrame:
    q, p, _ = _paragraphs(spark, sf)
    return hops.first_hop(q, p, 3).select("question_id", "ord", F.round("score", 6).alias("score"), "rank")


def k10_second_hop(spark: SparkSession, sf: str) -> DataFrame:
    q, p, b = _paragraphs(spark, sf)
    return hops.second_hop(q, b, p, 3).select("question_id", "ord", F.round("score", 6).alias("score"), "rank")


def j10_title_links(spark: SparkSession, sf: str) -> DataFrame:
    """Names of suppliers and nations as titles, with and without what follows them."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" (company)"))).otherwise(F.concat("s_name", F.lit(", Asia"))).alias("title"))
    e = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("question_id"), text.match_key(F.col("s_name")).alias("key"), (F.col("s_suppkey") % 3).alias("dist"))
    return hops.title_links(s, e)


def j11_stored_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links between an order's lines, of which some were stored in several parts."""
    l = table(spark, sf, "lineitem").select(F.lit("g").alias("graph_id"), F.col("l_orderkey").alias("source"), F.lit(0).alias("chunk"), "l_linenumber").distinct()
    links = l.select("graph_id", "source", "chunk", F.col("l_linenumber").alias("source_id"), (F.col("l_linenumber") + 1).alias("target_id"), F.lit(":before").alias("relation"))
    stored = l.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("l_linenumber") % 2))).select("graph_id", "source", "chunk", F.col("l_linenumber").alias("original_id"), "part", F.concat_ws(":", "source", "l_linenumber", "part").alias("stored_id"))
    return hops.stored_links(links, stored).drop("graph_id")


def _labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


def a1_means(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(stats.mean_or_nan(F.col("value")), 6).alias("mean"), F.round(stats.mean_or_nan(F.when(F.col("value") < -1e9, F.col("value"))), 6).alias("none"))


def a3_system_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as systems: size, quality and toxicity in percent, characters a document."""
    return _labelled(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.round(100 * F.avg("quality"), 6).alias("em"), F.round(100 * F.avg(F.when(F.col("toxic") == 0, F.col("quality"))), 6).alias("support"), F.round(100 * F.avg("toxic"), 6).alias("refusal_rate"), F.round(F.avg("n_chars"), 6).alias("chars"))


def a5_conditional_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, and accuracy among what is correct only."""
    return _labelled(spark, sf).groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("precision"), F.round(F.avg(F.when(F.col("quality") == 1, 1 - F.col("toxic"))), 6).alias("accuracy"), F.countDistinct("source").alias("sources"))


def a9_outcome_shares(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("event_type", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def a11_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(100 * F.avg("quality"), 6))
    return rows.select("source", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("de", "en", "es", "fr")])


def a14_upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), stats.upper_median("value").alias("median"))


def a16_link_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return k4_source_rank(spark, sf).where(F.col("rank") <= TOP).groupBy("question_id").agg(F.count_if(F.col("kind") == 0).alias("titles"), F.count_if(F.col("kind") == 1).alias("mentions"))


def a17_support_sets(spark: SparkSession, sf: str) -> DataFrame:
    cited = table(spark, sf, "lineitem").select("l_orderkey", F.regexp_extract(F.concat(F.lit("part:"), "l_partkey"), r":(\d+)$", 1).cast("bigint").alias("idx"))
    return cited.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("idx")), ",").alias("support"))


def j12_paired_systems(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases of a customer in two years, paired."""
    by = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return by.where("y = 1995").select("o_custkey", F.col("n").alias("a")).join(by.where("y = 1996").select("o_custkey", F.col("n").alias("b")), "o_custkey")


def j13_seen_by_all(spark: SparkSession, sf: str) -> DataFrame:
    """Users with every type of event."""
    e = table(spark, sf, "events")
    kinds = e.agg(F.countDistinct("event_type").alias("k"))
    return e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).join(F.broadcast(kinds)).where("n = k").select("user_id", "n")


def j15_unfinished(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


def j16_role_runs(spark: SparkSession, sf: str) -> DataFrame:
    return stats.runs(table(spark, sf, "conversations"), ["conv_id"], "turn", "role").groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


def k14_holm(spark: SparkSession, sf: str) -> DataFrame:
    """Adjusted p of McNemar tests of quality against toxicity, by source."""
    tests = r3_mcnemar(spark, sf).select(F.lit("all").alias("family"), F.col("grp").alias("name"), "p")
    return stats.holm(tests).select("name", F.round("adjusted", 6).alias("adjusted"))


def _pairs(spark, sf, kind):
    return _labelled(spark, sf).select(F.col("source").alias("grp"), F.col("quality").cast(kind).alias("a"), F.col("toxic").cast(kind).alias("b"))


def r1_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    values = _labelled(spark, sf).select(F.col("lang").alias("grp"), F.col("quality").cast("double").alias("value"))
    return stats.bootstrap_interval(values, RESAMPLES).select("grp", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def r2_paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _labelled(spark, sf).select(F.col("lang").alias("grp"), F.col("quality").cast("double").alias("a"), (1.0 - F.col("toxic")).alias("b"))
    return stats.paired_bootstrap(pairs, RESAMPLES).select("grp", F.round("delta", 6).alias("delta"), "p")


def r3_mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mcnemar(_pairs(spark, sf, "boolean")).select("grp", "b01", "b10", F.round("p", 9).alias("p"))


def r4_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return stats.kappa(_pairs(spark, sf, "int")).select("grp", "n", F.round("kappa", 6).alias("kappa"))


def r9_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return stats.seeded_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 50, 13)


def d5_not_in_development(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "documents").select("doc_id")
    return ids.exceptAll(stats.seeded_sample(ids, "doc_id", 50, 13))


def d7_first_by_title(spark: SparkSession, sf: str) -> DataFrame:
    """The first part of each name."""
    return table(spark, sf, "part").groupBy(F.lower("p_name").alias("title")).agg(F.min("p_partkey").alias("p_partkey"))


QUERIES = {f.__name__: f for f in (k9_first_hop, k10_second_hop, j10_title_links, j11_stored_links, a1_means, a3_system_summary, a5_conditional_measures, a8_term_weights, a9_outcome_shares, a11_pivot, a14_upper_median, a16_link_kinds, a17_support_sets, e7_bm25, k6_bm25_top, j9_mentions, k4_source_rank, k5_best_link, k7_graph_then_bm25, k8_passages, j12_paired_systems, j13_seen_by_all, j15_unfinished, j16_role_runs, k14_holm, r1_bootstrap, r2_paired_bootstrap, r3_mcnemar, r4_kappa, r9_seeded_sample, d5_not_in_development, d7_first_by_title)}

_W = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_WORDS = f"list_filter({_W}, lambda w: w NOT IN {lists(retrieval.STOP)})"
_POST = f"""split AS (SELECT doc_id, {_WORDS} AS w FROM documents), lens AS (SELECT doc_id, len(w) AS length FROM split),
posted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM split) GROUP BY 1, 2),
size AS (SELECT count(*) AS n, avg(length) AS avgdl FROM lens),
weights AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM posted GROUP BY 1), size)"""
_BM25 = _POST + f""", asked AS (SELECT item_id AS question_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY 1, 2),
scores AS (SELECT question_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END))) AS score FROM asked JOIN posted USING (term) JOIN weights USING (term) JOIN lens USING (doc_id), size GROUP BY 1, 2),
best AS (SELECT question_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= {TOP})"""
_WORD = "[\\p{L}\\p{N}_]"
_NOT = "[^\\p{L}\\p{N}_]"
_MENTION = f"""names AS (SELECT item_id AS name_id, lower(regexp_extract(text, '^{_NOT}*({_WORD}+{_NOT}+{_WORD}+{_NOT}+{_WORD}+)', 1)) AS name FROM benchmark),
mentions AS MATERIALIZED (SELECT doc_id, name_id, len(string_split(text, chr(10))) AS lines FROM documents JOIN names ON contains(lower(text), name) WHERE name <> '' AND regexp_matches(lower(text), '(?:^|{_NOT})' || regexp_escape(name) || '(?:$|{_NOT})'))"""
_LINKS = _MENTION + """, links AS (SELECT name_id AS question_id, doc_id, 1 AS dist, 0 AS kind FROM mentions WHERE lines < 5 UNION ALL SELECT name_id, doc_id, CASE WHEN lines < 20 THEN 1 ELSE 2 END, 1 FROM mentions),
best_link AS (SELECT question_id, doc_id, l.dist AS dist, l.kind AS kind FROM (SELECT question_id, doc_id, min({'dist': dist, 'kind': kind}) AS l FROM links GROUP BY 1, 2)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dist, kind, doc_id) AS rank FROM best_link)"""
_LABELLED = "labelled AS (SELECT l.doc_id, quality, toxic, lang, source, n_chars FROM labels l JOIN documents d USING (doc_id))"
_COMB = "SELECT source AS grp, count(*) FILTER (quality = 0 AND toxic = 1) AS b01, count(*) FILTER (quality = 1 AND toxic = 0) AS b10 FROM labelled GROUP BY 1"
_TAIL = "list_sum(list_transform(range(0, least(b01, b10) + 1), lambda i: exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1) - (b01 + b10) * ln(2))))"
_MCNEMAR = _LABELLED + f", tests AS (SELECT grp, b01, b10, round(CASE WHEN b01 + b10 = 0 THEN 1.0 ELSE least(1.0, 2 * {_TAIL}) END, 9) AS p FROM ({_COMB}))"


def _mixed(source: str) -> str:
    """`source` with its column x hashed as `stats` hashes draws."""
    for _ in range(2):
        source = f"SELECT * REPLACE ((xor(x >> 16, x) * {stats.MULTIPLIER}) & {stats.MASK} AS x) FROM ({source})"
    return f"SELECT * REPLACE (xor(x >> 16, x) AS x) FROM ({source})"


def means_sql(values: str, resamples: int = RESAMPLES) -> str:
    """means (grp, b, mean) of resamples of (grp, value), draw by draw."""
    return f"""vals AS ({values}), places AS MATERIALIZED (SELECT grp, value, row_number() OVER (PARTITION BY grp ORDER BY value) - 1 AS place FROM vals WHERE grp IS NOT NULL AND value IS NOT NULL),
ns AS (SELECT grp, count(*) AS n, ('0x' || left(md5('0:' || grp), 8))::BIGINT AS g FROM places GROUP BY 1),
bs AS ({_mixed(f"SELECT b, b AS x FROM range(0, {resamples}) t(b)")}), keyed AS MATERIALIZED ({_mixed("SELECT grp, n, b, xor(g, x) AS x FROM ns, bs")}),
numbered AS ({_mixed("SELECT grp, n, b, x AS key, unnest(range(0, n)) AS x FROM keyed")}),
drawn AS (SELECT grp, b, (x * n) >> 32 AS place FROM ({_mixed("SELECT grp, n, b, xor(key, x) AS x FROM numbered")})),
means AS (SELECT grp, b, avg(value) AS mean FROM drawn JOIN places USING (grp, place) GROUP BY 1, 2)"""


def interval_sql(resamples: int = RESAMPLES) -> str:
    """(grp, lo, hi) from `means`."""
    return f"SELECT grp, max(mean) FILTER (r = {int(0.025 * resamples)}) AS lo, max(mean) FILTER (r = {min(resamples - 1, int(0.975 * resamples))}) AS hi FROM (SELECT grp, mean, row_number() OVER (PARTITION BY grp ORDER BY mean) - 1 AS r FROM means) GROUP BY 1"


def paired_sql(pairs: str, resamples: int = RESAMPLES) -> str:
    """paired (grp, delta, p) of (grp, a, b) in the relation `pairs`."""
    return f"""deltas AS (SELECT grp, avg(a - b) AS delta FROM {pairs} GROUP BY 1), {means_sql(f"SELECT grp, a - b - delta AS value FROM {pairs} JOIN deltas USING (grp)", resamples)},
paired AS (SELECT grp, delta, (count(*) FILTER (abs(mean) >= abs(delta) - 1e-12) + 1) / {resamples + 1} AS p FROM means JOIN deltas USING (grp) GROUP BY 1, 2)"""


_CONTENT = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')), lambda w: w NOT IN {lists(hops.QUESTION_STOP)})"
_MEDIUM = " OR ".join(f"contains(lower(title), '({k}')" for k in hops.MEDIA["director"])
_HOPS = f"""base AS (SELECT doc_id % 20 AS question_id, doc_id AS ord, text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents),
paragraphs AS (SELECT question_id, ord, text, array_to_string(w[1:2], ' ') || CASE WHEN ord % 3 = 0 THEN ' (film)' ELSE '' END AS title FROM base),
firsts AS (SELECT question_id, CASE WHEN len(w) > 7 THEN w ELSE ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight'] END AS w FROM base WHERE ord < 20),
asked AS (SELECT question_id, 'Which director was born in ' || w[1] || ' ' || w[2] || ' near the ' || w[4] || ' club of ' || w[6] AS q, w FROM firsts),
titled AS (SELECT *, trim(regexp_replace(lower(trim(title)), '\\s*\\(.*?\\)', '', 'g')) AS clean FROM paragraphs QUALIFY clean <> '' AND row_number() OVER (PARTITION BY question_id, clean ORDER BY ord) = 1),
terms AS (SELECT question_id, list_distinct(flatten(list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(q), '\\b(?:{'|'.join(x)})\\b') THEN [{', '.join(repr(y) for y in x)}] END" for x in text.RELATION_TERMS.values())}], lambda z: z IS NOT NULL))) AS terms FROM asked)"""
_PICK = "SELECT question_id, ord, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, ord) AS rank FROM scored) WHERE rank <= 3 AND score >= {least} - 1e-9"
ORACLES = {
    "k9_first_hop": f"""WITH {_HOPS}, scored AS (SELECT question_id, ord, 0.30 * greatest(CASE WHEN contains(lower(q), clean) THEN 1 ELSE 0 END, least(len(list_filter(regexp_extract_all(q, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b'), lambda e: contains(clean, lower(e)))), 2) / 2)
  + 0.35 * least(len(list_intersect({_CONTENT('q')}, {_CONTENT('text')})), 5) / 5 + 0.25 * least(len(list_intersect(terms, {_CONTENT('text')})), 3) / 3 + 0.10 * CASE WHEN {_MEDIUM} THEN 1 ELSE 0 END AS score FROM titled JOIN asked USING (question_id) JOIN terms USING (question_id)) """
    + _PICK.format(least=0.2),
    "k10_second_hop": f"""WITH {_HOPS}, bridges AS (SELECT DISTINCT question_id, q, lower(b) AS bridge FROM (SELECT question_id, q, unnest([w[3], w[1] || ' ' || w[2], w[5]]) AS b FROM asked)),
open_ AS (SELECT * FROM bridges WHERE length(bridge) > 2 AND bridge NOT IN {lists(hops.QUESTION_STOP)} AND NOT contains(lower(q), bridge) AND NOT (len({_CONTENT('bridge')}) > 0 AND len(list_filter({_CONTENT('bridge')}, lambda z: NOT list_contains({_CONTENT('q')}, z))) = 0)),
met AS (SELECT question_id, ord, max(CASE WHEN contains(clean, bridge) OR length(clean) > 3 AND contains(bridge, clean) THEN 1.0 ELSE 0.0 END) AS in_title, max(CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_])' || bridge || '($|[^\\p{{L}}\\p{{N}}_])') THEN 1.0 ELSE 0.0 END) AS in_body FROM titled JOIN open_ USING (question_id) GROUP BY 1, 2),
scored AS (SELECT question_id, ord, 0.40 * coalesce(in_title, 0) + 0.35 * coalesce(in_body, 0) + 0.25 * least(len(list_intersect(terms, {_CONTENT('text')})), 3) / 3 AS score FROM titled JOIN terms USING (question_id) LEFT JOIN met USING (question_id, ord)) """
    + _PICK.format(least=0.25),
    "j10_title_links": "SELECT s_nationkey AS question_id, s_suppkey AS doc_id, s_suppkey % 3 AS dist FROM supplier",
    "j11_stored_links": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT a.l_orderkey || ':' || a.l_linenumber || ':0' AS src_event, b.l_orderkey || ':' || b.l_linenumber || ':0' AS dst_event, ':before' AS relation FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    "a1_means": "SELECT event_type, round(avg(value), 6) AS mean, coalesce(round(avg(CASE WHEN value < -1e9 THEN value END), 6), 'nan'::DOUBLE) AS none FROM events GROUP BY 1",
    "a3_system_summary": f"WITH {_LABELLED} SELECT source, count(*) AS n, round(100 * avg(quality), 6) AS em, round(100 * avg(CASE WHEN toxic = 0 THEN quality END), 6) AS support, round(100 * avg(toxic), 6) AS refusal_rate, round(avg(n_chars), 6) AS chars FROM labelled GROUP BY 1",
    "a5_conditional_measures": f"WITH {_LABELLED} SELECT lang, round(avg(quality), 6) AS precision, round(avg(CASE WHEN quality = 1 THEN 1 - toxic END), 6) AS accuracy, count(DISTINCT source) AS sources FROM labelled GROUP BY 1",
    "a8_term_weights": f"WITH {_POST} SELECT term, df, round(idf, 6) AS idf FROM weights",
    "a9_outcome_shares": "SELECT event_type, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1",
    "a11_pivot": f"WITH {_LABELLED} SELECT source, " + ", ".join(f"coalesce(round(100 * avg(quality) FILTER (lang = '{c}'), 6), -1.0) AS {c}" for c in ("de", "en", "es", "fr")) + " FROM labelled GROUP BY 1",
    "a14_upper_median": "SELECT event_type, n, value AS median FROM (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r FROM events) WHERE r = n // 2 + 1",
    "a16_link_kinds": f"WITH {_LINKS} SELECT question_id, count(*) FILTER (kind = 0) AS titles, count(*) FILTER (kind = 1) AS mentions FROM ranked WHERE rank <= {TOP} GROUP BY 1",
    "a17_support_sets": "SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS support FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1".replace("DISTINCT l_partkey::VARCHAR", "l_partkey::VARCHAR"),
    "e7_bm25": f"WITH {_BM25} SELECT question_id, doc_id, round(score, 6) AS score FROM scores",
    "k6_bm25_top": f"WITH {_BM25} SELECT question_id, doc_id, rank FROM best",
    "j9_mentions": f"WITH {_MENTION} SELECT doc_id, name_id FROM mentions",
    "k4_source_rank": f"WITH {_LINKS} SELECT question_id, doc_id, dist, kind, rank FROM ranked",
    "k5_best_link": f"WITH {_LINKS} SELECT question_id, doc_id, dist, kind FROM best_link",
    "k7_graph_then_bm25": f"WITH {_LINKS}, {_BM25}, both_ AS (SELECT question_id, doc_id, 0 AS p, rank FROM ranked UNION ALL SELECT question_id, doc_id, 1, rank FROM best), once AS (SELECT question_id, doc_id, min({{'p': p, 'rank': rank}}) AS place FROM both_ GROUP BY 1, 2) SELECT * FROM (SELECT question_id, doc_id, place.p = 0 AS from_graph, row_number() OVER (PARTITION BY question_id ORDER BY place) AS rank FROM once) WHERE rank <= {TOP}",
    "k8_passages": f"WITH {_BM25}, sized AS (SELECT b.question_id, b.rank, d.text, sum(length(d.text) + 2) OVER (PARTITION BY question_id ORDER BY rank) AS cum FROM best b JOIN documents d USING (doc_id)) SELECT question_id, count(*) AS n_passages, md5(string_agg(left(text, 4000), chr(10) || chr(10) ORDER BY rank)) AS digest FROM sized WHERE cum <= 4000 OR rank = 1 GROUP BY 1",
    "j12_paired_systems": "WITH t AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.o_custkey, a.n AS a, b.n AS b FROM t a JOIN t b USING (o_custkey) WHERE a.y = 1995 AND b.y = 1996",
    "j13_seen_by_all": "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)",
    "j15_unfinished": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j16_role_runs": "SELECT conv_id, run, role, min(turn) AS first_turn, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations)) GROUP BY 1, 2, 3",
    "k14_holm": f"WITH {_MCNEMAR} SELECT grp AS name, round(max(step) OVER (ORDER BY p, grp), 6) AS adjusted FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, grp) + 1) * p) AS step FROM tests)",
    "r1_bootstrap": f"WITH {_LABELLED}, {means_sql('SELECT lang AS grp, quality::DOUBLE AS value FROM labelled')} SELECT grp, round(lo, 9) AS lo, round(hi, 9) AS hi FROM ({interval_sql()})",
    "r2_paired_bootstrap": f"WITH {_LABELLED}, both_sides AS (SELECT lang AS grp, quality::DOUBLE AS a, 1.0::DOUBLE - toxic AS b FROM labelled), {paired_sql('both_sides')} SELECT grp, round(delta, 6) AS delta, p FROM paired",
    "r3_mcnemar": f"WITH {_MCNEMAR} SELECT grp, b01, b10, p FROM tests",
    "r4_kappa": f"WITH {_LABELLED} SELECT grp, n, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT source AS grp, count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po, (sum(quality) * sum(toxic) + sum(1 - quality) * sum(1 - toxic)) / (count(*) * count(*)) AS pe FROM labelled GROUP BY 1)",
    "r9_seeded_sample": "SELECT doc_id FROM documents ORDER BY md5('13:' || doc_id), doc_id LIMIT 50",
    "d5_not_in_development": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY md5('13:' || doc_id), doc_id LIMIT 50)",
    "d7_first_by_title": "SELECT lower(p_name) AS title, min(p_partkey) AS p_partkey FROM part GROUP BY 1",
}
