"""Ranking of documents by a question: from its text over anchors and search to event, title and mention links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import engine, evidence, ingest, retrieval
from loomgraph.plans import fixture
from loomgraph.plans import graph_queries as gq
from loomgraph.plans.ingest_queries import MEANING
from loomgraph.session import table
from loomgraph.storage import materialised

HOPS, HUB = 2, 12


def _suppliers(spark, sf):
    """Suppliers with their nation, region, and the names of the next and of the seventh after it."""
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    placed = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("k"), "s_name", "n_name", "r_name")
    after = lambda step, name: s.select((F.col("s_suppkey") - step).alias("k"), F.col("s_name").alias(name))
    return placed.join(after(1, "next_name"), "k", "left").join(after(7, "far_name"), "k", "left")


def _events(spark, sf) -> DataFrame:
    """Every supplier is located in a nation, every second one supplies the next; nations are located in regions."""
    s, n, r = _suppliers(spark, sf), table(spark, sf, "nation"), table(spark, sf, "region")
    locate = F.struct(F.lit("lie").alias("lemma"), F.lit("locate.01").alias("sense_id"), F.create_map(F.lit(":ARG1"), "s_name", F.lit(":ARG2"), "n_name").alias("roles"))
    supply = F.struct(F.lit("deliver").alias("lemma"), F.lit("supply.01").alias("sense_id"), F.create_map(F.lit(":ARG0"), "s_name", F.lit(":ARG1"), "next_name").alias("roles"))
    own = F.array_compact(F.array(locate, F.when((F.col("k") % 2 == 0) & F.col("next_name").isNotNull(), supply)))
    first = s.select(fixture.tag("supplier", "k").alias("source"), F.col("k").cast("bigint").alias("at"), F.posexplode(own).alias("part", "e")).select("source", "at", "part", "e.*")
    land = F.create_map(F.lit(":ARG1"), "n_name", F.lit(":ARG2"), "r_name")
    second = n.join(r, n.n_regionkey == r.r_regionkey).select(fixture.tag("nation", "n_nationkey").alias("source"), (F.col("n_nationkey") + (1 << 40)).alias("at"), F.lit(0).alias("part"), F.lit("lie").alias("lemma"), F.lit("locate.01").alias("sense_id"), land.alias("roles"))
    both = first.unionByName(second)
    said = F.struct(F.col("source").alias("source"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_speculative"))
    none = "struct<raw_expression:string,start_year:bigint,end_year:bigint>", "struct<location_name:string,parent_region:string>"
    ids = F.concat_ws(":", "source", "part")
    return both.select(F.lit("g").alias("graph_id"), (F.col("at") * 2 + F.col("part")).alias("ord"), "source", F.lit("0").alias("chunk"), ids.alias("original_id"), ids.alias("event_id"), "lemma", "sense_id", "roles", F.lit(None).cast(none[0]).alias("time_context"), F.lit(None).cast(none[1]).alias("spatial_context"), said.alias("epistemic_context"))


def _docs(spark, sf) -> DataFrame:
    """An article about each supplier, which mentions another one, and one about each nation."""
    k = F.col("k")
    title = F.when(k % 3 == 0, F.concat("s_name", F.lit(" (company)"))).when(k % 3 == 1, F.concat("s_name", F.lit(", "), "n_name")).otherwise(F.concat(F.lit("Report "), k))
    text = F.concat(F.lit("A note on "), F.coalesce(F.when(k % 2 == 0, F.upper("far_name")).otherwise(F.concat("far_name", F.lit("0"))), F.lit("nobody")), F.lit("."))
    first = _suppliers(spark, sf).select(fixture.tag("supplier", "k").alias("doc_id"), k.cast("bigint").alias("ord"), title.alias("title"), text.alias("text"))
    second = table(spark, sf, "nation").select(fixture.tag("nation", "n_nationkey").alias("doc_id"), (F.col("n_nationkey") + (1 << 40)).alias("ord"), F.col("n_name").alias("title"), F.concat(F.lit("Trade of \""), F.lower("n_name"), F.lit("\"")).alias("text"))
    return first.unionByName(second)


def e5_ranked_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for a question about every supplier."""
    tables = ingest.ingested(_events(spark, sf))
    questions = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("question_id"), F.concat(F.lit("Which firms trade with "), "s_name", F.lit(" today?")).alias("text"))
    return retrieval.ranked_sources(questions, tables, _docs(spark, sf), HOPS, HUB)


#: Switches that are turned one at a time.
TURNED = ("role_labels", "triples_only", "candidates", "relevance_ranking")


def t4_switched_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence about every supplier, as it is and with a switch turned; without ranking only which events are told."""
    tables = {name: materialised(rows) for name, rows in ingest.ingested(_events(spark, sf)).items()}
    questions = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("question_id"), F.concat(F.lit("Where is "), "s_name", F.lit(" located?")).alias("text"))
    out = None
    for name in ("none", *TURNED):
        changed = {} if name == "none" else {name: not engine.SWITCHES[name]}
        found = engine.evidence_for(questions, tables, engine.switched(**changed), hub_degree=HUB, max_hops=1)
        one = found.select(F.lit(name).alias("switch"), "question_id", F.array_join("event_ids", "|").alias("event_ids"), (F.lit("") if name == "relevance_ranking" else F.col("text")).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (e5_ranked_sources, t4_switched_evidence)}
_SQL = f"""placed AS (SELECT s.s_suppkey AS k, s.s_name, n_name, r_name, a.s_name AS next_name, b.s_name AS far_name FROM supplier s JOIN nation ON s.s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier a ON a.s_suppkey = s.s_suppkey + 1 LEFT JOIN supplier b ON b.s_suppkey = s.s_suppkey + 7),
pairs AS (SELECT 'supplier:' || k AS source, 'supplier:' || k || ':0' AS event_id, 'locate.01' AS sense, s_name AS e1, n_name AS e2 FROM placed
  UNION ALL SELECT 'supplier:' || k, 'supplier:' || k || ':1', 'supply.01', s_name, next_name FROM placed WHERE k % 2 = 0 AND next_name IS NOT NULL
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey || ':0', 'locate.01', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
bindings AS MATERIALIZED (SELECT source, event_id, sense, e1 AS entity FROM pairs UNION ALL SELECT source, event_id, sense, e2 FROM pairs),
degrees AS (SELECT entity, count(*) AS degree FROM bindings GROUP BY 1),
docs AS (SELECT 'supplier:' || k AS doc_id, k AS ord, CASE k % 3 WHEN 0 THEN s_name || ' (company)' WHEN 1 THEN s_name || ', ' || n_name ELSE 'Report ' || k END AS title, CASE k % 3 WHEN 0 THEN [s_name || ' (company)', s_name] WHEN 1 THEN [s_name || ', ' || n_name, s_name] ELSE ['Report ' || k] END AS forms,
  'A note on ' || coalesce(CASE WHEN k % 2 = 0 THEN upper(far_name) ELSE far_name || '0' END, 'nobody') || '.' AS text FROM placed
  UNION ALL SELECT 'nation:' || n_nationkey, n_nationkey + 1099511627776, n_name, [n_name], 'Trade of "' || lower(n_name) || '"' FROM nation)"""
_ASKED = "SELECT s_suppkey AS question_id, s_name AS entity FROM supplier"
_BINDINGS = """ords AS (SELECT *, CASE WHEN starts_with(source, 'nation') THEN 1099511627776 + CAST(split_part(source, ':', 2) AS BIGINT) ELSE CAST(split_part(source, ':', 2) AS BIGINT) END * 2 + CAST(split_part(event_id, ':', 3) AS BIGINT) AS ord, CASE sense WHEN 'locate.01' THEN 'lie' ELSE 'deliver' END AS lemma FROM pairs),
bindings AS MATERIALIZED (SELECT event_id, ord, lemma, sense, CASE sense WHEN 'locate.01' THEN ':ARG1' ELSE ':ARG0' END AS role, e1 AS entity FROM ords UNION ALL SELECT event_id, ord, lemma, sense, CASE sense WHEN 'locate.01' THEN ':ARG2' ELSE ':ARG1' END, e2 FROM ords)"""
ORACLES = {
    "e5_ranked_sources": f"""WITH RECURSIVE {_SQL}, {fixture.walk_sql(_ASKED, HOPS, HUB)},
by_event AS (SELECT question_id, source AS doc_id, min(dist) AS dist, 0 AS kind FROM events_at JOIN (SELECT DISTINCT event_id, source FROM bindings) USING (event_id) GROUP BY 1, 2),
titles AS (SELECT doc_id, unnest(forms) AS form, generate_subscripts(forms, 1) AS pos FROM docs),
by_title AS (SELECT question_id, doc_id, arg_min(dist.dist, pos) AS dist, 1 AS kind FROM titles JOIN dist ON entity = form GROUP BY 1, 2),
frontier AS (SELECT question_id, entity, dist.dist FROM dist JOIN degrees USING (entity) WHERE (dist.dist = 0 OR degree <= {HUB}) AND length(entity) >= 4),
met AS (SELECT doc_id, entity FROM docs JOIN (SELECT DISTINCT entity FROM frontier) ON regexp_matches(lower(text), '(^|[^a-z0-9_])' || regexp_escape(lower(entity)) || '($|[^a-z0-9_])')),
by_mention AS (SELECT question_id, doc_id, min(dist) AS dist, 2 AS kind FROM met JOIN frontier USING (entity) GROUP BY 1, 2),
links AS (SELECT * FROM by_event UNION ALL SELECT * FROM by_title UNION ALL SELECT * FROM by_mention),
best AS (SELECT question_id, doc_id, min({{'dist': dist, 'kind': kind}}) AS l FROM links GROUP BY 1, 2)
SELECT question_id, doc_id, l.dist AS dist, l.kind AS kind, row_number() OVER (PARTITION BY question_id ORDER BY l.dist, l.kind, ord) AS rank FROM best JOIN docs USING (doc_id)""",
    "t4_switched_evidence": f"""WITH RECURSIVE {_SQL.replace("bindings AS MATERIALIZED (SELECT source, event_id, sense, e1 AS entity FROM pairs UNION ALL SELECT source, event_id, sense, e2 FROM pairs)", _BINDINGS)}, questions AS (SELECT s_suppkey AS question_id, 'Where is ' || s_name || ' located?' AS text FROM supplier),
{fixture.walk_sql(_ASKED, 1, HUB)}, {gq._via_sql(_ASKED, 1, HUB)}, told AS (SELECT *, CASE WHEN {MEANING} ELSE '' END AS meaning FROM bindings),
lines AS (SELECT event_id, '- [' || event_id || '] ' || lemma || ' (' || sense || '): ' AS head, string_agg(ltrim(role, ':') || CASE WHEN meaning = '' THEN '' ELSE '[' || meaning || ']' END || '=' || entity, '; ' ORDER BY role) AS labelled, string_agg(ltrim(role, ':') || '=' || entity, '; ' ORDER BY role) AS bare, '- (' || min_by(entity, role) || ', ' || lemma || ', ' || max_by(entity, role) || ')' AS triple FROM told GROUP BY event_id, lemma, sense),
{gq._rated_sql("events_at")}, kept AS (SELECT * FROM ranked JOIN lines USING (event_id) WHERE rank <= 40), {gq._candidates_sql("kept")},
facts AS (SELECT question_id, string_agg(event_id, '|' ORDER BY rank) AS event_ids, string_agg(head || labelled, chr(10) ORDER BY rank) AS labelled, string_agg(head || bare, chr(10) ORDER BY rank) AS bare, string_agg(triple, chr(10) ORDER BY rank) AS triples FROM kept GROUP BY 1),
listed AS (SELECT p.question_id, string_agg('- Candidate: ' || p.entity || ' (Path: ' || path || ')', chr(10) ORDER BY rank) AS c, string_agg('- Candidate: ' || p.entity || ' (Path: ' || plain || ')', chr(10) ORDER BY rank) AS plain FROM picked p JOIN paths USING (question_id, entity) GROUP BY 1),
told_all AS (SELECT f.*, '{evidence.HEADING}' || chr(10) AS h, coalesce(chr(10) || chr(10) || '{evidence.CANDIDATES}' || chr(10) || c, '') AS c, coalesce(chr(10) || chr(10) || '{evidence.CANDIDATES}' || chr(10) || plain, '') AS p FROM facts f LEFT JOIN listed USING (question_id)),
unranked AS (SELECT question_id, string_agg(event_id, '|' ORDER BY dist, ord) AS event_ids FROM rated GROUP BY 1)
SELECT 'none' AS switch, question_id, event_ids, h || labelled || c AS text FROM told_all UNION ALL SELECT 'role_labels', question_id, event_ids, h || bare || c FROM told_all UNION ALL SELECT 'triples_only', question_id, event_ids, h || triples || p FROM told_all
UNION ALL SELECT 'candidates', question_id, event_ids, h || labelled FROM told_all UNION ALL SELECT 'relevance_ranking', question_id, event_ids, '' FROM unranked""",
}
