"""Queries of coercion, rewriting, senses, aliases and anchoring, over payloads and questions made of whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import vocab as v
from loomgraph.operators import aliases, anchoring, coerce, evidence, rewrite, senses
from loomgraph.plans.text_queries import _STEM, lists
from loomgraph.session import importable, table



def stems_sql(text: str) -> str:
    """Content stems of a text, as a list."""
    return f"list_distinct(list_transform(list_filter(regexp_extract_all({text}, '[A-Za-z]+'), lambda w: length(w) > 2 AND lower(w) NOT IN {lists(v.RELEVANCE_STOP)}), lambda w: {_STEM('lower(w)')}))"


#: Payloads in the shapes that extractors give.
PAYLOADS = (
    json.dumps({"events": [{"temp_id": "e1", "lemma": "found", "sense_id": "found.01", "roles": {":ARG0": "Ada Lee", "ARG1": "Acme Corp", "when": "1999"}, "time_context": 1999, "spatial_context": "Canyon, Texas, United States"}], "discourse": [{"source": "e1", "target": "e2", "rel": "prior to"}]}),
    json.dumps([{"lemma": "bear.02", "roles": {"subject": "Max Roe", "birthplace": "Paris, France"}, "time_context": {"text": "May 4, 1948"}}]),
    json.dumps({"lemma": "be", "roles": [{"role": "agent", "value": "Ann Poe"}, {"role": "ARG1", "value": "elder sister of Bob Poe"}]}),
    json.dumps({"events": [{"lemma": "born", "roles": {"ARG0": "Kim Ray", "ARG1": "Joe Ray", "ARG2": "Sue Ray", "ARGM-TMP": "1950"}}, {"lemma": "hold", "sense_id": "locate.01", "roles": {"ARG0": "The Hall", "odd key": "unknown", "made by": "Tom Fox"}}, "junk"]}),
    "```json\n" + json.dumps({"events": [{"lemma": "locate", "roles": {"ARG0": "Acme's old plant", "location": "Canyon, Texas"}, "spatial_context": {"name": "Canyon", "parent_region": "Texas, United States"}}]}) + "\n```",
    'Here it is: {"events": [{"frame": "marry-01", "roles": {"wife": "Eve", "husband": "Dan", "ARG0": "Eve"}, "epistemic_context": {"confidence": 0.4, "source": "A letter"}}]} done',
    json.dumps({"events": [{"lemma": "co-found", "roles": {"ARG0": "Ada", "ARG1": "the company", "ARG3": "Lee"}}, {"lemma": "parent", "roles": {"ARG0": "Ada", "ARG1": "ada"}}]}),
    "not json",
    json.dumps({"events": None}),
)


def _stated(spark: SparkSession) -> DataFrame:
    importable(spark)
    return spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS)], "payload bigint, raw string")


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """An extraction of each order, in five forms by its key, as JSON."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    person, other, made = F.concat(F.lit("Customer "), "o_custkey"), F.concat(F.lit("Customer "), F.col("o_custkey") + 1), F.concat(F.lit("Order "), key)
    date, form = F.date_format("o_orderdate", "yyyy-MM-dd"), key % 5
    second = F.when(form == 0, made).when(form == 1, other).when(form == 2, F.lit("Trader")).when(form == 3, F.lit("Harbor Town, Asia")).otherwise("Lowland")
    lemma = F.when(form == 0, "inspect").when(form == 1, "Marry").when(form == 2, "be").when(form == 3, "be_located").otherwise("born")
    said = F.create_map(F.lit(":ARG0"), person, F.lit("ARG1"), second, F.when(form == 0, F.lit(":ARGM-TMP")).otherwise(":manner"), F.when(form == 0, F.date_format("o_orderdate", "yyyy")).when(form == 1, "unknown").otherwise("by hand"))
    event = F.struct(F.concat(F.lit("e"), key).alias("temp_id"), lemma.alias("lemma"), said.alias("roles"), F.when(form > 0, date).alias("time_context"), F.when(form == 2, "Port Said, Egypt").alias("spatial_context"), F.struct((F.col("o_custkey") % 5 / 4).alias("confidence")).alias("epistemic_context"))
    link = F.struct(F.concat(F.lit("e"), key).alias("source"), F.concat(F.lit("e"), key + 1).alias("to"), F.when(form == 0, "prior to").when(form == 1, "AFTER").when(form == 2, ":cause").otherwise("so").alias("rel"))
    body = F.to_json(F.struct(F.array(event).alias("events"), F.array(link).alias("discourse")))
    return o.select(key.alias("payload"), F.when(key % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("raw"))


def _shown(df: DataFrame) -> DataFrame:
    """Maps as ordered text."""
    roles = F.array_join(F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return df.withColumn("roles", roles).withColumn("time", F.concat_ws(" ", "time_context.raw_expression", "time_context.start_year", "time_context.end_year")).withColumn("place", F.concat_ws(" < ", "spatial_context.location_name", "spatial_context.parent_region"))


def _events(payloads: DataFrame) -> DataFrame:
    return _shown(coerce.events_of(payloads)).select("payload", "event_ord", "temp_id", "lemma", "sense_id", "roles", "time", "place", "epistemic_context.source", "epistemic_context.confidence", "valid")


def c10_payload_events(spark: SparkSession, sf: str) -> DataFrame:
    return _events(_payloads(spark, sf))


def c10_stated_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Events of payloads in the shapes that go wrong."""
    return _events(_stated(spark))


def c12_discourse(spark: SparkSession, sf: str) -> DataFrame:
    return coerce.discourse_of(_payloads(spark, sf)).drop("raw")


def _rewritten(payloads: DataFrame) -> DataFrame:
    events = coerce.events_of(payloads).withColumn("event_id", F.concat_ws(":", "payload", "event_ord"))
    done = rewrite.prepared(events, F.lit("Acme Corp"), source=F.lit("an order"))
    return _shown(done).select("event_id", "derived_ord", "part_ord", "lemma", "sense_id", "roles", "time", "place", "epistemic_context.source")


def w0_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """All rewrites of the orders' events."""
    return _rewritten(_payloads(spark, sf))


def _told_payloads(spark, sf):
    """An extraction about each customer, of the kinds that the orders don't have, with a title."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    person, form = F.concat(F.lit("Customer "), k), k % 4
    lemma = F.when(form == 0, "hold").when(form == 1, "open").otherwise("visit")
    other = F.when(form < 2, "Hall").when(form == 2, "ACME's Harbor Office").otherwise("Ann Poe's old plant")
    event = F.struct(lemma.alias("lemma"), F.when(form == 0, "locate.01").alias("sense_id"), F.create_map(F.lit(":ARG0"), F.when(form == 1, "the company").otherwise(person), F.lit(":ARG1"), other).alias("roles"))
    return c.select(k.alias("payload"), F.concat(F.lit("Harbor "), k).alias("title"), F.to_json(F.struct(F.array(event).alias("events"))).alias("raw"))


def w11_told_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """System frames on other verbs, phrases for the title, possessives of names and in arguments."""
    events = coerce.events_of(_told_payloads(spark, sf)).withColumn("event_id", F.concat_ws(":", "payload", "event_ord"))
    done = rewrite.prepared(events, F.col("title"))
    return _shown(done).select("event_id", "part_ord", "lemma", "sense_id", "roles", "epistemic_context.source")


def w0_stated_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return _rewritten(_stated(spark))


def w15_role_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """Roles and places of the orders' events as bindings."""
    events = coerce.events_of(_payloads(spark, sf)).withColumn("event_id", F.concat_ws(":", "payload", "event_ord"))
    return rewrite.role_bindings(events)


def _rolesets(spark, sf):
    """A catalog of the parts' nouns, a sense an adjective."""
    words = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("lemma")).distinct()
    n = F.row_number().over(Window.partitionBy("lemma").orderBy("first"))
    roles = F.when(F.col("ord") % 2 == 0, F.create_map(F.lit(":ARG1"), F.col("first"), F.lit(":ARG2"), F.lit("thing"))).otherwise(F.create_map(F.lit(":ARG0"), F.lit("agent"), F.lit(":ARG1"), F.lit("thing made"), F.lit(":ARG3"), F.col("first")))
    numbered = words.withColumn("ord", n.cast("bigint"))
    return numbered.select(F.concat("lemma", F.lit("."), F.lpad(F.col("ord").cast("string"), 2, "0")).alias("roleset_id"), "lemma", F.col("first").alias("name"), F.concat(F.lit("a kind of "), "first").alias("description"), roles.alias("roles"), "ord")


def _part_events(spark, sf):
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    lemma = F.split_part("p_name", F.lit(" "), F.lit(2))
    return p.select(key.alias("event_id"), F.when(key % 3 == 0, F.upper(lemma)).otherwise(F.concat(F.lit(" "), lemma)).alias("lemma"), F.concat_ws(" ", F.when(key % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("thing"), "p_type").alias("context"))


def j6_candidate_senses(spark: SparkSession, sf: str) -> DataFrame:
    return senses.candidate_senses(_part_events(spark, sf), _rolesets(spark, sf)).select("lemma", "roleset_id", "ord")


def a7_disambiguated(spark: SparkSession, sf: str) -> DataFrame:
    """The sense of each part's noun by what is said with it."""
    return senses.disambiguated(_part_events(spark, sf), _rolesets(spark, sf))


def w14_aligned_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Some arguments of each part aligned to what every sense of its noun declares."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    given = F.array_compact(F.array(*[F.when((key / 2**i).cast("bigint") % 2 == 1, F.struct(F.lit(f":ARG{i}").alias("k"), F.concat(F.lit(f"{i}="), "p_name").alias("v"))) for i in range(6)], F.struct(F.lit(":manner").alias("k"), F.lit("fast").alias("v"))))
    asked = p.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("lemma"), F.map_from_entries(given).alias("roles"))
    declared = _rolesets(spark, sf).where("ord <= 2").select("lemma", "roleset_id", senses.slots_of(F.col("roles")).alias("slots"))
    done = asked.join(declared, "lemma").withColumn("roles", senses.aligned_roles(F.col("roles"), F.col("slots")))
    return done.select("p_partkey", "roleset_id", F.array_join(F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ").alias("roles"))


def f41_role_meanings(spark: SparkSession, sf: str) -> DataFrame:
    r = _rolesets(spark, sf)
    return r.select("roleset_id", senses.role_meanings_json(F.create_map(F.lit(":ARG1"), F.lit("x"), F.lit(":ARG2"), F.lit("y"), F.lit(":ARGM-LOC"), F.lit("z")), F.col("roles")).alias("meanings"))


def _cataloged(spark, sf):
    """An event a part, in the first or second sense of its noun, with brand, name, type and size bound to it."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    lemma = F.split_part("p_name", F.lit(" "), F.lit(2))
    bound = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).cast("string").alias("name")) for r, c in ((":ARG0", "p_brand"), (":ARG1", "p_name"), (":ARG2", "p_type"), (":ARGM-POSS", "p_size"))])
    rows = p.select(F.lit("g").alias("graph_id"), F.concat(F.lit("made:"), key).alias("event_id"), key.cast("bigint").alias("ord"), lemma.alias("lemma"), F.concat(lemma, F.lit(".0"), 1 + key % 2).alias("sense"), F.explode(bound).alias("b"))
    return rows.select("graph_id", "event_id", "ord", "lemma", "sense", "b.role", F.col("b.name").alias("entity"), "b.name")


def e2_catalog_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose roles have the meanings of a roleset catalog."""
    return evidence.rendered(_cataloged(spark, sf), spark, rolesets=_rolesets(spark, sf)).select("event_id", "block")


def e3_catalog_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance of every part's event to a question about its size and colour, by the catalog's meanings."""
    p = table(spark, sf, "part")
    events = p.select(F.lit("g").alias("graph_id"), F.col("p_size").cast("bigint").alias("question_id"), F.concat(F.lit("made:"), "p_partkey").alias("event_id"), F.lit(0).alias("dist"))
    colour = F.when(F.col("p_size") % 2 == 0, "red bolts").otherwise("small rings")
    questions = p.select(F.col("p_size").cast("bigint").alias("question_id"), F.concat(F.lit("Which agents make "), colour, F.lit(" as things?")).alias("text")).distinct()
    return evidence.with_relevance(events, questions, _cataloged(spark, sf), _rolesets(spark, sf)).select("question_id", "event_id", "ord", "relevance")


def w18_unique_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of orders proposed by priority, made unique a customer."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("graph_id"), F.col("o_orderpriority").alias("event_id"), F.col("o_orderkey").alias("ord"))
    return senses.unique_ids(o).select("graph_id", "ord", "stored_id")


def e4_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Names that questions about suppliers, nations and documents' words mention."""
    return anchoring.anchored(*_asked(spark, sf)).select("question_id", "name", "place")


def j7_mentioned_names(spark: SparkSession, sf: str) -> DataFrame:
    return anchoring.mentioned(*_asked(spark, sf)).drop("ord")


def _asked(spark, sf):
    """Questions that name two suppliers, a nation or a region; and all names."""
    s = table(spark, sf, "supplier")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    named = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("Where is "), "s_name", F.lit("'s store in "), "n_name", F.lit("?"))).when(k % 4 == 1, F.concat(F.lit("Who runs the "), F.initcap("r_name"), F.lit(" Trading House of "), "n_name", F.lit("?"))).when(k % 4 == 2, F.concat(F.lit("Does "), F.initcap("r_name"), F.lit(" Holdings trade with supplier?"))).otherwise(F.concat(F.lit("which "), F.lower("r_name"), F.lit(" firm was it")))
    names = s.select(F.col("s_name").alias("name")).unionByName(n.select(F.col("n_name").alias("name"))).unionByName(r.select(F.col("r_name").alias("name"))).unionByName(r.select(F.concat(F.initcap("r_name"), F.lit(" Trading House of Goods")).alias("name"))).unionByName(r.select(F.concat(F.initcap("r_name"), F.lit(" Central Holdings")).alias("name"))).unionByName(r.select(F.concat(F.initcap("r_name"), F.lit(" Holdings: A History")).alias("name")))
    return named.select(k.alias("question_id"), text.alias("text")), names.withColumn("ord", F.crc32("name"))


def f18_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    """Abbreviations that texts define: the documents' own, and those made of names of the tables."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "text")
    p = table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat(F.lit("In 1990 the "), F.initcap("p_name"), F.lit(" of "), F.initcap("p_type"), F.lit(" ("), F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 1, 1), F.substring("p_type", 1, 1))), F.lit(") began.")).alias("text"))
    return aliases.mined(d.unionByName(p))


_MADE = """made AS (SELECT o_orderkey AS k, o_orderkey % 5 AS form, 'Customer ' || o_custkey AS person, 'Customer ' || (o_custkey + 1) AS other, 'Order ' || o_orderkey AS thing, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) AS y, o_custkey % 5 / 4 AS sure FROM orders),
said AS (SELECT *, CASE form WHEN 0 THEN thing WHEN 1 THEN other WHEN 2 THEN 'Trader' WHEN 3 THEN 'Harbor Town, Asia' ELSE 'Lowland' END AS second, CASE WHEN form = 0 THEN '' ELSE day || ' ' || y || ' ' || y END AS time FROM made)"""
_ROLESETS = "rolesets AS (SELECT *, lemma || '.' || lpad(CAST(ord AS VARCHAR), 2, '0') AS roleset_id FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY first) AS ord FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS lemma FROM part)))"
_PARTS = "parts AS (SELECT p_partkey AS event_id, split_part(p_name, ' ', 2) AS lemma, CASE WHEN p_partkey % 3 = 0 THEN upper(split_part(p_name, ' ', 2)) ELSE ' ' || split_part(p_name, ' ', 2) END AS said, list_distinct(regexp_extract_all(lower(CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE '' END || ' thing ' || p_type), '\\w+')) AS words FROM part)"
_GLOSS = "list_distinct(regexp_extract_all(lower(first || ' a kind of ' || first || CASE WHEN ord % 2 = 0 THEN ' ' || first || ' thing' ELSE ' agent thing made ' || first END), '\\w+'))"


def _part(where: str, lemma: str, sense: str, roles: str, time: str = "time", place: str = "''", at: int = 0) -> str:
    return f"SELECT k || ':0' AS event_id, 0 AS derived_ord, {at} AS part_ord, '{lemma}' AS lemma, '{sense}' AS sense_id, {roles} AS roles, {time} AS time, {place} AS place, 'an order' AS source FROM said WHERE form = {where}"


_TITLE = lambda x: f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
_CRC = lambda x: f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, d: xor(c >> 1, (c & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
#: What the suppliers' questions mention: at, length, in capitals, exactly.
_MENTIONED = f"""named AS (SELECT s_suppkey AS k, s_name, n_name, r_name, {_TITLE('r_name')} AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
hits AS (
  SELECT k, s_name AS name, 9 AS lo, 9 + length(s_name) AS hi, true AS capital, true AS exact FROM named WHERE k % 4 = 0
  UNION ALL SELECT k, n_name, 9 + length(s_name) + 10, 9 + length(s_name) + 10 + length(n_name), true, true FROM named WHERE k % 4 = 0
  UNION ALL SELECT k, r_name, 13, 13 + length(title), true, true FROM named WHERE k % 4 = 1
  UNION ALL SELECT k, n_name, 13 + length(title) + 18, 13 + length(title) + 18 + length(n_name), true, true FROM named WHERE k % 4 = 1
  UNION ALL SELECT k, r_name, 5, 5 + length(title), true, true FROM named WHERE k % 4 = 2
  UNION ALL SELECT k, title || unnest([' Central Holdings', ' Holdings: A History']), 5, 5 + length(title) + 9, true, false FROM named WHERE k % 4 = 2
  UNION ALL SELECT k, r_name, 6, 6 + length(r_name), false, true FROM named WHERE k % 4 = 3)"""
_DECLARED = """asked AS (SELECT p_partkey, p_name, list_filter(range(0, 6), lambda i: (p_partkey >> i) & 1 = 1) AS core, split_part(p_name, ' ', 2) AS lemma FROM part),
declared AS (SELECT a.*, r.roleset_id, CASE WHEN r.ord % 2 = 0 THEN [1, 2] ELSE [0, 1, 3] END AS slots FROM asked a JOIN rolesets r USING (lemma) WHERE r.ord <= 2),
parted AS (SELECT *, list_filter(core, lambda k: list_contains(slots, k)) AS own, list_filter(core, lambda k: NOT list_contains(slots, k)) AS strays, list_filter(slots, lambda k: NOT list_contains(core, k) AND k <> 0) AS free FROM declared),
placed AS (SELECT *, CASE WHEN list_contains(core, 0) AND NOT list_contains(slots, 0) THEN list_transform(core[1:len(slots)], lambda k, i: {'slot': slots[i], 'k': k})
  ELSE list_concat(list_transform(own, lambda k: {'slot': k, 'k': k}), list_filter(list_transform(strays, lambda k, i: {'slot': coalesce(free[i], CASE WHEN k <= 2 THEN k END), 'k': k}), lambda x: x.slot IS NOT NULL)) END AS pairs FROM parted)"""
_CATALOGED = """bound AS (SELECT p_partkey, p_size AS size, 'made:' || p_partkey AS event_id, split_part(p_name, ' ', 2) AS lemma, split_part(p_name, ' ', 2) || '.0' || (1 + p_partkey % 2) AS sense, unnest([':ARG0', ':ARG1', ':ARG2', ':ARGM-POSS']) AS role, unnest([p_brand, p_name, p_type, CAST(p_size AS VARCHAR)]) AS name FROM part),
told AS (SELECT b.*, CASE WHEN role = ':ARGM-POSS' THEN 'possessor' WHEN r.ord IS NULL THEN '' WHEN r.ord % 2 = 0 THEN CASE role WHEN ':ARG1' THEN first WHEN ':ARG2' THEN 'thing' ELSE '' END ELSE CASE role WHEN ':ARG0' THEN 'agent' WHEN ':ARG1' THEN 'thing made' ELSE '' END END AS meaning FROM bound b LEFT JOIN rolesets r ON r.roleset_id = b.sense)"""
QUERIES = {f.__name__: f for f in (c10_payload_events, c10_stated_payloads, c12_discourse, w0_rewrites, w11_told_rewrites, w0_stated_payloads, w15_role_bindings, j6_candidate_senses, a7_disambiguated, w14_aligned_roles, f41_role_meanings, e2_catalog_events, e3_catalog_relevance, w18_unique_ids, e4_anchors, j7_mentioned_names, f18_acronyms)}
ORACLES: dict[str, str] = {
    "c10_payload_events": f"WITH {_MADE} SELECT k AS payload, 0 AS event_ord, 'e' || k AS temp_id, CASE form WHEN 0 THEN 'inspect' WHEN 1 THEN 'Marry' WHEN 2 THEN 'be' WHEN 3 THEN 'be_located' ELSE 'born' END AS lemma, CASE form WHEN 0 THEN 'inspect' WHEN 1 THEN 'marry' WHEN 2 THEN 'be' WHEN 3 THEN 'be_located' ELSE 'born' END || '.01' AS sense_id, ':ARG0=' || person || '; :ARG1=' || second || CASE WHEN form = 0 THEN '; :ARGM-TMP=' || y WHEN form = 1 THEN '; :manner=unknown' ELSE '; :manner=by hand' END AS roles, time, CASE WHEN form = 2 THEN 'Port Said < Egypt' ELSE '' END AS place, 'Unattributed' AS source, sure AS confidence, true AS valid FROM said",
    "c12_discourse": f"WITH {_MADE} SELECT k AS payload, 0 AS link_ord, 'e' || k AS source_id, 'e' || (k + 1) AS target_id, CASE form WHEN 0 THEN ':before' WHEN 1 THEN ':after' ELSE ':cause' END AS relation FROM said",
    "w0_rewrites": f"WITH {_MADE} "
    + " UNION ALL ".join(
        (
            _part("0", "inspect", "inspect.01", "':ARG0=' || person || '; :ARG1=' || second", "y || ' ' || y || ' ' || y"),
            _part("1", "marry", "marry.01", "':ARG0=' || person || '; :ARG1=' || second"),
            _part("2", "be", "be.01", "':ARG1=' || person || '; :ARG2=' || second || '; :manner=by hand'", place="'Port Said < Egypt'"),
            _part("2", "locate", "locate.01", "':ARG1=Port Said; :ARG2=Egypt'", "''", at=1),
            _part("3", "locate", "locate.01", "':ARG1=' || person || '; :ARG2=Harbor Town; :manner=by hand'"),
            _part("3", "locate", "locate.01", "':ARG1=Harbor Town; :ARG2=Asia'", "''", at=1),
            _part("4", "bear", "bear.02", "':ARG1=' || person || '; :manner=by hand'", place="'Lowland'"),
        )
    ),
    "w11_told_rewrites": """WITH told AS (SELECT c_custkey AS k, c_custkey % 4 AS form FROM customer), events AS (
  SELECT k, 0 AS part_ord, 'hold' AS lemma, 'hold.01' AS sense_id, ':ARG0=Customer ' || k || '; :ARG1=Hall' AS roles FROM told WHERE form = 0
  UNION ALL SELECT k, 0, 'open', 'open.01', ':ARG0=Harbor ' || k || '; :ARG1=Hall' FROM told WHERE form = 1
  UNION ALL SELECT k, 0, 'visit', 'visit.01', ':ARG0=Customer ' || k || '; :ARG1=ACME''s Harbor Office' FROM told WHERE form = 2
  UNION ALL SELECT k, 1, 'affiliate', 'affiliate.01', ':ARG0=ACME; :ARG1=ACME''s Harbor Office' FROM told WHERE form = 2
  UNION ALL SELECT k, 0, 'visit', 'visit.01', ':ARG0=Customer ' || k || '; :ARG1=Ann Poe''s old plant; :ARGM-POSS=Ann Poe' FROM told WHERE form = 3)
  SELECT k || ':0' AS event_id, part_ord, lemma, sense_id, roles, 'Unattributed' AS source FROM events""",
    "w15_role_bindings": f"WITH {_MADE} SELECT k || ':0' AS event_id, unnest([':ARG0', ':ARG1', CASE WHEN form = 0 THEN ':ARGM-TMP' ELSE ':manner' END]) AS role, unnest([person, second, CASE WHEN form = 0 THEN CAST(y AS VARCHAR) WHEN form = 1 THEN 'unknown' ELSE 'by hand' END]) AS name FROM said UNION ALL SELECT k || ':0', ':location', 'Port Said' FROM said WHERE form = 2",
    "e2_catalog_events": f"WITH {_ROLESETS}, {_CATALOGED} SELECT event_id, '- [' || event_id || '] ' || lemma || ' (' || sense || '): ' || string_agg(ltrim(role, ':') || CASE WHEN meaning = '' THEN '' ELSE '[' || meaning || ']' END || '=' || name, '; ' ORDER BY role) AS block FROM told GROUP BY event_id, lemma, sense",
    "e3_catalog_relevance": f"""WITH {_ROLESETS}, {_CATALOGED}, stems AS (SELECT p_partkey, event_id, size, {stems_sql("lemma || ' ' || string_agg(meaning, ' ')")} AS stems FROM told GROUP BY p_partkey, event_id, size, lemma)
  SELECT size AS question_id, event_id, p_partkey AS ord, len(list_intersect(stems, {stems_sql("'Which agents make ' || CASE WHEN size % 2 = 0 THEN 'red bolts' ELSE 'small rings' END || ' as things?'")})) AS relevance FROM stems""",
    "w14_aligned_roles": f"WITH {_ROLESETS}, {_DECLARED} SELECT p_partkey, roleset_id, array_to_string(list_append(list_transform(list_sort(pairs), lambda x: ':ARG' || x.slot || '=' || x.k || '=' || p_name), ':manner=fast'), '; ') AS roles FROM placed",
    "e4_anchors": f"WITH {_MENTIONED}, longest AS (SELECT * FROM hits WHERE k % 4 <> 2 OR NOT exact) SELECT k AS question_id, name, CAST(row_number() OVER (PARTITION BY k ORDER BY lo, {_CRC('name')}, name) - 1 AS INTEGER) AS place FROM longest",
    "j7_mentioned_names": f"WITH {_MENTIONED} SELECT k AS question_id, name, lo, hi, capital, exact FROM hits",
    "f18_acronyms": f"SELECT 'part:' || p_partkey AS id, {_TITLE('p_name')} || ' of ' || {_TITLE('p_type')} AS name, upper(left(p_name, 1) || left(split_part(p_name, ' ', 2), 1) || left(p_type, 1)) AS alias FROM part",
    "j6_candidate_senses": f"WITH {_ROLESETS}, {_PARTS} SELECT DISTINCT p.said AS lemma, r.roleset_id, r.ord FROM parts p JOIN rolesets r USING (lemma)",
    "a7_disambiguated": f"WITH {_ROLESETS}, {_PARTS}, rated AS (SELECT event_id, roleset_id, ord, len(list_intersect(words, {_GLOSS})) AS overlap FROM parts JOIN rolesets USING (lemma)) SELECT event_id, roleset_id, overlap FROM rated QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY overlap DESC, ord) = 1",
    "f41_role_meanings": f"WITH {_ROLESETS} SELECT roleset_id, CASE WHEN ord % 2 = 0 THEN '{{\":ARG1\":\"' || first || '\",\":ARG2\":\"thing\"}}' ELSE '{{\":ARG1\":\"thing made\"}}' END AS meanings FROM rolesets",
    "w18_unique_ids": "SELECT o_custkey AS graph_id, o_orderkey AS ord, o_orderpriority || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS stored_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)",
}
