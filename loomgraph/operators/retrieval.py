"""Document retrieval: BM25, mention links, graph-guided ranks, fill, and passage budgets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.operators import engine, graph, hops, ingest
from loomgraph.storage import materialised

#: Words that BM25 leaves out.
STOP = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "by", "with", "from", "and", "or", "is", "was", "are", "were", "be", "been", "who", "what",
    "which", "where", "when", "whose", "whom", "how", "why", "that", "this", "it", "its", "as", "did", "does", "do",
)
K1, B = 1.5, 0.75
#: Distinct terms of questions up to which they are sent to every task, and characters of names in one automaton.
FEW_TERMS, AUTOMATON = 500_000, 4_000_000


def words(text) -> F.Column:
    """Lower-case words but for the stop list, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"((?U)\w+)"), F.lit(1)), lambda w: ~w.isin(*STOP))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, tf), of `terms` (term) only if they are given, and (doc_id, length) of every document."""
    split = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    each = split.select("doc_id", F.explode("w").alias("term"))
    if terms is not None:
        each = each.join(terms, "term", "left_semi")
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf")), split.select("doc_id", F.size("w").alias("length"))


def term_weights(posted: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf), and the one row (n, avgdl)."""
    size = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(size)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), size


def bm25(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, doc_id, score) of documents that share a term with the question.

    questions: question_id, text. A repeated term of a question counts repeatedly. Words that
    no question has are left out before anything is exchanged; documents without one of the others
    have score 0 and no row.
    """
    asked = materialised(questions.select("question_id", F.explode(words(F.col("text"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times")))
    terms = asked.select("term").distinct()
    posted, lengths = postings(docs, terms=F.broadcast(terms) if terms.count() <= FEW_TERMS else terms)
    posted = materialised(posted)
    weights, size = term_weights(posted, lengths)
    hits = asked.join(posted.join(weights, "term"), "term").join(lengths, "doc_id").join(F.broadcast(size))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    return hits.groupBy("question_id", "doc_id").agg(F.sum(F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of each question, ties by doc_id."""
    per = Window.partitionBy("question_id").orderBy(F.round(F.col("score"), 9).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k)


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name_id): names that a document has exactly, in any case, with no word character before or after.

    names: name_id, name. Names are cut by their hash into blocks of about AUTOMATON characters; a
    block's names make one automaton, which finds them all in one pass over each text. Texts
    aren't exchanged; they are read once a block.
    """
    keyed = materialised(names.select("name_id", F.lower("name").alias("low")).where("low <> ''"))
    each = keyed.select("low").distinct()
    blocks = max(1, math.ceil((each.agg(F.sum(F.length("low"))).first()[0] or 0) / AUTOMATON))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        own = [r[0] for r in each.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == block).collect()]  # about AUTOMATON characters
        found = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).mapInArrow(_finder(own), f"doc_id {kind}, low string") if own else None
        out = found if out is None else out if found is None else out.unionByName(found)
    if out is None:
        return docs.select("doc_id").limit(0).crossJoin(keyed.select("name_id").limit(0))  # both empty
    return out.join(keyed, "low").select("doc_id", "name_id").distinct()


def _finder(names: list[str]):
    """For mapInArrow over (doc_id, text): the names in each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        automaton.make_automaton()
        inside = lambda c: c.isalnum() or c == "_"
        for b in batches:
            rows, found = [], []
            for at, text in enumerate(b.column(1).to_pylist()):
                ends = ((end + 1, name) for end, name in automaton.iter(text))
                own = {n for end, n in ends if not inside(text[end - len(n) - 1 : end - len(n)] or " ") and not inside(text[end : end + 1] or " ")}
                rows += [at] * len(own)
                found += sorted(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["doc_id", "low"])

    return work


def best_links(*links: DataFrame) -> DataFrame:
    """The nearest link to each document: (question_id, doc_id, dist, kind); of equal distance the earlier kind.

    links: (question_id, doc_id, dist), in the order of their kinds.
    """
    every = None
    for kind, link in enumerate(links):
        one = link.select("question_id", "doc_id", F.struct("dist", F.lit(kind).alias("kind")).alias("link"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("question_id", "doc_id").agg(F.min("link").alias("link")).select("question_id", "doc_id", "link.dist", "link.kind")


def source_ranks(links: DataFrame, order: str = "doc_id") -> DataFrame:
    """Links with their `rank` by distance, kind and the order of ingestion; documents that weren't ingested come last."""
    per = Window.partitionBy("question_id").orderBy("dist", "kind", F.col(order).asc_nulls_last(), "doc_id")
    return links.withColumn("rank", F.row_number().over(per))


def filled(ranked: DataFrame, filler: DataFrame, k: int) -> DataFrame:
    """The first k of `ranked`, and of `filler` what is missing: (question_id, doc_id, from_graph, rank)."""
    both = ranked.select("question_id", "doc_id", F.struct(F.lit(0).alias("p"), "rank").alias("at")).unionByName(filler.select("question_id", "doc_id", F.struct(F.lit(1).alias("p"), "rank").alias("at")))
    once = both.groupBy("question_id", "doc_id").agg(F.min("at").alias("at"))
    per = Window.partitionBy("question_id").orderBy("at")
    return once.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k).select("question_id", "doc_id", (F.col("at.p") == 0).alias("from_graph"), "rank")


def passages(ranked: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """Per question, texts in rank order while they fit `most` characters, two more each; the first is cut, not dropped."""
    per = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = ranked.join(docs.select("doc_id", "text"), "doc_id").withColumn("cum", F.sum(F.length("text") + 2).over(per))
    fit = sized.where((F.col("cum") <= most) | (F.col("rank") == 1))
    return fit.groupBy("question_id").agg(F.count("*").alias("n_passages"), F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, most).alias("text")))).alias("p")).select("question_id", "n_passages", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def ranked_sources(questions: DataFrame, tables: dict[str, DataFrame], docs: DataFrame, max_hops: int = 3, hub_degree: int = 25, most_anchors: int = 4, switches: dict[str, bool] | None = None) -> DataFrame:
    """(question_id, doc_id, dist, kind, rank): documents by graph distance from the names that a question has.

    tables: a stored graph (one graph_id); questions: question_id, text; docs: doc_id, ord, title, text,
    doc_id being the events' source. One search serves three kinds of link: 0, an event of the
    document is reached; 1, so is the entity that its title names; 2, it mentions a reached entity,
    unless that is a hub or too plain a name. Of equal distance the earlier kind counts, then ord.
    A question that names nothing has no rows. Of the engine's switches, `hub_pruning` and
    `mention_links` act here.
    """
    on = engine.SWITCHES | (switches or {})
    bindings = materialised(ingest.bindings(tables))
    picked = materialised(engine.anchors_of(questions, bindings, on, hub_degree, most_anchors))
    entities, events = graph.explore(bindings, picked, max_hops, hub_degree)
    keys = tables["entity"].select("graph_id", "entity", "key")
    reached = materialised(entities.select("graph_id", "question_id", "entity", "name", "dist").join(keys, ["graph_id", "entity"]))
    by_event = graph.source_distances(events, tables["event"].select("graph_id", "event_id", "source")).select("question_id", F.col("source").alias("doc_id"), "dist")
    links = [by_event, hops.title_links(docs, reached.select("question_id", "key", "dist"))]
    if on["mention_links"]:
        plain = reached.join(graph.degrees(bindings), ["graph_id", "entity"]).where(t.is_mentionable(F.col("name")) & ((F.col("dist") == 0) | (F.col("degree") <= hub_degree)))
        frontier = materialised(plain.select("question_id", F.col("name").alias("name_id"), "dist"))
        met = mentions(docs, frontier.select("name_id", F.col("name_id").alias("name")).distinct())
        links.append(met.join(frontier, "name_id").groupBy("question_id", "doc_id").agg(F.min("dist").alias("dist")))
    best = best_links(*links).where("doc_id <> ''")
    placed = best.join(docs.select("doc_id", "ord"), "doc_id", "left")
    return source_ranks(placed, "ord").drop("ord")
