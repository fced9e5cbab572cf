"""Questions as JSON lines: alternative field names, lenient values, and a resumable prediction sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as text_functions

PARAGRAPH = "struct<idx: string, title: string, wikipedia_title: string, paragraph_text: string, text: string, is_supporting: boolean>"
QUESTION = f"id string, question string, composed_question_text string, answer string, answer_text string, answer_aliases array<string>, answerable boolean, question_decomposition array<string>, paragraphs array<{PARAGRAPH}>, contexts array<{PARAGRAPH}>"
PREDICTION = "id string, system string, predicted string, em double, f1 double, error string"


def _given(*names: str) -> Column:
    """The first of the columns with a non-empty value."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def _paragraph(p: Column, at: Column) -> Column:
    first = lambda a, b: F.trim(F.coalesce(F.nullif(p[a], F.lit("")), p[b], F.lit("")))
    return F.struct(
        F.coalesce(p["idx"].try_cast("int"), at).alias("idx"),
        first("title", "wikipedia_title").alias("title"),
        first("paragraph_text", "text").alias("paragraph_text"),
        F.coalesce(p["is_supporting"], F.lit(False)).alias("is_supporting"),
    )


def normalized(records: DataFrame) -> DataFrame:
    """Records of schema QUESTION as id, question, answer, answer_aliases, paragraphs, answerable, hops.

    The answer leads its aliases, which are distinct and keep their order. Records without an
    id, a question or an answer are left out; an absent paragraph list is empty.
    """
    answer = F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.col("answer_text"))
    aliases = F.filter(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda a: a.isNotNull())
    listed = F.coalesce(F.when(F.size("paragraphs") > 0, F.col("paragraphs")), F.col("contexts"), F.array().cast(f"array<{PARAGRAPH}>"))
    whole = records.where(F.coalesce(F.length("id"), F.lit(0)) > 0).where(_given("question", "composed_question_text").isNotNull() & answer.isNotNull())
    return whole.select(
        "id",
        F.trim(_given("question", "composed_question_text")).alias("question"),
        F.trim(answer).alias("answer"),
        F.array_distinct(F.concat(F.array(answer), aliases)).alias("answer_aliases"),
        F.transform(F.filter(listed, lambda p: p.isNotNull()), _paragraph).alias("paragraphs"),
        F.coalesce("answerable", F.lit(True)).alias("answerable"),
        text_functions.hop_count(F.col("id"), F.col("question_decomposition")).alias("hops"),
    )


def read_questions(spark: SparkSession, path: str, unanswerable: bool = False) -> DataFrame:
    """A file or folder of JSON lines; lines that aren't JSON are dropped, unanswerable questions unless wanted."""
    found = normalized(spark.read.schema(QUESTION).option("mode", "DROPMALFORMED").json(path))
    return found if unanswerable else found.where("answerable")


def documents(questions: DataFrame) -> DataFrame:
    """One row a paragraph: graph_id, source, ord, title, text, is_supporting."""
    each = questions.select("id", F.posexplode("paragraphs").alias("ord", "p"))
    return each.select(F.col("id").alias("graph_id"), F.concat(F.lit("para_"), F.col("p.idx")).alias("source"), "ord", "p.title", F.col("p.paragraph_text").alias("text"), "p.is_supporting")


def finished(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of whole lines of a prediction file; a line cut off by an interruption doesn't count."""
    lines = spark.read.schema(f"{PREDICTION}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return lines.where("_broken IS NULL AND id IS NOT NULL").select("id").distinct()


def unfinished(questions: DataFrame, done: DataFrame) -> DataFrame:
    return questions.join(done, "id", "left_anti")


def append_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").json(path)
