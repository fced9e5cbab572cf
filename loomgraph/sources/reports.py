"""Reports: predictions of all systems of a run, and their tables as Markdown or TeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import answers as a
from loomgraph.operators import metrics

RECORD = "id string, em double, f1 double, answerable boolean, support_pred array<int>, support_gold array<int>, refused boolean, failure_stage string, hops int, usage struct<index_tokens:double,query_tokens:double,total_tokens:double,index_seconds:double,query_seconds:double,seconds:double>"


def load(spark: SparkSession, path: str, test_ids: DataFrame) -> DataFrame:
    """Records of `*/predictions.jsonl` that the manifest has, with `system`, the folder's name, and `place`.

    test_ids: id, place.
    """
    rows = spark.read.schema(RECORD).json(f"{path}/*/predictions.jsonl").withColumn("system", F.regexp_extract("_metadata.file_path", r"([^/]+)/predictions\.jsonl", 1))
    return rows.join(test_ids, "id")


def flat(records: DataFrame) -> DataFrame:
    """Records with their cost as columns, as the metrics take them."""
    return records.select("system", "id", "em", "f1", F.coalesce("answerable", F.lit(True)).alias("answerable"), *[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("support_pred", "support_gold")], F.coalesce("refused", F.lit(False)).alias("refused"), "failure_stage", "hops", F.col("usage.total_tokens").alias("tokens"), "usage.seconds", *[f"usage.{c}" for c in ("index_tokens", "query_tokens", "index_seconds", "query_seconds")])


def main_table(records: DataFrame, reference: str, resamples: int = 10_000) -> DataFrame:
    """System, EM and F1 with intervals, support F1, refusals, and p of exact match against the reference; as printed."""
    s, c = metrics.system_summary(records, resamples), metrics.compared(records, reference, resamples)
    span = lambda x: F.concat(a.figure(F.col(x)), F.lit(" ["), a.figure(F.col(f"{x}_lo")), F.lit(", "), a.figure(F.col(f"{x}_hi")), F.lit("]"))
    p = F.when(F.col("system") == reference, "ref.").otherwise(a.p_value(F.col("p_em")))
    return s.join(c.select("system", "p_em"), "system", "left").select("system", span("em").alias("em"), span("f1").alias("f1"), a.figure(F.col("support_f1")).alias("support_f1"), a.figure(F.col("refusal_rate")).alias("refusal"), p.alias("p"))


def cost_table(records: DataFrame) -> DataFrame:
    c = metrics.costs(records)
    return c.select("system", *[a.figure(F.col(x), 0).alias(x) for x in ("index_tokens", "query_tokens")], *[a.figure(F.col(x)).alias(x) for x in ("index_seconds", "query_seconds")])


def hops_table(records: DataFrame) -> DataFrame:
    """Exact match by system and number of hops."""
    return records.groupBy("system", "hops").agg(F.count("*").alias("n"), a.figure(100 * F.avg("em")).alias("em"), a.figure(100 * F.avg("f1")).alias("f1"))


def failures_table(records: DataFrame) -> DataFrame:
    return records.groupBy("system", "failure_stage").agg(F.count("*").alias("n"))


def ablation_table(records: DataFrame, reference: str, resamples: int = 10_000) -> DataFrame:
    """Each variant against the reference: differences and p."""
    c = metrics.compared(records, reference, resamples)
    return c.select("system", "n", a.figure(F.col("d_em")).alias("d_em"), a.p_value(F.col("p_em")).alias("p_em"), a.figure(F.col("d_f1")).alias("d_f1"), a.p_value(F.col("p_f1")).alias("p_f1"))


def models_table(records: DataFrame, questions: DataFrame, reference: str, against: str) -> DataFrame:
    """A row a configuration: its reference system's figures and the difference from another system.

    records have `label`, the configuration; questions: label, id. Configurations of
    different question sets are refused.
    """
    sets = questions.groupBy("label").agg(F.md5(F.to_json(F.array_sort(F.collect_set("id")))).alias("ids")).select("ids").distinct().limit(2).count()
    if sets > 1:
        raise ValueError("the configurations were run on different questions")
    mean = lambda system, x: 100 * F.avg(F.when(F.col("system") == system, F.col(x)))
    one = records.groupBy("label").agg(mean(reference, "em").alias("em"), mean(reference, "f1").alias("f1"), mean(against, "em").alias("against_em"))
    return one.select("label", a.figure(F.col("em")).alias("em"), a.figure(F.col("f1")).alias("f1"), a.figure(F.col("against_em")).alias("against_em"), F.format_string("%+.1f", F.col("em") - F.col("against_em")).alias("d_em"))


def _line(cells: list[Column], between: str, left: str = "", right: str = "") -> Column:
    return F.concat(F.lit(left), F.concat_ws(between, *cells), F.lit(right))


def lines(table: DataFrame, style: str = "markdown") -> DataFrame:
    """A small table's rows as Markdown or TeX: (line); its header is `header`."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in table.columns]
    if style == "tex":
        return table.select(_line([a.tex(c) for c in cells[:1]] + cells[1:], " & ", right=" \\\\").alias("line"))
    return table.select(_line(cells, " | ", "| ", " |").alias("line"))


def header(table: DataFrame, style: str = "markdown") -> list[str]:
    names = [c.replace("_", " ") for c in table.columns]
    if style == "tex":
        return ["\\begin{tabular}{" + "l" + "r" * (len(names) - 1) + "}", " & ".join(names) + " \\\\"]
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]


def write_table(table: DataFrame, path: str, style: str = "markdown", order: str | None = None) -> None:
    """A report's table, a row a system, as one text file's folder."""
    head = table.sparkSession.createDataFrame([(i, x) for i, x in enumerate(header(table, style))], "at bigint, line string")
    body = lines(table.orderBy(order or table.columns[0]), style).select((F.monotonically_increasing_id() + 100).alias("at"), "line")
    out = head.unionByName(body)
    if style == "tex":
        out = out.unionByName(table.sparkSession.createDataFrame([(2**62, "\\end{tabular}")], "at bigint, line string"))
    out.coalesce(1).sortWithinPartitions("at").select("line").write.mode("overwrite").text(path)
