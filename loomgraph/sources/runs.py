"""Runs of an experiment: the manifest, resumable predictions with their errors, and the files that a run leaves."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import engine, stats
from loomgraph.storage import materialised

MANIFEST = "run string, seed bigint, pool string, config string, dev_ids array<string>, test_ids array<string>"


def ablated(*changed: str) -> dict[str, bool]:
    """The engine's switches, those named turned the other way."""
    return engine.switched(**{name: not engine.SWITCHES.get(name, True) for name in changed})


def first_answerable(questions: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n answerable questions by their place."""
    return questions.where("answerable").orderBy(order).limit(n)


def draw_sample(questions: DataFrame, n: int, seed: int, exclude_first: int, pool: str = "test", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(development ids, drawn ids). The first answerable questions are for development; `pool` says which side is drawn from."""
    dev = first_answerable(questions, exclude_first, order).select("id")
    rows = questions.join(dev, "id", "left_semi" if pool == "dev" else "left_anti")
    return dev, stats.seeded_sample(rows.select("id"), "id", n, seed)


def manifest(spark: SparkSession, path: str, run: str, questions: DataFrame, n: int, seed: int, exclude_first: int, config: str, pool: str = "test") -> DataFrame:
    """The manifest of a run: drawn once, then read; another configuration or pool is refused."""
    known = None
    try:
        known = spark.read.schema(MANIFEST).parquet(path).where(F.col("run") == run)
        found = known.limit(1).collect()
    except Exception as e:  # no run has written there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = []
    if found:
        if found[0]["config"] != config or found[0]["pool"] != pool:
            raise ValueError(f"run {run} was drawn with another configuration or pool")
        return known
    dev, test = draw_sample(questions, n, seed, exclude_first, pool)
    ids = lambda df: F.array_sort(F.collect_list("id"))
    row = dev.agg(ids(dev).alias("dev_ids")).crossJoin(test.agg(ids(test).alias("test_ids")))  # one row by one row
    shown = row.select(F.lit(run).alias("run"), F.lit(seed).cast("bigint").alias("seed"), F.lit(pool).alias("pool"), F.lit(config).alias("config"), "dev_ids", "test_ids")
    shown.write.mode("append").parquet(path)
    return spark.read.schema(MANIFEST).parquet(path).where(F.col("run") == run)


def predicted(questions: DataFrame, answer: Callable[[dict], str]) -> DataFrame:
    """(id, predicted, error) by a function of a question's row; what it raises is kept as the row's error."""

    def work(batches):
        for b in batches:
            rows = []
            for q in b.to_dict("records"):
                try:
                    rows.append((q["id"], answer(q), None))
                except Exception as e:
                    rows.append((q["id"], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "predicted", "error"])

    return questions.mapInPandas(work, "id string, predicted string, error string")


def whole_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of a JSON file that are whole records with an id."""
    lines = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return lines.where("_broken IS NULL AND id IS NOT NULL").drop("_broken")


def recovered(spark: SparkSession, path: str) -> None:
    """Finishes or undoes what a rewrite of a folder that broke off left behind.

    The new folder is written beside the old one and takes its place by two renames. If it
    is missing in between, the new one takes its place if it is whole, else the old one returns.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    at, after, before = (jvm.Path(path.rstrip("/") + end) for end in ("", "._next", "._last"))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        if files.exists(jvm.Path(after, "_SUCCESS")):
            files.rename(after, at)
        elif files.exists(before):
            files.rename(before, at)
    for rest in (after, before):
        files.delete(rest, True)


def compacted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rewrites a prediction folder without its broken lines, and gives the ids that are finished.

    At any time either the old or the new folder is whole, and `recovered`, which is run first, finds it.
    """
    recovered(spark, path)
    jvm = spark._jvm.org.apache.hadoop.fs
    at, after, before = (jvm.Path(path.rstrip("/") + end) for end in ("", "._next", "._last"))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole_lines(spark, path, schema).write.mode("overwrite").json(after.toString())
    files.rename(at, before)
    files.rename(after, at)
    files.delete(before, True)
    return whole_lines(spark, path, schema).select("id").distinct()


def write_run(path: str, predictions: DataFrame, gold: DataFrame, metrics: DataFrame, cases: DataFrame) -> None:
    """Predictions, gold, metrics and debug cases of a run as JSON."""
    for name, df in (("predictions", predictions), ("gold", gold), ("metrics", metrics.coalesce(1)), ("cases", cases)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def synthetic_events(spark: SparkSession, n: int) -> DataFrame:
    """n storage events of the benchmark: the keys repeat every 20 institutions, 25 years and 10 cities."""
    i = F.col("id")
    roles = F.create_map(F.lit(":ARG0"), F.concat(F.lit("Institution_"), i % 20), F.lit(":ARG1"), F.concat(F.lit("Researcher_"), i))
    year = (2000 + i % 25).cast("bigint")
    return spark.range(n).select(
        F.concat(F.lit("ev_"), i).alias("event_id"), F.lit("employ").alias("lemma"), F.lit("employ.01").alias("sense_id"), roles.alias("roles"),
        F.struct(year.cast("string").alias("raw_expression"), year.alias("start_year"), year.alias("end_year")).alias("time_context"),
        F.struct(F.concat(F.lit("City_"), i % 10).alias("location_name"), F.lit(None).cast("string").alias("parent_region")).alias("spatial_context"),
        F.struct(F.lit("benchmark").alias("source"), F.lit(0.95).alias("confidence"), F.lit(False).alias("is_speculative")).alias("epistemic_context"),
    )


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a table's folder or file, and of the files beside it whose name continues its own with a dot."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.*")) or []
    own = [files.getContentSummary(at).getLength()] if files.exists(at) else []
    return sum(own) + sum(files.getContentSummary(f.getPath()).getLength() for f in beside)


#: What matters in JSON for its nesting: strings, whole or broken off, and brackets.
_NESTING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{}]', re.DOTALL)


def salvaged(raw: str) -> str | None:
    """The complete events of a JSON text that breaks off: one pass over its brackets finds where it can be cut and closed."""
    text = raw[raw.find("{") :] if "{" in raw else ""
    open_: list[str] = []
    cuts: list[tuple[int, str]] = []
    for m in _NESTING.finditer(text):
        mark = m.group()
        if mark in ("{", "["):
            open_.append("}" if mark == "{" else "]")
        elif mark in ("}", "]"):
            if not open_ or open_.pop() != mark:
                break
            if mark == "}" and open_ in (["}"], ["}", "]"]):
                cuts.append((m.end(), "".join(reversed(open_))))
            if not open_:
                break
    for end, close in reversed(cuts):
        try:
            whole = json.loads(text[:end] + close)
        except ValueError:
            continue
        return json.dumps(whole, ensure_ascii=False) if isinstance(whole.get("events"), list) else None
    return None


@F.pandas_udf(T.StringType())
def salvaged_json(raw: pd.Series) -> pd.Series:
    """Each text as `salvaged` has it."""
    return raw.map(lambda x: salvaged(x) if isinstance(x, str) else None)
