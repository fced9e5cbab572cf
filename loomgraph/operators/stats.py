"""Statistics of evaluations: means, intervals, paired tests, agreement, adjustments, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomgraph.storage import materialised, numbered


def mean_or_nan(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(float("nan")))


def upper_median(column: str) -> Column:
    """The element at n // 2 of the sorted values: the lower median, seen from above."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{column})")


#: Distinct values of a group up to which its resamples are counted by value in one task each.
FEW_VALUES = 100_000
#: Resamples that one row of work makes, draws that are made at once, and tasks that share the work, which is small as data.
BLOCK, AT_ONCE, TASKS = 50, 1 << 15, 200
#: Distinct values up to which draws are counted by a comparison each, instead of a search.
FEW_BOUNDS = 32
MASK, MULTIPLIER = (1 << 32) - 1, 0x45D9F3B


def _mix(x):
    """A 32-bit integer hash, of an array or a Column."""
    if isinstance(x, Column):
        for _ in range(2):
            x = (F.shiftrightunsigned(x, 16).bitwiseXOR(x) * MULTIPLIER).bitwiseAND(F.lit(MASK))
        return F.shiftrightunsigned(x, 16).bitwiseXOR(x)
    for _ in range(2):
        x = (x >> np.uint64(16) ^ x) * np.uint64(MULTIPLIER) & np.uint64(MASK)
    return x >> np.uint64(16) ^ x


def _group_hash(seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("grp").cast("string"))), 1, 8), 16, 10).cast("bigint")


def _places(resample: np.uint64, lo: int, hi: int, n: int) -> np.ndarray:
    """Rows that draws lo to hi of a resample take, of n: draws are numbered, so any task makes the same ones."""
    i = np.arange(lo, hi, dtype=np.uint64)
    h = _mix(resample ^ _mix(_mix(i >> np.uint64(32)) ^ (i & np.uint64(MASK))))
    if n < 1 << 31:
        return (h * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    return ((h << np.uint64(32) | _mix(h ^ np.uint64(MULTIPLIER))) % np.uint64(n)).astype(np.int64)


def _counted(keys: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Draws of each resample, by value: those of `_places`, where value k has the rows from ends[k - 1] to ends[k]."""
    drawn = np.zeros((len(keys), len(ends)), np.int64)
    if n >= 1 << 31:
        for lo in range(0, n, AT_ONCE):
            for b, key in enumerate(keys):
                drawn[b] += np.bincount(np.searchsorted(ends, _places(key, lo, min(lo + AT_ONCE, n), n), "right"), minlength=len(ends))
        return drawn
    # a hash h takes row h * n >> 32, which is at or behind ends[k] from the least such h on; 32-bit products wrap by themselves
    bounds = ((ends[:-1].astype(np.uint64) << np.uint64(32)) + np.uint64(n - 1)) // np.uint64(n)
    bounds, sixteen, times = bounds.astype(np.uint32), np.uint32(16), np.uint32(MULTIPLIER)
    high, h = np.empty((2, AT_ONCE), np.uint32)

    def mix(x: np.ndarray, high: np.ndarray) -> None:
        for _ in range(2):
            x ^= np.right_shift(x, sixteen, out=high)
            x *= times
        x ^= np.right_shift(x, sixteen, out=high)

    for lo in range(0, n, AT_ONCE):
        size = min(AT_ONCE, n - lo)
        numbers, at, spare = np.arange(lo, lo + size, dtype=np.uint32), h[:size], high[:size]
        mix(numbers, spare)
        for b, key in enumerate(keys.astype(np.uint32)):
            mix(np.bitwise_xor(numbers, key, out=at), spare)
            if len(ends) <= FEW_BOUNDS:
                behind = [size, *(np.count_nonzero(at >= bound) for bound in bounds), 0]
                drawn[b] -= np.diff(behind)
            else:
                drawn[b] += np.bincount(np.searchsorted(bounds, at, "right"), minlength=len(ends))
    return drawn


def _counted_means(counts: DataFrame, resamples: int) -> DataFrame:
    """Means of resamples of groups with few distinct values: draws are counted by value where they are made."""
    rows = counts.groupBy("grp", "g", "n").agg(F.array_sort(F.collect_list(F.struct("value", "count"))).alias("vs"))
    work = rows.select("grp", "g", "n", F.col("vs.value").alias("values"), F.col("vs.count").alias("counts"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(BLOCK))).alias("b"))
    kind = counts.schema["grp"].dataType

    def resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.select(["g", "n", "values", "counts", "b"]).to_pylist()):
                values, ends, n = np.array(row["values"]), np.cumsum(row["counts"]), row["n"]
                first, last = row["b"], min(row["b"] + BLOCK, resamples)
                keys = _mix(np.uint64(row["g"]) ^ _mix(np.arange(first, last, dtype=np.uint64)))
                drawn = _counted(keys, ends, n)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[at].as_py()] * len(keys), batch.schema.field(0).type), pa.array(np.arange(first, last)), pa.array(drawn @ values / n)], names=["grp", "b", "mean"])

    return work.repartition(TASKS, "grp", "b").mapInArrow(resampled, StructType([StructField("grp", kind), StructField("b", LongType()), StructField("mean", DoubleType())]))


def _joined_means(values: DataFrame, resamples: int) -> DataFrame:
    """Means of resamples of groups with many distinct values: every row makes the draws of its own number, which are joined by place."""
    rows = materialised(numbered(values, ["grp"], ["value"]))
    i = F.col("i")
    drawn = rows.select("grp", "g", "n", F.col("at").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(resamples - 1).cast("bigint"))).alias("b"))
    drawn = drawn.withColumn("key", F.col("g").bitwiseXOR(_mix(F.col("b")))).withColumn("key", _mix(F.col("key")))
    drawn = drawn.withColumn("m", _mix(F.shiftrightunsigned(i, 32)).bitwiseXOR(i.bitwiseAND(F.lit(MASK)))).withColumn("m", F.col("key").bitwiseXOR(_mix(F.col("m")))).withColumn("h", _mix(F.col("m")))
    wide = F.shiftleft("h", 32).bitwiseOR(_mix(F.col("h").bitwiseXOR(F.lit(MULTIPLIER))))
    far = (wide.cast("decimal(38,0)") + F.when(wide < 0, F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(0)) % F.col("n")
    at = F.when(F.col("n") < 1 << 31, F.shiftright(F.col("h") * F.col("n"), 32)).otherwise(far.cast("bigint"))
    return drawn.select("grp", "b", at.alias("at")).join(rows.select("grp", "at", "value"), ["grp", "at"]).groupBy("grp", "b").agg(F.avg("value").alias("mean"))


def resampled_means(values: DataFrame, resamples: int, seed: int = 0) -> DataFrame:
    """(grp, b, mean) of bootstrap resamples of `value` by `grp`; null groups and values are left out.

    Draw i of resample b takes the row, of the group's n in order of their values, that a hash
    of (seed, grp, b, i) names. Where a group has at most FEW_VALUES distinct values, they and
    their counts go to the tasks, each of which counts the draws of some resamples by value; of
    other groups every row makes the draws of its own number. Both give the same means.
    """
    known = values.where("grp IS NOT NULL AND value IS NOT NULL")
    counts = materialised(known.groupBy("grp", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("count")))
    groups = counts.groupBy("grp").agg(F.sum("count").alias("n"), F.count("*").alias("distinct")).withColumn("g", _group_hash(seed))
    few, many = (groups.where(c).drop("distinct") for c in (F.col("distinct") <= FEW_VALUES, F.col("distinct") > FEW_VALUES))
    out = _counted_means(counts.join(few, "grp"), resamples)
    if many.limit(1).count():
        out = out.unionByName(_joined_means(known.select("grp", F.col("value").cast("double").alias("value")).join(many, "grp"), resamples))
    return out


def bootstrap_interval(values: DataFrame, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean: (grp, lo, hi)."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("mean")) - 1
    low, high = int(alpha / 2 * resamples), min(resamples - 1, int((1 - alpha / 2) * resamples))
    ranked = resampled_means(values, resamples, seed).withColumn("at", rank)
    return ranked.groupBy("grp").agg(F.max(F.when(F.col("at") == low, F.col("mean"))).alias("lo"), F.max(F.when(F.col("at") == high, F.col("mean"))).alias("hi"))


def paired_bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Two-sided p of mean(a) = mean(b) by resampling centred differences: (grp, delta, p)."""
    pairs = materialised(pairs)
    seen = pairs.groupBy("grp").agg(F.avg(F.col("a") - F.col("b")).alias("delta"))
    centred = pairs.join(seen, "grp").select("grp", (F.col("a") - F.col("b") - F.col("delta")).alias("value"))
    extreme = resampled_means(centred, resamples, seed).join(seen, "grp").groupBy("grp", "delta").agg(F.count_if(F.abs("mean") >= F.abs("delta") - 1e-12).alias("x"))
    return extreme.select("grp", "delta", ((F.col("x") + 1) / (resamples + 1)).alias("p"))


def _half_tail(k: int, n: int) -> float:
    """Chance of k or fewer of n at one half: the incomplete beta function by its continued fraction."""
    import math

    a, b = n - k, k + 1
    front = math.exp(math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) - n * math.log(2) - math.log(2)) / a
    c, d = 1.0, 1 / (1 - (a + b) * 0.5 / (a + 1))
    total = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * 0.5 / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


@F.pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of k or fewer of n at one half, k being at most half of n."""
    return pd.Series([min(1.0, 2 * _half_tail(int(a), int(b))) if 2 * a < b else 1.0 for a, b in zip(k, n)], dtype=float)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Exact McNemar test of boolean a and b by grp: (grp, b01, b10, p)."""
    counts = pairs.groupBy("grp").agg(F.count_if(~F.col("a") & F.col("b")).alias("b01"), F.count_if(F.col("a") & ~F.col("b")).alias("b10"))
    return counts.withColumn("p", binomial_tail(F.least("b01", "b10"), F.col("b01") + F.col("b10")))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of labels a and b by grp, over pairs without nulls: (grp, n, kappa); 1 where chance agrees always."""
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    n = both.groupBy("grp").agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"))
    side = lambda c: both.groupBy("grp", F.col(c).alias("label")).agg(F.count("*").alias(f"n_{c}"))
    chance = side("a").join(side("b"), ["grp", "label"]).groupBy("grp").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("same"))
    pe = F.coalesce(F.col("same"), F.lit(0)) / (F.col("n") * F.col("n"))
    return n.join(chance, "grp", "left").select("grp", "n", F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def holm(tests: DataFrame) -> DataFrame:
    """Holm's adjusted p of a family of tests (name, p)."""
    order = Window.partitionBy("family").orderBy("p", "name")
    m = F.count("*").over(Window.partitionBy("family"))
    step = tests.withColumn("step", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col("p")))
    return step.withColumn("adjusted", F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: those with the smallest hashes of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key).limit(n)


def runs(rows: DataFrame, part: list[str], order: str, key: str) -> DataFrame:
    """Numbers runs of equal `key` in each part, in order."""
    per = Window.partitionBy(*part).orderBy(order)
    change = F.when(F.lag(key).over(per).eqNullSafe(F.col(key)), 0).otherwise(1)
    return rows.withColumn("change", change).withColumn("run", F.sum("change").over(per.rowsBetween(Window.unboundedPreceding, 0))).drop("change")
