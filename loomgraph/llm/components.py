"""Connected components of a graph of integer nodes, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, written


SALTS = 8


def shared_join(rows: DataFrame, few: DataFrame, key: str, of: str, spread: str) -> DataFrame:
    """Left join of rows with one row a key, whose rows are dealt to SALTS tasks by another column: for keys that many rows have."""
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, (F.col(key) == F.col(of)) & (F.col("_share") == F.col("_salt")), "left").drop("_salt", "_share")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Each round gives a node the least label among its own and its neighbours', then follows
    the label's own label, so that paths halve. Rounds are written to the shared folder. The
    labels only fall; the end is a round that changes none. Nulls and loops are left out; an
    empty edge table gives no rows.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        better = labels.join(near, labels.node == near.a, "left").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        # most nodes of a large component have one root: it is looked up once, and joined in SALTS shares
        asked = better.groupBy("root").agg(F.lit(1).alias("one"))
        up = asked.join(better.select(F.col("node").alias("of"), F.col("root").alias("up")), F.col("root") == F.col("of")).select(F.col("root").alias("of"), "up")
        jumped = shared_join(better, up, "root", "of", "node").select("node", F.least("root", "up").alias("root"), "was")
        now = written(jumped, "labels")
        changed = now.where("root <> was").limit(1).count()
        dropped(labels)
        labels = now.select("node", "root")
        if not changed:
            dropped(both)
            return labels
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
