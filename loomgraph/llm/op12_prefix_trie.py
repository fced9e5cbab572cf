"""Prefix trie of conversations: one node for every distinct beginning.

Turns are hashed where they are read, so texts don't travel. Turns are numbered by a range
sort and prefix sums, so that no task holds a conversation. Equal conversations are one
entry with a weight. Entries are dealt by their first turn's digest, several first turns
to a bucket, and each bucket's tries are built inside applyInPandas: dictionaries from
(node, turn) to node, walked in postorder without recursion. A first turn with more turns
below it than a bucket may hold isn't built there: Spark's aggregates give the nodes that
all its entries share, and the entries are dealt again by the next turn, as often as
needed. What the subtries found is then added up the shared nodes, deepest first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import partitions, written

#: Turns that a bucket of tries should have, and that one first turn may have in it.
BUCKET, MOST = 50_000, 100_000
#: conv_ids joined to one piece of text before it is hashed.
IDS = 50_000
NONE_SHA = hashlib.sha256(b"").hexdigest()
NODE = "g binary, above binary, top boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, size) of each turn: its place from 1, its digest, and its text's code points.

    Turns go by `turn`, null first, equal ones by digest. A null conv_id is no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"), "turn", F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.length(text).cast("bigint").alias("size")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    dealt = written(dealt.select("conv_id", "key", "size", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row")), "turns")
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy("conv_id", "task").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    spans = spans.select("conv_id", "task", (1 - F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("shift"))
    return dealt.join(spans, ["conv_id", "task"]).select("conv_id", (F.col("row") + F.col("shift")).alias("at"), "key", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, depth, key, size), and all conv_ids.

    Conversation c has the first h turns of conversation c - c % 100, h = crc32(c) % 6, and
    then its own from the one after its first h.
    """
    turns = written(turns, "numbered")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = F.crc32(F.col("conv_id").cast("string")) % 6
    block = F.col("conv_id") - F.col("conv_id") % 100
    heads = convs.select("conv_id", own.alias("h"), block.alias("block"))
    base = convs.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("block"), "n")
    heads = written(heads.join(base, "block", "left").select("conv_id", "h", "block", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")), "heads")
    rest = turns.join(heads.select("conv_id", "h", "taken"), "conv_id").where(F.col("at") > F.col("h"))
    rest = rest.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "key", "size")
    # at most five turns and a hundred conversations a block
    begins = turns.where((F.col("conv_id") % 100 == 0) & (F.col("at") <= 5)).select(F.col("conv_id").alias("block"), F.col("at").alias("depth"), "key", "size")
    begins = begins.join(heads.select("conv_id", "block", "taken"), "block").where(F.col("depth") <= F.col("taken"))
    return written(rest.unionByName(begins.select("conv_id", "depth", "key", "size")), "rebuilt"), heads.select("conv_id")


def distinct(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, n, w, ends) of each distinct conversation: its smallest conv_id, its turns, how many it stands for, and the SHA-256 of their conv_ids.

    The conv_ids are joined to pieces of text in many tasks; only their hash, which has no
    parts, goes over a conversation's pieces one after another.
    """
    what = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("depth", "key")).alias("x"), F.bit_xor(F.xxhash64("key", "depth")).alias("y"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    what = ids.join(what, "conv_id", "left").select(zero("n"), zero("x"), zero("y"), "conv_id")
    spark = turns.sparkSession

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for b in batches:
            for *at, conv in zip(*(c.to_pylist() for c in b.columns)):
                if ids and (at != key or len(ids) == IDS):
                    yield piece(key, ids)
                    ids = []
                key = at
                ids.append(conv)
        if ids:
            yield piece(key, ids)

    def piece(key: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"n": key[0], "x": key[1], "y": key[2], "first": ids[0], "count": len(ids), "ids": ",".join(map(str, ids))}])

    pieces = what.repartitionByRange(partitions(spark), "n", "x", "y", "conv_id").sortWithinPartitions("n", "x", "y", "conv_id").mapInArrow(joined, "n bigint, x bigint, y bigint, first bigint, count bigint, ids string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, count, sha = None, 0, 0, None
        for b in batches:
            for r in b.to_pylist():
                if (at := (r["n"], r["x"], r["y"])) != key:
                    if key is not None:
                        yield done(first, key, count, sha)
                    key, first, count, sha = at, r["first"], 0, hashlib.sha256()
                sha.update(("," if count else "").encode() + r["ids"].encode())
                count += r["count"]
        if key is not None:
            yield done(first, key, count, sha)

    def done(first: int, key: tuple, count: int, sha) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": first, "n": key[0], "w": count, "ends": sha.hexdigest()}])

    dealt = written(pieces, "ids").repartition(partitions(spark), "n", "x", "y").sortWithinPartitions("n", "x", "y", "first")
    return written(dealt.mapInArrow(hashed, "conv_id bigint, n bigint, w bigint, ends string"), "distinct")


def trie(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's tries, as rows of NODE, from its conversations' turns (see `nodes`)."""
    rows = rows.sort_values(["g", "conv_id", "depth"], kind="stable")
    into: dict[tuple, int] = {}  # (node, turn's digest) or (None, first turn's group): node
    parent, found, n, n_children, value, ends = [], [], [], [], [], []
    at = last = None
    for g, above, up, conv, depth, key, size, w, end in rows[["g", "above", "up", "conv_id", "depth", "key", "size", "w", "ends"]].itertuples(index=False):
        here = (None, g) if (g, conv) != last else (at, key)
        last = (g, conv)
        if (node := into.get(here)) is None:
            node = into[here] = len(parent)
            parent.append(None if here[0] is None else at)
            found.append((g, above, here[0] is None, conv, depth, up))  # conversations ascend: the first is the smallest
            n.append(0), n_children.append(0), value.append(size), ends.append(NONE_SHA)
            if here[0] is not None:
                n_children[at] += 1
        n[node] += w
        at = node
        if end is not None:
            ends[node] = end
    leaves, saved = [0] * len(parent), [(k - 1) * size for k, size in zip(n, value)]
    for node in _postorder(parent):
        leaves[node] += n_children[node] == 0
        if (p := parent[node]) is not None:
            leaves[p] += leaves[node]
            saved[p] += saved[node]
    out = [(*f[:5], f[5] if p is None else found[p][3], *rest) for f, p, *rest in zip(found, parent, n, n_children, leaves, saved, ends)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])


def _postorder(parent: list) -> Iterator[int]:
    """Nodes, every one after its children, by a stack instead of recursion."""
    children: list[list[int]] = [[] for _ in parent]
    stack = []
    for node, p in enumerate(parent):
        (stack if p is None else children[p]).append(node)
    while stack:
        node = stack[-1]
        if children[node]:
            stack.append(children[node].pop())
        else:
            yield stack.pop()


def _dealt_again(big: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For groups that are too large: the nodes that all their entries share, and the entries' other turns in new groups.

    The shared nodes are (g, above, up, depth, conv_id, n_convs, size, ends, last), `last`
    being the deepest one's depth.
    """
    levels = big.groupBy("g", "depth").agg(
        F.min("key").alias("key"), F.max("key").alias("key2"), F.count("*").alias("rows"), F.sum("w").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.max("ends").alias("ends")
    )
    levels = written(levels.join(first, "g"), "levels")
    apart = (F.col("key") != F.col("key2")) | (F.col("rows") != F.col("entries"))
    last = levels.groupBy("g").agg(F.coalesce(F.min(F.when(apart, F.col("depth"))) - 1, F.max("depth")).alias("last"), F.min("conv_id").alias("least"))
    shared = written(levels.join(last, "g").where(F.col("depth") <= F.col("last")).select("g", "above", "up", "depth", "conv_id", "n_convs", "size", "ends", "last"), "shared")
    below = big.join(last, "g").where(F.col("depth") > F.col("last"))
    turn = below.where(F.col("depth") == F.col("last") + 1).select("conv_id", F.unhex(F.md5(F.concat("g", "key"))).alias("next"))
    below = below.join(turn, "conv_id").select(F.col("next").alias("g"), F.col("g").alias("above"), F.col("least").alias("up"), "conv_id", "depth", "key", "size", "w", "ends")
    return shared, written(below, "dealt")


def _summed(shared: DataFrame, tops: DataFrame | None) -> DataFrame:
    """Nodes that the entries of large groups share, from what was found below them."""
    if tops is not None:
        below = tops.groupBy(F.col("above").alias("g")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        shared = shared.join(below, "g", "left")
    else:
        shared = shared.select("*", *(F.lit(None).cast("bigint").alias(c) for c in ("children", "leaves", "saved")))
    deeper = Window.partitionBy("g").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    higher = Window.partitionBy("g").orderBy("depth")
    top = F.lag("conv_id").over(higher).isNull()
    end = F.col("depth") == F.col("last")
    return shared.select(
        "g", "above", top.alias("top"), "conv_id", "depth", F.when(top, F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(end, F.coalesce("children", F.lit(0))).otherwise(1).cast("bigint").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + F.sum((F.col("n_convs") - 1) * F.col("size")).over(deeper)).cast("bigint").alias("saved_tokens"),
        F.coalesce(F.when(end, F.col("ends")), F.lit(NONE_SHA)).alias("ends_sha256"),
    )


def nodes(conversations: DataFrame, bucket: int = BUCKET, most: int = MOST) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, a null turn comes first, equal turns go by their digest,
    repeated rows are turns of their own, rows without a conv_id belong to no conversation.
    Other columns aren't read. A table without conversations has no node, not even a root.
    """
    spark = conversations.sparkSession
    turns, ids = rebuilt(numbered(conversations.select("conv_id", "turn", "role", "text")))
    entries = distinct(turns, ids)
    whole = entries.agg(F.min("conv_id"), F.sum("w"), F.max(F.when(F.col("n") == 0, F.col("ends")))).first()
    if whole[0] is None:
        return spark.createDataFrame([], NODE).drop("g", "above", "top")
    begin = turns.where(F.col("depth") == 1).select("conv_id", F.col("key").alias("g"))
    own = turns.join(entries.join(begin, "conv_id"), "conv_id")
    left = own.select("g", F.lit(None).cast("binary").alias("above"), F.lit(whole[0]).alias("up"), "conv_id", "depth", "key", "size", "w", F.when(F.col("depth") == F.col("n"), F.col("ends")).alias("ends"))
    left, found, chains = written(left, "entries"), [], []
    while True:
        sizes = written(left.groupBy("g").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("entries"), F.first("above").alias("above"), F.first("up").alias("up")), "sizes")
        total, large = sizes.agg(F.coalesce(F.sum("turns"), F.lit(0)), F.coalesce(F.sum((F.col("turns") > most).cast("int")), F.lit(0))).first()
        if not total:
            break
        large_groups = sizes.where(F.col("turns") > most)
        small = left.join(large_groups.select("g"), "g", "left_anti") if large else left
        buckets = max(partitions(spark), math.ceil(total / bucket))
        dealt = small.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
        found.append(written(dealt.groupBy("bucket").applyInPandas(trie, NODE), "tries"))
        if not large:
            break
        shared, left = _dealt_again(left.join(large_groups.select("g"), "g", "left_semi"), large_groups.select("g", "entries", "above", "up"))
        chains.append(shared)
    return _added_up(spark, found, chains, whole)


def _added_up(spark, found: list[DataFrame], chains: list[DataFrame], whole) -> DataFrame:
    """All nodes, from the deepest dealing up to the root."""
    tops = None
    for level in range(max(len(found), len(chains)) - 1, -1, -1):
        here = found[level : level + 1]
        if level < len(chains):
            found.append(chain := written(_summed(chains[level], tops), "chains"))
            here = [*here, chain]
        tops = here[0].where("top")
        for more in here[1:]:
            tops = tops.unionByName(more.where("top"))
    below = tops.agg(F.count("*"), F.coalesce(F.sum("n_leaves"), F.lit(1)), F.coalesce(F.sum("saved_tokens"), F.lit(0))).first() if tops is not None else (0, 1, 0)
    root = (None, None, False, whole[0], 0, None, whole[1], below[0], below[1], below[2], whole[2] or NONE_SHA)
    out = spark.createDataFrame([root], NODE)
    for more in found:
        out = out.unionByName(more)
    return out.drop("g", "above", "top")


#: Every node by the list of its turns; crc32 is computed from the digits of conv_id.
ORACLE_SQL = """WITH own AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
   lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, d: xor(c >> 1, (c & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 6 h FROM own),
 rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) turns FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
 begun AS (SELECT conv_id, d, turns[1:d] path, len(turns) = d ends FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) d)),
 node AS MATERIALIZED (
  SELECT path, d, min(conv_id) conv_id, count(*) n, (count(*) - 1) * coalesce(length(path[-1].text), 0) own,
   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) sha FROM begun GROUP BY path, d),
 child AS (SELECT path[1:d - 1] path, d - 1 d, count(*) k FROM node WHERE d > 0 GROUP BY ALL),
 full_node AS MATERIALIZED (SELECT node.*, coalesce(k, 0) k FROM node LEFT JOIN child USING (path, d)),
 below AS (
  SELECT n.path, n.d, sum(m.own) saved, count(*) FILTER (m.k = 0) leaves FROM full_node n, full_node m WHERE m.d >= n.d AND m.path[1:n.d] = n.path GROUP BY ALL)
SELECT n.conv_id, n.d depth, p.conv_id parent_conv_id, n.n n_convs, n.k n_children, leaves n_leaves, saved::BIGINT saved_tokens, n.sha ends_sha256
FROM full_node n JOIN below USING (path, d) LEFT JOIN full_node p ON p.d = n.d - 1 AND n.d > 0 AND p.path = n.path[1:n.d - 1]"""
