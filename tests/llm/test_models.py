import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import op01_quality as quality
from loomgraph.llm import op02_language as language
from loomgraph.llm import op03_katz as katz

from .cases import awkward, clashing, frame, prose


def test_quality_separates_junk(spark):
    good = prose(200)
    junk = [(1000 + i, " ".join(w + "###" for w in t.split())) for i, t in good[:15]] + [(2000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in good[15:30] if len(t) > 60]
    rows = quality.classified(clashing(frame(spark, good + junk))).select("doc_id", "keep").collect()
    kept = {r.doc_id for r in rows if r.keep}
    assert kept == {i for i, _ in good}


def test_quality_sees_whole_long_words():
    clean, junk = b"a" * 2000, b"a" * 960 + b"#A$1" * 20 + b"a" * 960
    assert quality.features(clean)[1].tolist() != quality.features(junk)[1].tolist()
    same = quality.features(b"short words only, " + b"x" * 48)
    assert np.isclose((same[2][:-1] ** 2).sum(), 1) and np.isclose((quality.features(junk)[2][:-1] ** 2).sum(), 1)


def test_quality_awkward(spark):
    df = clashing(frame(spark, awkward()))
    out = quality.accepted(df)
    assert out.columns == df.columns
    assert quality.classified(df).count() == len(awkward())
    assert quality.classified(frame(spark, [])).count() == 0


def test_em_finds_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.9
    k = len(quality.LABELLERS)
    codes = np.zeros(len(truth), np.int64)
    for j in range(k):
        bad = r.random(len(truth)) < np.where(truth, 0.02, 0.6)
        codes = codes * 3 + np.where(bad, quality.BAD, quality.GOOD if j >= 6 else quality.NONE)
    patterns, counts = np.unique(codes, return_counts=True)
    posterior, says, share = quality.estimate(patterns, counts)
    assert abs(share - 0.9) < 0.02 and np.abs(says[0] - 0.6).max() < 0.12 and says[1].max() < 0.04
    assert np.mean([(posterior[c] > 0.5) == t for c, t in zip(codes.tolist(), truth)]) > 0.97


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.identified(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_language_awkward(spark):
    rows = awkward() + [(50, "1234 ... 56"), (51, "東京")]
    df = clashing(frame(spark, rows)).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "aa").when(F.col("doc_id") > 5, "bb"))
    got = {(r.doc_id, r.lang_pred) for r in language.identified(df, F.lit(False)).collect()}
    assert {i for i, p in got if p == "und"} == {2, 3, 4, 50}
    assert language.identified(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).where("lang_pred <> 'und'").count() == 0
    assert language.identified(df.limit(0), F.lit(False)).count() == 0


@pytest.mark.parametrize("chunk", [400, 10_000_000])
def test_katz_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    rows = prose(60) + [(100 + i, t) for i, t in awkward()[:4]] + [(200, "Ka ka lora ka ka lora"), (200, "Ka ka lora ka ka lora")]
    held = lambda i: i is not None and i % 3 == 0
    got = katz.scored(clashing(frame(spark, rows)), F.col("doc_id") % 3 == 0).collect()
    docs = [(i, [*(t or "").lower().split(), None]) for i, t in rows]
    uni, pairs = collections.Counter(), collections.Counter()
    for i, w in docs:
        if not held(i):
            uni.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w))
    n, followers = sum(uni.values()), collections.defaultdict(dict)
    norm = n + 0.1 * (len(uni) + 1)
    for (h, w), c in pairs.items():
        followers[h][w] = c
    often = collections.Counter(pairs.values())
    d = katz.discounts([often[r] for r in range(1, katz.TOP + 2)])
    p1 = lambda w: (uni[w] + 0.1) / norm
    cut = lambda c: d[c] if c <= katz.TOP else 1.0

    def p2(h, w):
        seen = followers.get(h)
        if not seen:
            return p1(w)
        total = sum(seen.values())
        total += all(cut(c) == 1 for c in seen.values())
        if w in seen:
            return cut(seen[w]) * seen[w] / total
        left = 1 - sum(cut(c) * c for c in seen.values()) / total
        return left * p1(w) / (1 - sum(p1(x) for x in seen))

    for h in [*list(followers)[:5], "never"]:
        assert math.isclose(sum(p2(h, w) for w in uni) + (0.1 / norm) * p2(h, "unseen") / p1("unseen"), 1, rel_tol=1e-9)
    want = sorted((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, round(sum(math.log10(p1(x)) for x in w), 6), round(sum(math.log10(p2(h, x)) for h, x in zip(["<s>", *w[:-1]], w)), 6)) for i, w in docs)
    assert sorted((*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == want


@pytest.mark.parametrize("chunk, order", [(400, 3), (10_000_000, 3), (1000, 4)])
def test_katz_orders_against_recursion(spark, monkeypatch, chunk, order):
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    rows = prose(60) + [(100 + i, t) for i, t in awkward()[:4]] + [(200, "ka lora mi ka lora mi te ka lora mi")] * 2
    held = lambda i: i is not None and i % 3 == 0
    docs = [(i, [*(t or "").lower().split(), None]) for i, t in rows]
    grams = {k: collections.Counter() for k in range(1, order + 1)}
    padded = lambda w: ["<s>"] * (order - 1) + w
    for i, w in docs:
        for k, c in grams.items():
            if not held(i):
                c.update(tuple(padded(w)[j - k + 1 : j + 1]) for j in range(order - 1, len(w) + order - 1))
    n, norm = sum(grams[1].values()), sum(grams[1].values()) + 0.1 * (len(grams[1]) + 1)
    seen = collections.defaultdict(dict)
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            seen[g[:-1]][g[-1]] = c
    ds = {k: katz.discounts([sum(c == r for c in grams[k].values()) for r in range(1, katz.TOP + 2)]) for k in range(2, order + 1)}
    known = {}

    def p(h, w):
        if (h, w) in known:
            return known[h, w]
        if not h:
            return (grams[1][(w,)] + 0.1) / norm
        here, cut = seen.get(h), lambda c: ds[len(h) + 1][c] if c <= katz.TOP else 1.0
        if not here:
            return p(h[1:], w)
        total = sum(here.values()) + all(cut(c) == 1 for c in here.values())
        if w in here:
            out = cut(here[w]) * here[w] / total
        else:
            out = (1 - sum(cut(c) * c for c in here.values()) / total) * p(h[1:], w) / (1 - sum(p(h[1:], x) for x in here))
        known[h, w] = out
        return out

    score = lambda w: sum(math.log10(p(tuple(padded(w)[j : j + order - 1]), x)) for j, x in enumerate(w))
    got = sorted((r.doc_id, r.n_tokens, r.train_tokens, round(r.score, 6)) for r in katz.scored(clashing(frame(spark, rows)), F.col("doc_id") % 3 == 0, order=order).collect())
    assert got == sorted((i, len(w), n, round(score(w), 6)) for i, w in docs)


def test_katz_empty(spark):
    assert katz.scored(frame(spark, []), F.lit(False)).count() == 0
    one = katz.scored(frame(spark, [(1, "a b"), (None, None)]), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in one)
    assert random.Random(0).random() < 1
