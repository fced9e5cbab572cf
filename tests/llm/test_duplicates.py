import hashlib
import random
import re

import xxhash

from loomgraph.llm import op08_substring as substring
from loomgraph.llm import op09_simhash as simhash
from loomgraph.llm.components import components

from .cases import awkward, clashing, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_by_brute_force(rows, width=50):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    rank = lambda i: 2**63 if i is None else i
    first = {}
    for i, w in docs:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, 2**63), rank(i))
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < rank(i):
                gone.update(range(p, p + width))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def repeats(n=200):
    r = random.Random(5)
    pool = [" ".join(r.choice("ab") for _ in range(200)), " ".join(["x"] * 130), " ".join(r.choice("abcdefgh") for _ in range(120)), " ".join(["p", "q"] * 80)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            if r.random() < 0.5:
                w = r.choice(pool).split()
                at = r.randint(0, len(w))
                words += w[at : at + r.randint(30, 100)]
            else:
                words += [r.choice("abcdefghxpq") for _ in range(r.randint(0, 60))]
        rows.append((i if i % 17 else i // 2, " ".join(words) if i % 19 else None))
    return rows


def test_substring_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 3000)
    rows = repeats()
    got = substring.digest(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == removed_by_brute_force(rows)


def test_substring_awkward(spark):
    rows = [r for r in awkward() if r[0] != 6]
    assert sorted(map(tuple, substring.digest(clashing(frame(spark, rows))).collect()), key=str) == removed_by_brute_force(rows)
    assert substring.digest(frame(spark, [])).count() == 0
    kept = substring.without_repeats(clashing(frame(spark, repeats(60))))
    assert kept.columns == clashing(frame(spark, [])).columns and kept.count() == 60


def print_of(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups_by_brute_force(fps):
    """Index of each fingerprint's group's representative."""
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    r = random.Random(2)
    rows = prose(80)
    rows += [(100 + i, t + r.choice([" ka", "", " lora"])) for i, t in rows[:40]] + [x for x in awkward() if x[0] not in (5, 6)]
    fps, ids = [print_of(t) for _, t in rows], [i for i, _ in rows]
    top = groups_by_brute_force(fps)
    least = {}
    for t, i in zip(top, ids):
        least[t] = min(filter(lambda x: x is not None, (least.get(t), i)), default=None)
    want = sorted(((i, f"{f:016x}", least[t]) for i, f, t in zip(ids, fps, top)), key=str)
    got = simhash.near_duplicates(clashing(frame(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_of_crowded_fingerprints(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(120)} | {0, 1, 2**63})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.link(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    roots = {x.node: x.root for x in components(links).collect()}
    top = groups_by_brute_force(fps)
    groups = {}
    for i, t in enumerate(top):
        groups.setdefault(t, set()).add(signed[i])
    mine = {}
    for f in signed:
        mine.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_large_posting_by_neighbour_lookup():
    import numpy as np

    own = np.unique(np.random.default_rng(1).integers(0, 1 << 24, 6000, dtype=np.uint64))
    number = simhash.POSITIONS.index((3, 4, 5, 6, 7))
    a, b = simhash._near(own, simhash._flips(number))
    near = {(i, j) for i in range(len(own)) for j in np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= 3) + i + 1}
    assert set(zip(a.tolist(), b.tolist())) == near


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, "quite other words stand in this one text"), (None, "a b c d e f g"), (None, "alone and without any number of its own")]
    kept = simhash.keep_one(clashing(frame(spark, rows))).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(3, rows[0][1]), rows[3], rows[5]], key=str)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(7, 7), (None, 3)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {i: 0 if i <= 20 else 21 for i in range(41)}
    assert components(edges.limit(0)).count() == 0
