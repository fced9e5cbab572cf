"""Vector codes, prefix tries and packing against plain versions, and their awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from loomgraph.llm import op11_vector_codes as codes
from loomgraph.llm import op12_prefix_trie as tries
from loomgraph.llm import op13_packing as packing
from tests.llm.cases import awkward, frame, prose

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_codes(rows):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    whole = [[math.floor(1024 * x) for x in r[1]] for r in kept if len(r[1]) == len(kept[0][1])]
    books = [[v[p * width : p * width + width] for v in whole[:256]] for p in range(4)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v[p * width : p * width + width], e)), i) for i, e in enumerate(books[p]))
    for _ in range(4):
        found = [[near(v, p) for p in range(4)] for v in whole]
        for p in range(4):
            groups = defaultdict(list)
            for v, f in zip(whole, found):
                groups[f[p][1]].append(v[p * width : p * width + width])
            for i, vs in groups.items():
                books[p][i] = [sum(c) // len(vs) for c in zip(*vs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = [(r[0], r[2], [near(v, p) for p in range(4)]) for r, v in zip(kept, whole)]
    by_label = defaultdict(int)
    for _, label, f in done:
        by_label[label] += sum(d for d, _ in f)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label], sha) for i, label, f in done), key=str)


@pytest.mark.parametrize("scale", [0.3, 3000.0])
def test_vector_codes(spark, scale):
    r = random.Random(5)
    centres = [[r.gauss(0, scale) for _ in range(8)] for _ in range(12)]
    rows = [(i, [float(c + r.gauss(0, scale / 9)) for c in r.choice(centres)], r.choice([1, 2, None])) for i in range(400)]
    rows += [(7, rows[7][1], 1), (500, None, 1), (501, [1.0] * 7 + [None], 1), (502, [float("nan")] * 8, 2), (503, [float("inf")] * 8, 2), (None, rows[3][1], None), (504, rows[5][1], 3)]
    df = spark.createDataFrame(rows, VECTORS)
    rows = [tuple(x) for x in df.collect()]  # as 32-bit floats
    clashing = df.selectExpr("*", "0 code", "1 error", "2 label_error", "3 part", "4 _n", "5 _label").repartition(3)
    assert sorted((tuple(x) for x in codes.digest(clashing).collect()), key=str) == plain_codes(rows)


def test_vector_codes_of_few_or_no_vectors(spark):
    assert codes.digest(spark.createDataFrame([], VECTORS)).count() == 0
    few = [(i, [float(i % 3)] * 4, None) for i in range(5)] + [(9, [1.0] * 8, 1), (10, [], 1)]
    got = codes.digest(spark.createDataFrame(few, VECTORS)).collect()
    assert sorted(x.vec_id for x in got) == [0, 1, 2, 3, 4]
    assert {x.error for x in got} == {0}


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = convs.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = sum(saved[k] for k in children[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=str)


def conversations():
    r = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(100, 160), 205, 206, 999]:
        for turn in range(r.randint(1, 7)):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["yes", "no", "日本", "", "more of it"])))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 330) for t in range(9)]  # copies
    rows += [(c, t, "user", f"grow {t}") for c in range(400, 412) for t in range(c - 398)]  # each goes on from the one before
    rows += [(500, None, None, None), (500, 3, "user", None), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize(("bucket", "most"), [(50_000, 100_000), (40, 30), (5, 3), (1, 0)])
def test_prefix_trie(spark, bucket, most):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "0 g", "1 depth", "2 n").repartition(5)
    got = tries.nodes(df, bucket, most)
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_trie(rows)


def test_prefix_trie_without_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert tries.nodes(spark.createDataFrame([], schema)).count() == 0
    assert tries.nodes(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    only_root = [tuple(x) for x in tries.nodes(spark.createDataFrame([(101, 1, "user", "x")], schema)).collect()]
    assert only_root == plain_trie([(101, 1, "user", "x")])


def plain_packing(sizes, capacity):
    """Sequential best-fit decreasing: the rooms left, one a sequence."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_places_equal_sequential_best_fit(seed):
    r = random.Random(seed)
    counts = {length: r.randint(1, 12) for length in r.sample(range(1, 65), r.randint(1, 40))}
    table = packing.places(counts, 64)
    filled = defaultdict(dict)
    for length, n in counts.items():
        own = sorted(x.tolist() for x in table if x[0] == length)
        for rank in range(n):
            _, first, sequence, each, offset = [x for x in own if x[1] <= rank][-1]
            at = offset + (rank - first) % each * length
            assert at not in filled[s := sequence + (rank - first) // each]
            filled[s][at] = length
    for parts in filled.values():
        assert sorted(parts) == [sum(x for y, x in parts.items() if y < at) for at in sorted(parts)]
    assert sorted(64 - sum(p.values()) for p in filled.values()) == plain_packing([length for length, n in counts.items() for _ in range(n)], 64)
    assert sorted(filled) == list(range(len(filled)))


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()
    rows = awkward() + [(1000 + i, t) for i, t in prose(60)]
    whole = defaultdict(list)
    for i, text in rows:
        whole[i].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    docs = frame(spark, rows).selectExpr("*", "0 length", "1 piece", "2 task", "3 nth").repartition(3)
    got = [x.asDict() for x in packing.digest(docs, path).collect()]
    want = sorted(((i, p, s, n, zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids[s : s + n]))) for i, docs in whole.items() for ids in docs for p, s, n in cut(len(ids))), key=str)
    assert sorted(((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got), key=str) == want
    at = defaultdict(int)
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == at[x["sequence_id"]]
        at[x["sequence_id"]] += x["length"]
    assert sorted(1024 - n for n in at.values()) == plain_packing([x["length"] for x in got], 1024)
    placed = packing.packed(packing.pieces(frame(spark, rows[:3]), path, 2))
    assert [len(x.ids) // 4 for x in packing.sequences(placed).collect()] == [sum(len(d) for i, _ in rows[:3] for d in whole[i])]
    assert packing.digest(frame(spark, []), path).count() == 0


def cut(n, capacity=1024):
    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
    return [(p, x, y - x) for p, (x, y) in enumerate(zip(edges[:-1], edges[1:]))]
