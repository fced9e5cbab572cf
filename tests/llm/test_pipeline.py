"""The five stages in sequence on planted documents, against plain versions of the stages."""

import hashlib
import math

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .cases import prose
from .test_duplicates import WORD, groups_by_brute_force, print_of

ITEM = "which river of the old kingdom carried the grain barges from the northern hills down to the harbour before winter"
SHORT = "zanzibar quartz xylophone"
PASSAGE = " ".join(f"{a}{b}{c}" for a in ("vo", "pel", "nu", "gra") for b in ("min", "tas", "ro", "ke") for c in ("da", "sel", "un", "fi"))  # 64 words


def planted():
    """Rows of documents, and the ids of those that the classifier must reject."""
    good = prose(150, seed=11)
    clean = [(i, t) for i, t in good if len(t.split()) >= 12]
    rows = list(clean)
    rows += [(1000 + i, t) for i, t in clean[:8]]  # exact copies
    rows += [(1100 + i, t + " ka") for i, t in clean[8:12] if len(t) > 250]  # near copies
    rows += [(1200 + i, f"{t} {PASSAGE} {t.split()[0]}") for i, t in clean[20:24]]
    rows += [(1300, f"{clean[30][1]} {ITEM.upper()}, {clean[31][1]}"), (1301, f"{clean[32][1]} ({SHORT}) {clean[33][1]}")]
    rows += [(1302, f"{clean[34][1]} {' '.join(ITEM.split()[:12])}. {clean[35][1]}")]  # too little of the item
    rows += [(1400, None), (1401, ""), (1402, " \t\n"), (None, "a text of its own that has no number and no copy among all of these. It is short. It ends here.")]
    rows += [clean[40], clean[40]]
    junk = [(2000 + i, " ".join(w + "###" for w in t.split())) for i, t in clean[:12]] + [(3000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in clean[50:60]]
    return rows + junk, {i for i, _ in junk}, {i for i, _ in clean}


def folder(spark, path, rows):
    docs = [(i, t, "en", "src0", None if t is None else len(t), 0, "x", True) for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, _chunk int, fingerprint string, keep boolean").repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, ITEM), (1, ITEM), (2, SHORT), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def one_of_each_group(rows):
    rank = lambda i: 2**63 if i is None else i
    top = groups_by_brute_force([print_of(t) for _, t in rows])
    least = {}
    for g, (i, _) in zip(top, rows):
        least[g] = min(least.get(g, 2**63), rank(i))
    kept = {rank(i): (i, t) for g, (i, t) in zip(top, rows) if rank(i) == least[g]}
    return list(kept.values())


def without_repeats(rows, width=50):
    rank = lambda i: 2**63 if i is None else i
    first, out = {}, []
    windows = lambda w: [tuple(w[p : p + width]) for p in range(len(w) - width + 1)]
    for i, t in rows:
        for k in windows(WORD.findall(t or "")):
            first[k] = min(first.get(k, 2**63), rank(i))
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = {q for p, k in enumerate(windows(words)) if first[k] < rank(i) for q in range(p, p + width)}
        out.append((i, " ".join(x for p, x in enumerate(words) if p not in gone) if gone else t))
    return out


def shingles(text, n):
    w = "".join(c.lower() if c.isalnum() or ord(c) >= 128 else " " for c in text or "").split()
    return {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}


def contains(text):
    item = shingles(ITEM, 5)
    return len(item & shingles(text, 5)) >= 0.8 * len(item) or bool(shingles(SHORT, 3) & shingles(text, 3))


def test_stages_in_sequence(spark, tmp_path):
    rows, junk, clean = planted()
    path = folder(spark, tmp_path / "in", rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, path)
    assert first.columns == docs.columns
    kept = [tuple(r) for r in first.select("doc_id", "text").collect()]
    ids = {i for i, _ in kept}
    assert not ids & junk and clean <= ids and {1300, 1301, 1302} <= ids

    left = one_of_each_group(kept)
    assert not {i for i, _ in left if i and 1000 <= i < 1100}
    parted = without_repeats(left)
    assert sum(PASSAGE in (t or "") for _, t in parted) == 1 < sum(PASSAGE in (t or "") for _, t in left)
    last = [(i, t) for i, t in parted if not contains(t)]
    assert {i for i, _ in parted} - {i for i, _ in last} == {1300, 1301}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in last:
        own = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lengths_follow_the_text(spark, tmp_path):
    rows, _, _ = planted()
    path = folder(spark, tmp_path / "in", rows)
    out = corpus_pipeline.substrings(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_empty_tables(spark, tmp_path):
    path = folder(spark, tmp_path / "in", [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_posteriors_against_em_by_document(spark):
    """The model on the pattern table gives what the same model gives document by document."""
    from loomgraph.llm import op01_quality as quality

    rows, _, _ = planted()
    said, k = [], len(quality.LABELLERS)
    for _, t in rows:
        code = quality.features((t or "").encode())[0]
        said.append([code // 3 ** (k - 1 - j) % 3 for j in range(k)])
    silent = [all(v[j] != quality.GOOD for v in said) for j in range(k)]
    good = [0.95 * 0.1 ** min(6, v.count(quality.BAD)) for v in said]
    for _ in range(200):
        share = (sum(good) + 0.95) / (len(good) + 1)
        rates = []
        for y in (0, 1):
            weight = [p if y else 1 - p for p in good]
            mass = quality.PRIOR * sum(weight) + 1
            heard = [[w for w, v in zip(weight, said) if silent[j] or v[j] != quality.NONE] for j in range(k)]
            bad = [[w for w, v in zip(weight, said) if v[j] == quality.BAD] for j in range(k)]
            rates.append([(sum(bad[j]) + quality.SAYS_BAD[y] * mass) / (sum(heard[j]) + mass) for j in range(k)])
        good = []
        for v in said:
            like = [1 - share, share]
            for j in range(k):
                if silent[j] or v[j] != quality.NONE:
                    like = [p * (rates[y][j] if v[j] == quality.BAD else 1 - rates[y][j]) for y, p in enumerate(like)]
            good.append(like[1] / sum(like))
    df = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    found = {r.doc_id: r.weak_label for r in quality.classified(df).collect()}
    assert all(math.isclose(found[n], p, abs_tol=1e-6) for n, p in enumerate(good))


def test_scorer_ranks_what_the_labellers_pass(spark):
    """Slightly dirty texts, on which no labeller says bad: the votes can't part them, the scorer does."""
    from loomgraph.llm import op01_quality as quality

    rows, _, _ = planted()
    long = [(i, t) for i, t in prose(150, seed=12) if len(t.split()) >= 40]
    dirty = [(5000 + i, " ".join(w + "#" if n % 8 == 3 else w for n, w in enumerate(t.split()))) for i, t in long]
    df = spark.createDataFrame([*rows, *((4000 + i, t) for i, t in long), *dirty], "doc_id bigint, text string")
    out = {r.doc_id: r for r in quality.classified(df).collect() if r.doc_id and r.doc_id >= 4000}
    passed = [i for i in out if quality.BAD not in np.array(list(np.base_repr(quality.features(dict(dirty + [(4000 + a, t) for a, t in long])[i].encode())[0], 3)), int)]
    assert len([i for i in passed if i >= 5000]) >= 20
    wins = [out[a].quality > out[b].quality for a in passed if a < 5000 for b in passed if b >= 5000]
    assert np.mean(wins) > 0.9
    ties = [out[a].weak_label > out[b].weak_label for a in passed if a < 5000 for b in passed if b >= 5000]
    assert np.mean(ties) < 0.6
