import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import op04_token_files as files
from loomgraph.llm import op10_bpe as bpe

from .cases import awkward, clashing, frame, prose

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def test_segment_tree_gives_the_librarys_ids(library):
    own, r = bpe.Bpe(BYTES), random.Random(1)
    alphabets = ["ab ", "aA1 \n\t'st", "é́  \x1c\x85東京😀ß", "".join(map(chr, range(300)))]
    for k in range(3000):
        text = "".join(r.choice(r_alpha) for r_alpha in [r.choice(alphabets)] for _ in range(r.randint(0, 60)))
        text = text[:5] + "<|endoftext|>" + text[5:] if k % 7 == 0 else text
        ids = library.encode(text, add_special_tokens=False).ids
        mine = own.encode(text)
        assert list(memoryview(mine).cast("I")) == ids
        assert own.decode(mine).decode() == library.decode(ids, skip_special_tokens=False)


def test_long_pretoken(library):
    text = "ab" * 20_000
    assert list(memoryview(bpe.Bpe(BYTES).encode(text)).cast("I")) == library.encode(text).ids


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_digest_on_awkward_rows(spark, library):
    rows = awkward() + prose(30)
    got = bpe.digest(clashing(frame(spark, rows)), BYTES).collect()
    assert sorted(map(tuple, got), key=str) == expected(library, rows)
    assert bpe.digest(frame(spark, []), BYTES).count() == 0


def test_encode_then_decode_keeps_rows_and_columns(spark):
    df = clashing(frame(spark, awkward()))
    back = bpe.decode(bpe.encode(df, BYTES), BYTES)
    assert {(r.doc_id, r.text or "") for r in back.collect()} == {(r.doc_id, r.decoded) for r in back.collect()}
    assert back.count() == len(awkward())


def test_token_files(spark):
    rows = [r for r in awkward() if r[0] is not None] + [(100 + i, t) for i, t in prose(60)]
    rows = list({r[0]: r for r in rows}.values()) + [(None, "no id here")]
    got = [tuple(r) for r in files.token_files(clashing(frame(spark, rows).repartition(3)), WORDS).collect()]
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert files.token_files(frame(spark, []), WORDS).count() == 0
