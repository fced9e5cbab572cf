import gzip
import hashlib
import io
import json
import math
import struct
import time
import wave
import zipfile
import zlib

import duckdb
from pyspark.sql import functions as F

from loomgraph.llm import op05_media as media
from loomgraph.llm import op06_decontaminate as leaks
from loomgraph.llm import op07_chat as chat

from .cases import awkward, clashing, frame, prose


def a_png():
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


def a_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.txt", "world" * 100)
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0" + b"\x12\xff\0\x34" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


def a_riff(form, *chunks):
    body = form + b"".join(kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1) for kind, data in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def remainder(data, polynomial, bits):
    """A checksum bit by bit."""
    x = 0
    for byte in data:
        x ^= byte << bits - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x >> bits - 1 & 1 else x << 1) & (1 << bits) - 1
    return x


def a_flac(frames, total):
    """Constant frames of 192 samples, 16 bits, mono."""
    info = struct.pack(">HH", 192, 192) + bytes(6) + (44100 << 44 | 15 << 36 | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC\x80" + len(info).to_bytes(3, "big") + info
    for i in range(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, i])
        frame = head + bytes([remainder(head, 0x07, 8)]) + b"\0" + struct.pack(">H", 1000 + i)
        out += frame + remainder(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def an_ogg(pages):
    return b"".join(b"OggS\0" + bytes([2 * (i == 0) + 4 * (i == pages - 1)]) + bytes(20) + bytes([2, 3, 4]) + b"abcdefg" for i in range(pages))


def test_each_format_is_confirmed_with_its_length():
    whole = {
        "png": a_png(), "gif": GIF, "jpeg": JPEG, "wav": media.wave(b"abcd"), "pdf": PDF, "zip": a_zip(), "gzip": gzip.compress(b"data" * 9, mtime=0), "flac": a_flac(3, 576), "ogg": an_ogg(3),
        "webp": a_riff(b"WEBP", (b"VP8 ", b"abc")), "avi": a_riff(b"AVI ", (b"LIST", b"hdrl"), (b"idx1", b"x" * 9)),
    }
    for kind, data in whole.items():
        assert media.sniffed(data) == [(kind, 0, len(data))], kind
        assert media.sniffed(b"some text before" + data + b" and after") == [(kind, 16, len(data))], kind
        assert media.sniffed(data + b"-" + data) == [(kind, 0, len(data)), (kind, len(data) + 1, len(data))], kind
        for cut in (len(data) // 2, len(data) - 1):
            assert all(k != kind for k, _, _ in media.sniffed(data[:cut])), kind
    assert media.sniffed(b"RIFF of text, PK\x03\x04, GIF89a, %PDF-x, OggS, fLaC, \xff\xd8\xff") == []
    assert media.sniffed(a_flac(2, 0) + b" text") == [("flac", 0, len(a_flac(2, 0)))]
    bad = bytearray(a_flac(3, 576))
    bad[60] ^= 1
    assert media.sniffed(bytes(bad)) == []


def test_updated_pdf_and_many_hits():
    updated = PDF + b"\n2 0 obj\nendobj\nstartxref\n50\n%%EOF"
    assert media.sniffed(b"x" + updated + b" y " + PDF) == [("pdf", 1, len(updated)), ("pdf", 1 + len(updated) + 3, len(PDF))]
    began = time.perf_counter()
    assert len(media.sniffed(b"%PDF-1." * 40_000 + PDF + b"PK\x03\x04" * 40_000)) == 1
    assert time.perf_counter() - began < 3


def test_feature_is_counted_apart(spark):
    rows = [(1, "abc" * 50), (2, ""), (3, None), (4, "RIFF GIF89a;" * 9)]
    for r in media.digest(frame(spark, rows)).collect():
        t = (dict(rows)[r.doc_id] or "").encode()
        p = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        mean = sum(p) / len(p)
        dev = math.sqrt(sum((x - mean) ** 2 for x in p) / len(p))
        kind, corrected, unit, n, m, d, inside = r.feature.split(";")
        assert (kind, corrected, unit, n, inside) == ("wav", "corrected=true", "1x8@8000", f"n={len(p)}", "embedded=")
        assert abs(float(m[5:]) - mean) < 1e-3 and abs(float(d[4:]) - dev) < 1e-3
        form = wave.open(io.BytesIO(media.wave(p)))
        assert (form.getnchannels(), form.getsampwidth(), form.getframerate(), form.readframes(10**6)) == (1, 1, 8000, p)


def test_sniff_corrects_and_carves(spark):
    df = spark.createDataFrame([(1, bytearray(a_png()), "jpeg"), (2, bytearray(b"text " + GIF), "bin"), (3, None, "png"), (4, bytearray(b""), None)], "id int, media binary, declared string")
    rows = {r.id: r for r in media.sniff(df, "media", "declared").collect()}
    assert (rows[1].media_type, rows[1].type_corrected) == ("png", True)
    assert rows[2].media_type is None and [(e.format, e.offset, bytes(e.bytes)) for e in rows[2].embedded] == [("gif", 5, GIF)]
    assert rows[3].media_type is None and rows[4].embedded == []


def test_media_round_trip(spark):
    rows = awkward() + [(60, "y" * 64), (61, "RIFF\0 GIF89a")]
    got = sorted((tuple(r)[:7] for r in media.digest(clashing(frame(spark, rows))).collect()), key=str)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media.wave(p)), hashlib.sha256(media.wave(p)).hexdigest()))
    assert got == sorted(want, key=str)
    assert media.digest(frame(spark, [])).count() == 0


def test_containment_against_sql(spark):
    docs = [(100 + i, t) for i, t in prose(80)] + awkward()
    items = [(i, docs[i][1][10:]) for i in range(0, 40, 3)] + [(99, None), (98, "too short"), (97, "ka lo mi te ru sa none of it")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in leaks.matches(clashing(frame(spark, docs)), bench).collect()), key=str)
    db = duckdb.connect()
    for name, columns, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        db.execute(f"create table {name} ({columns} bigint, text varchar)")
        db.executemany(f"insert into {name} values (?, ?)", rows)
    plain = lambda r: r[0] != 7  # noqa: E731  the SQL counts repeated rows once
    assert sorted(set(filter(plain, got)), key=str) == sorted(filter(plain, db.sql(leaks.ORACLE_SQL).fetchall()), key=str)
    kept = leaks.decontaminated(clashing(frame(spark, docs)), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {r[0] for r in got}


def test_short_items(spark):
    docs = [(1, "The answer: Blue WHALE, of course"), (2, "blue, then whale"), (3, "whale"), (4, None), (5, "a blue whale"), (6, "blue"), (7, "whale blue"), (8, "is it so? yes")]
    items = [(1, "blue whale"), (2, "Whale!"), (3, "it so yes"), (4, "..."), (5, None), (6, "is it so yes"), (7, "the answer blue whale of course"), (8, "whale blue whale blue")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    want = sorted((d, i) for d, t in docs for i, x in items if (n := len(split(x))) and any(split(t)[k : k + n] == split(x) for k in range(len(split(t)))))
    got = leaks.matches(clashing(frame(spark, docs)), bench, short=True).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == want and all(r.containment == 1 for r in got)
    assert {r.doc_id for r in leaks.decontaminated(frame(spark, docs), bench, short=True).collect()} == {i for i, _ in docs} - {d for d, _ in want}


def test_containment_in_blocks(spark, monkeypatch):
    docs, items = prose(60), [(i, t) for i, t in prose(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, leaks.matches(frame(spark, docs), bench).collect()))
    monkeypatch.setattr(leaks, "BLOCK_SHINGLES", 150)
    assert sorted(map(tuple, leaks.matches(frame(spark, docs), bench).collect())) == whole != []
    assert leaks.matches(frame(spark, docs), bench.limit(0)).count() == 0
    assert leaks.decontaminated(frame(spark, []), bench).count() == 0


def test_chat(spark):
    j = json.dumps
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", j({"content": None, "tool_calls": [{"id": "b", "name": "f", "arguments": {"x": {"$ref": "a"}}}, {"id": "a", "function": {"name": "f", "arguments": '{"x": "no"}'}}]})),
        (1, 2, "tool", j({"tool_call_id": "a", "content": "ok"})),
        (1, 3, "tool", j({"tool_call_id": "b", "content": "ok"})),
        (1, 4, "tool", j({"tool_call_id": "zz"})),
        (1, 5, "tool", j({"tool_call_id": "a", "content": "again"})),
        (2, 0, "assistant", j({"tool_calls": [{"id": "p", "name": "g", "depends_on": ["q"]}, {"id": "q", "name": "g", "depends_on": ["p"]}]})),
        (2, 1, "assistant", j({"tool_calls": [{"id": "late", "name": "g"}, {"name": "g"}]})),
        (None, None, None, None),
        (3, 1, "user", "{bad"),
        (3, 1, "user", "{bad"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    tools = spark.createDataFrame([("f", j({"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}))], "name string, schema string")
    out = chat.formatted(df, tools).collect()
    by = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(rows)
    assert (by[1, 1].status, by[1, 1].n_calls, by[1, 1].n_linked, by[1, 1].level) == ("invalid", 2, 1, 1)
    assert by[1, 1].faults == ["$.x: not integer"]
    made = json.loads(by[1, 1].message_json)["tool_calls"]
    assert [(c["id"], c["level"], c["answered"]) for c in made] == [("a", 0, 2), ("b", 1, 3)]
    assert [by[1, t].status for t in (2, 3, 4, 5)] == ["linked", "linked", "orphan", "duplicate"]
    assert by[2, 0].status == "cycle" and by[2, 1].status == "unanswered"
    assert by[3, 1].message_json == '{"content":"{bad","role":"user","turn":1}'
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_derived_against_brute_force(spark):
    rows = [(c, t, role, text) for c, n in ((1, 8), (2, 5), (3, 1)) for t, role, text in [(t, ("user", "assistant")[t % 2], f"text {'of some words ' * (c * t % 5)}{t}") for t in range(n)]]
    rows += [(4, 0, "system", "be brief"), (4, 1, "user", None), (4, 2, "assistant", "yes"), (4, 3, "assistant", "no call"), (None, 0, "user", "who"), (5, None, "user", "when"), (5, None, "assistant", "then"), (6, 0, "user", "{not json")]
    rows += [(7, 0, "user", json.dumps({"tool_calls": [{"id": "own", "name": "own"}]})), (7, 1, "tool", json.dumps({"tool_call_id": "own"})), (8, 40, "user", "far " * 50)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    messages, tools = chat.derived(clashing(df))
    schemas = {r.name: json.loads(r.schema) for r in tools.collect()}
    texts = {(r.conv_id, r.turn, r.role): r.text for r in messages.collect()}
    assert texts[4, 0, "system"] == "be brief" and texts[7, 0, "user"] == rows[-3][3] and texts[5, None, "assistant"] == "then"
    made = {k: json.loads(v)["tool_calls"][0] for k, v in texts.items() if k[2] == "user"}
    lengths = {}
    for c, t, role, text in rows:
        if role == "user" and c != 7:
            lengths.setdefault(made[c, t, role]["name"], []).append(text and len(text))
    for name, own in lengths.items():
        own = [x for x in own if x is not None]
        assert schemas[name]["properties"]["text"].get("maxLength") == (math.ceil(sum(own) / len(own)) if own else None)
    want = []
    for c, t, role, text in rows:
        calls = {y for x, y, r in texts if x == c and r == "user" and y is not None and c is not None}
        results = {y - 1 for x, y, r in texts if x == c and r == "assistant" and y is not None}

        def level(x):
            ref = made[c, x, "user"]["arguments"].get("earlier")
            assert (ref is None) == (x < 2) and (ref is None or int(ref["$ref"]) in range(x % 2, x, 2))
            return 1 + level(int(ref["$ref"])) if ref and int(ref["$ref"]) in calls else 0

        if c == 7:
            want.append((c, t, ("call", "result")[t], "linked", 0, False))
        elif role == "user":
            wrong = text is None or len(text) > schemas[made[c, t, role]["name"]]["properties"]["text"]["maxLength"]
            status = "unnamed" if t is None or c is None else "invalid" if wrong else "linked" if t in results else "unanswered"
            want.append((c, t, "call", status, None if status == "unnamed" else level(t), wrong))
        elif role == "assistant" and t is not None:
            want.append((c, t, "result", "linked" if t - 1 in calls else "orphan", level(t - 1) if t - 1 in calls else None, False))
        else:
            want.append((c, t, "plain", None, None, False))
    got = [(r.conv_id, r.turn, r.kind, r.status, r.level, bool(r.faults)) for r in chat.formatted(messages, tools).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[3] for w in want} >= {"invalid", "linked", "unanswered", "orphan", "unnamed"} and max(w[4] or 0 for w in want) >= 2
    assert chat.formatted(*chat.derived(df.limit(0))).count() == 0


def test_chat_query_makes_calls(spark, sf):
    from loomgraph.llm import queries

    kinds = {r.kind: r for r in queries.op7_chat(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("faults") != "").alias("faulty")).collect()}
    assert kinds["call"].n > kinds["call"].faulty > 0 and kinds["result"].n > 0


def test_schema_faults():
    schema = {"type": "object", "properties": {"n": {"type": "number", "minimum": 1}, "s": {"enum": ["a"]}, "l": {"items": {"type": "string"}, "maxItems": 2}}, "required": ["n"], "additionalProperties": False}
    assert chat.faults({"n": 2, "s": "a", "l": ["x"]}, schema) == []
    assert chat.faults({"n": 0, "s": "b", "l": ["x", 1, "y"], "z": 1}, schema) == ["$.l[1]: not string", "$.l: out of bounds", "$.n: out of bounds", "$.s: not one of the values", "$.z: unknown"]
    assert chat.faults({}, schema) == ["$.n: missing"]


def test_levels_of_chains_joins_and_cycles(spark):
    """Long chains, joins of them, cycles and what hangs on these, against a plain longest path."""
    deps = {f"a{i}": [f"a{i - 1}"] if i else [] for i in range(40)}  # a chain
    deps |= {"j": ["a39", "b"], "b": [], "k": ["j"], "l": ["k", "a5"], "m": ["l"], "lost": ["nowhere"]}
    deps |= {"x": ["y"], "y": ["z"], "z": ["x"], "w": ["x"], "v": ["w", "b"], "s": ["s"], "u": ["v"]}
    known, busy = {}, set()

    def level(c):
        if c in busy:
            return None
        if c not in known:
            busy.add(c)
            below = [level(d) for d in deps[c] if d in deps]
            busy.discard(c)
            known[c] = None if None in below else 1 + max(below, default=-1)
        return known[c]

    want = {c: level(c) for c in deps}
    df = spark.createDataFrame([(conv, c, d) for conv in (1, 2) for c, d in deps.items()], "conv_id bigint, id string, depends array<string>")
    got = {(r.conv_id, r.id): r.level for r in chat._levels(df).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {(conv, c): v for conv in (1, 2) for c, v in want.items() if v is not None}
