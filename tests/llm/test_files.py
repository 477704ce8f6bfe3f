"""Archives, token files and packing: exact round trips."""

import base64
import hashlib
import string
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gazeframe.llm import packing, queries, token_files, token_ids, warc
from gazeframe.llm.files import get
from gazeframe.llm.queries import tokenizer
from gazeframe.llm.token_ids import Encoder

WORD, BYTE = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 7}</p>" * (1 + i % 3)) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u\nv", "x" * 3_000_000), (None, "n", "<p>page 1</p>"), (5, "http://h/5", "<p>page 5</p>" * 3)]
    pages = spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id long, url string, html string, digest int, refers_to string")
    manifest = warc.archive(pages, archive_bytes=2000)
    back = warc.read_archives(manifest).collect()
    assert len(back) == len(rows) == sum(r["n_records"] for r in manifest.collect())
    last: dict = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    html = {i: h or "" for i, _, h in rows}
    for r in back:
        payload = html[r["page_id"]]
        first = r["page_id"] if r["page_id"] is None else last[payload]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))
        assert r["payload"] == (payload.encode() if r["record_type"] == "response" else None)
    assert {r["record_type"] for r in warc.read_archives(warc.archive(pages, least=10**9), False).collect()} == {"response"}
    assert warc.read_archives(warc.archive(pages.limit(0))).count() == 0
    data = get(manifest.first()["path"])
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and 8 + size < len(data)


def test_dictionary_helps():
    records = [warc.record(i, f"http://h/{i}", f"<html><body><div class='article main'>item {i}</div></body></html>".encode(), None) for i in range(400)]
    data = warc.pack(records)
    assert [r for _, r in warc.unpack(data)] == records
    import zstandard

    assert len(data) < sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    at = [a for a, _ in warc.unpack(data)]
    size = struct.unpack_from("<I", data, 4)[0]
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[at[7] :])
    assert alone == records[7]


TEXTS = ["", None, "Hello, world's  end.\n\n  New line", "naïve Éa ça-va? ½ × ÷ x×y", "tab\there\u00a0nbsp \u3000wide", "a" * 5000, "ΣΑΣ οδός", "e\u0301 combined é", "<|endoftext|> <|startoftext|>", "don't we'll I'M 'tis 's", "emoji 🙂🙂 done", "x1y2 3,4.5", " lead", "trail ", "\n", "the " * 2000, "İstanbul ǅ ŉ", "…“quotes” — dash§©"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_library(path):
    rng = np.random.default_rng(0)
    alphabet = list("abcXYZéÈñßçø .,'!?-\n\t 0123\u00a0\u0301Σ½×") + ["the ", " of", "’"]
    texts = TEXTS + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(1500)]
    coder = Encoder(path, most_chunks=500)
    for k in range(0, len(texts), 400):
        part = texts[k : k + 400]
        ids, n = coder.encode(pa.array(part, pa.string()))
        want = [e.ids for e in coder.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]
        ends = np.cumsum(n)
        for t, w, e, m in zip(part, want, ends, n, strict=True):
            assert ids[e - m : e].tolist() == w, repr(t)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_on_all_of_unicode(path):
    """100,000 strings of any characters with ASCII punctuation, among them letters that become two in lower case."""
    rng = np.random.default_rng(1)
    every = np.array([chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000])
    hostile = np.array(list("a\u0130\u0131\u01c5\u03a3\u0338\u0301\u200d\u00bd\u00b2'!?.,:;_-/<>|=&\n\t\u00a0\u3000 09KD") + ["'s", "<|endoftext|>", "  ", "\n\n", "BİRİNCİ:"])
    coder = Encoder(path)
    for round_ in range(100):
        pool = [hostile, every, every[:0x300], every[:0x3000]][round_ % 4]
        texts = ["".join(np.where(rng.random(m) < 0.5, rng.choice(pool, m), rng.choice(hostile, m))) for m in rng.integers(1, 12, 1000).tolist()]
        ids, n = coder.encode(pa.array(texts))
        ends = np.cumsum(n).tolist()
        for t, want, e, m in zip(texts, coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False), ends, n.tolist(), strict=True):
            assert ids[e - m : e].tolist() == want.ids, repr(t)


def test_encoder_on_letters_with_marks_and_added_tokens():
    """Every ASCII letter in both cases with every combining mark, as the library's plain call has them."""
    marks = [chr(c) for c in range(0x300, 0x20D1) if unicodedata.combining(chr(c))]
    texts = ["T\u0308raum J\u030cama", "H\u0331 W\u030a Y\u030a I\u0307\u0338", "a<|endoftext|>b", "<|startoftext|> <|endoftext|>", "<|endoftext", "x " + "<|endoftext|> y" * 3]
    texts += [f"{c}{m} x{c}{m}{n}z {m}{c}" for c in string.ascii_letters for m, n in zip(marks, [*marks[1:], "\u0338"], strict=True)]
    for path in (WORD, BYTE):
        library = Tokenizer.from_file(path)
        coder = Encoder(path)
        for k in range(0, len(texts), 5000):
            part = texts[k : k + 5000]
            ids, n = coder.encode(pa.array(part))
            for t, want, e, m in zip(part, library.encode_batch(part, add_special_tokens=False), np.cumsum(n).tolist(), n.tolist(), strict=True):
                assert ids[e - m : e].tolist() == want.ids, repr(t)


def test_op7_against_the_library(spark, tmp_path):
    rows, docs = rows_of(spark)
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    library, start = Tokenizer.from_file(WORD), 0
    got = {r["doc_id"]: r for r in queries.op7_token_files(spark, str(tmp_path)).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_encoder_tells_clashing_words_apart(monkeypatch):
    """Also where the hash says that all chunks are the same."""
    monkeypatch.setattr(token_ids, "span_hashes", lambda data, start, end, table: np.zeros(len(start), np.uint64))
    texts = ["one two", "three", "", "four " * 30, "x" * 200, "y" * 200, "one"]
    for path in (WORD, BYTE):
        coder = Encoder(path)
        ids, n = coder.encode(pa.array(texts))
        assert np.split(ids, np.cumsum(n)[:-1])[5].tolist() == coder.tokenizer.encode(texts[5], add_special_tokens=False).ids
        assert ids.tolist() == [i for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def rows_of(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, TEXTS[3]), (200, "long " * 9000)] + [(300 + i, "w " * (i * 13 % 900)) for i in range(80)]
    return rows, spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, part int, ids binary").repartition(3)


def encoded(path, rows, end):
    tk = Encoder(path).tokenizer
    return [np.array([*tk.encode(t or "", add_special_tokens=False).ids, end], "<u4") for _, t in rows]


def test_token_files(spark):
    rows, docs = rows_of(spark)
    shards = token_files.write_shards(docs, WORD, 2, shard_tokens=500)
    assert shards.count() > 5
    got = token_files.read_documents(shards, tokens=True).orderBy("start").collect()
    ids = encoded(WORD, rows, 2)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert sum(r["n_tokens"] for r in got) == sum(map(len, ids)) and [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]).tolist()
    assert sorted((r["doc_id"] or -1, zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got) == sorted((i or -1, zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    assert token_files.read_documents(token_files.write_shards(docs.limit(0), WORD, 2)).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (700, 3), (5000, 60_000), (3000, 200_000), (0, 1)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        _, _, m = token_files.from_bytes(token_files.to_bytes([None, 5], np.array([n, 0]), token_files.WaveletMatrix.build(ids)))
        assert m.decode().tolist() == ids.tolist()
        for i in rng.integers(0, n, 20) if n else []:
            t = int(ids[i])
            where = np.flatnonzero(ids == t)
            assert m.access(int(i)) == t and m.count(t) == len(where) and m.count(t, 0, int(i)) == np.sum(ids[:i] == t)
            k = int(rng.integers(len(where)))
            assert m.select(t, k) == where[k] and m.select(t, len(where)) == -1
        assert m.count(1 << 20) == 0


def test_packing(spark):
    rows, docs = rows_of(spark)
    got = packing.pack(docs, BYTE, 0, 64).collect()
    ids = encoded(BYTE, rows, 0)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    whole: dict = {}
    for r in sorted(got, key=lambda r: r["start"]):
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    want: dict = {}
    for (i, _), x in zip(rows, ids, strict=True):
        want.setdefault((i, len(x)), []).append(x.tobytes())
    for key, texts in want.items():
        assert sum(len(b) for _, b in whole[key]) == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(b for _, b in whole[key]) == texts[0]
    assert sum(64 - sum(n for _, n in p) for p in sequences.values()) < 0.05 * 64 * len(sequences)
    assert packing.pack(docs.limit(0), BYTE).count() == 0


def test_least_squares():
    rng = np.random.default_rng(2)
    h = np.zeros(256, np.int64)
    for n in rng.integers(1, 256, 20_000):
        h[n] += 1
    combos = packing.combinations(h)
    x = packing.solve(h, combos)
    counts = packing.rounded(h, combos, x)
    used = np.zeros(256, np.int64)
    for c, k in zip(combos, counts, strict=True):
        assert sum(c) == 256
        for n in c:
            used[n] += k
    assert (x >= 0).all() and (used <= h).all() and used.sum() > 0.8 * h.sum()
    at: dict = {}
    for n, parts in packing.plan(h).items():
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts[:-1]]]).tolist()
        for _, times, first, place in parts:
            for s in range(first, first + times):
                at.setdefault(s, []).append((place, n))
    assert all(sum(n for _, n in p) == 256 and sorted(p)[0][0] == 0 for p in at.values())
