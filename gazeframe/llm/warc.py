"""WARC archives, compressed record by record with a Zstandard dictionary that the archive carries in its first frame.

``archive()`` deals pages out to tasks by page; each task writes archives of a bounded size. An archive is a skippable
frame with the dictionary (trained on records spread over that archive), then one frame for each record, so that a
record can be read by its offset. ``read_archives()`` reads them back, record by record. A payload of any length is one
record; a task holds one archive, which is ARCHIVE_BYTES and one record at most.

Records with equal payloads of at least ``least`` bytes: that of the largest page_id is a response, the others are
revisits that name it and hold the response's HTTP header, without the payload. Which record that is comes from maxima
by digest, aggregated before the shuffle; a digest that a third of the pages share meets no single task.

Defined results: a null html is an empty payload. A null page_id is archived as a response of its own and stays null.
Repeated rows are archived as often as they occur; equal payloads on the same page_id are responses all. Extra columns
are ignored. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.common import bounded_batches, join_hot, shared_dir, written
from gazeframe.llm.files import get, put

#: Fixed values of the format: the magic number of the skippable frame that holds a dictionary, and that of a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
#: Bytes of records that a dictionary is trained on, taken evenly from the whole archive.
TRAIN_BYTES = 1 << 20
LEVEL = 3
#: Bytes of an archive that are decompressed at once.
READ_BYTES = 8 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The fields of a record, those of its HTTP header, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def train(records: list[bytes]) -> bytes:
    """A dictionary from records spread over the list; empty if there is too little to learn from."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAIN_BYTES))
    samples = [r[: TRAIN_BYTES // 8] for r in records[::step]]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # the samples share too little
        return b""


def pack(records: list[bytes]) -> bytes:
    """The archive: the dictionary's frame, then a frame for each record."""
    trained = train(records)
    made = zstandard.ZstdCompressionDict(trained) if trained else None
    if made:
        made.precompute_compress(level=LEVEL)
    press = zstandard.ZstdCompressor(dict_data=made, write_content_size=True, **({} if made else {"level": LEVEL}))
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(trained)), trained, *map(press.compress, records)])


def unpack(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive."""
    magic, length = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start of the archive")
    at = 8 + length
    trained = zstandard.ZstdCompressionDict(data[8:at]) if length else None
    press = zstandard.ZstdDecompressor(dict_data=trained)
    view = memoryview(data)
    while at < len(data):
        one, parts, end = press.decompressobj(), [], at
        while not one.eof:  # a frame's end isn't known before it is read; what is read beyond it is copied
            if end >= len(data):
                raise ValueError(f"the archive ends within the record at {at}")
            parts.append(one.decompress(view[end : end + READ_BYTES]))
            end = min(len(data), end + READ_BYTES)
        yield at, b"".join(parts)
        at = end - len(one.unused_data)


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that are revisits."""
    light = written(
        pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
        .where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least))
        .select("page_id", F.unhex(F.sha1("html")).alias("digest")),
        "warc-digests",
    )
    first = written(light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-responses")
    return join_hot(light, first, "digest", "n").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def archive(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns (path, n_records, n_bytes) of the archives, read from the shared folder."""
    folder = shared_dir(pages.sparkSession, "warc")
    rows = bounded_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    named = (
        rows.where("page_id is not null")
        .withColumn("digest", F.when(F.octet_length("html") >= least, F.unhex(F.sha1("html"))))
        .join(roles(pages, least), ["page_id", "digest"], "left")
        .select("page_id", "url", "html", "refers_to")
    )
    rows = named.unionByName(rows.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = pack(held)
            return pa.RecordBatch.from_pydict({"path": [put(folder, "part.warc.zst", data)], "n_records": [len(held)], "n_bytes": [len(data)]})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c for c in batch.columns), strict=True):
                held.append(record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return written(rows.mapInArrow(work, "path string, n_records long, n_bytes long"), "warc-manifest")


READ = "path string, offset long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives named in column ``path``; a revisit's size and digest are those of the full payload."""

    def number(urn: str | None) -> int | None:
        digits = urn[len("<urn:page:") : -1] if urn else ""
        return int(digits) if digits else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for at, data in unpack(get(path)):
                    fields, http, payload = parse(data)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(http["Content-Length"])
                    if kind == "response" and (len(payload) != n or payload_digest(payload) != digest):
                        raise ValueError(f"a damaged record in {path} at {at}")
                    rows.append((path, at, number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, digest, n, number(fields.get("WARC-Refers-To")), payload if payloads and kind == "response" else None))
                    size += len(payload)
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return manifest.select("path").repartition(n).mapInArrow(work, READ)
