"""Token files: each shard of documents is one compressed file that holds its ids as a wavelet matrix.

Documents are dealt out by ranges of doc_id and sorted, so that the shards in order hold all ids in ascending doc_id
order. A shard's file has the documents' ids and offsets, and for each bit of a token id a plane of bits with counts of
ones up to every 512th bit: enough to get a token, count a token in a range and find its k-th occurrence without
decoding the rest. ``read_documents`` decodes whole shards.

Defined results: a null text is an empty document (its end id only). A null doc_id comes before all others; rows with
equal doc_id stand in the order of their texts' hashes. Extra columns are ignored. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gazeframe.llm.common import bounded_batches, shared_dir, written
from gazeframe.llm.files import get, put
from gazeframe.llm.token_ids import encoder, slices

MAGIC = b"WMTF0001"
#: Ids of a shard, about; a longer document has a shard of its own.
SHARD_TOKENS = 2_000_000
BLOCK = 512


class WaveletMatrix:
    """Succinct sequence of ids: planes[k] has bit (levels-1-k) of each id, zeros of the level before moved to the front."""

    def __init__(self, n: int, levels: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.levels, self.planes, self.zeros, self.ranks = n, levels, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for bit in range(levels - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)) != 0
            packed = np.packbits(ones)
            planes.append(packed)
            counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)]))
            low = now[~ones]
            zeros.append(len(low))
            now = np.concatenate([low, now[ones]])
        return cls(len(ids), levels, planes, zeros, ranks)

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n).view(bool)
            above = np.empty_like(now)
            z = self.zeros[k]
            above[~ones] = now[:z]
            above[ones] = now[z:] | now.dtype.type(1 << (self.levels - 1 - k))
            now = above
        return now

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        b, r = divmod(i, BLOCK)
        part = self.planes[k][b * (BLOCK // 8) : (i + 7) // 8]
        n = int(self.ranks[k][b]) + int(np.bitwise_count(part).sum())
        return n - (int(part[-1] & ((1 << (-r % 8)) - 1)).bit_count() if r % 8 else 0)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i // 8] >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.levels):
            bit = self._bit(k, i)
            i = self.zeros[k] + self._ones(k, i) if bit else i - self._ones(k, i)
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        if token < 0 or token >> self.levels:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence, from 0; -1 if there are fewer."""
        if token < 0 or token >> self.levels:
            return -1
        a, b = self._range(token, 0, self.n)
        if not 0 <= nth < b - a:
            return -1
        at = a + nth
        for k in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - k) & 1
            want = at - self.zeros[k] if one else at
            lo, hi = 0, self.n  # the largest place with ``want`` such bits before it
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if (self._ones(k, mid) if one else mid - self._ones(k, mid)) <= want:
                    lo = mid
                else:
                    hi = mid - 1
            at = lo
        return at


def to_bytes(doc_ids: list, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """A shard's file: header, then compressed parts."""
    press = zstandard.ZstdCompressor(level=1)
    null = [i for i, d in enumerate(doc_ids) if d is None]
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    parts = [ids.tobytes(), lengths.astype(np.int64).tobytes(), *[p.tobytes() for p in matrix.planes], *[r.tobytes() for r in matrix.ranks]]
    packed = [press.compress(p) for p in parts]
    head = json.dumps({"n": matrix.n, "levels": matrix.levels, "zeros": matrix.zeros, "docs": len(doc_ids), "null": null, "sizes": [len(p) for p in packed]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed])


def from_bytes(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<I", data, 8)
    head = json.loads(data[12 : 12 + size])
    at, parts = 12 + size, []
    press = zstandard.ZstdDecompressor()
    for n in head["sizes"]:
        parts.append(press.decompress(data[at : at + n]))
        at += n
    doc_ids = np.frombuffer(parts[0], np.int64).tolist()
    for i in head["null"]:
        doc_ids[i] = None
    k = head["levels"]
    planes = [np.frombuffer(p, np.uint8) for p in parts[2 : 2 + k]]
    ranks = [np.frombuffer(p, np.uint32) for p in parts[2 + k :]]
    return doc_ids, np.frombuffer(parts[1], np.int64), WaveletMatrix(head["n"], k, planes, head["zeros"], ranks)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes ``docs`` (doc_id, text) and returns (path, part, place, n_docs, n_tokens, start), one row for each shard.

    start: ids in all shards before this one. The window that sums them up runs over shards, within ``part`` groups
    first, so that no task gets more than one row for each of them.
    """
    folder = shared_dir(docs.sparkSession, "tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        names: list = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        total, place = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, lengths, total, place
            sizes = np.concatenate(lengths)
            data = to_bytes(names, sizes, WaveletMatrix.build(np.concatenate(held)))
            row = {"path": [put(folder, f"{part:06d}-{place:05d}.wm", data)], "part": [part], "place": [place], "n_docs": [len(names)], "n_tokens": [total]}
            names, held, lengths, total, place = [], [], [], 0, place + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            texts = batch.column(1).fill_null("")
            ids = batch.column(0).to_pylist()
            for lo, hi in slices(pc.binary_length(texts).to_pylist(), min(1 << 20, 4 * shard_tokens)):
                flat, n = coder.encode(texts.slice(lo, hi - lo))
                ends = np.cumsum(n)
                held.append(np.insert(flat, ends, end_id))
                lengths.append(n + 1)
                names += ids[lo:hi]
                total += len(held[-1])
                if total >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    shards = written(rows.mapInArrow(work, "path string, part long, place long, n_docs long, n_tokens long"), "token-shards")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = parts.select("part", (F.sum("part_tokens").over(W.Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    inside = F.sum("n_tokens").over(W.Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    return written(shards.withColumn("inside", inside).join(before, "part").withColumn("start", F.col("part_start") + F.col("inside")).drop("inside", "part_start"), "token-starts")


def read_documents(shards: DataFrame, tokens: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and with ``tokens`` the ids) of every document in the shards' files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, lengths, matrix = from_bytes(get(path))
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array(names, pa.int64()), pa.array(first + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if not tokens:
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*cols, lists], schema=schema.append(pa.field("ids", pa.list_(pa.int64()))))

    n = max(1, shards.sparkSession.sparkContext.defaultParallelism * 4)
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * tokens
    return shards.select("path", "start").repartition(n).mapInArrow(work, kind)
