"""N-gram Jaccard join: links documents whose sets of word n-grams have a Jaccard index of at least 4/5 (or another share).

The overlap of two documents is an entry of the product of the documents-by-n-grams incidence matrix with its transpose.
That product is formed in blocks, and only where it can hold a link:

1. Each document's set gets a 64-bit fingerprint; documents of equal sets are one class. N-grams are ordered by how full
   their bucket of a fixed number of buckets is over all documents, so that frequent ones come last.
2. Two linked sets of sizes a and b share enough that, of the first ``p + k - 1`` n-grams of either in that order, with
   ``p = n - ceil(share * n) + 1``, at least k are common (a bound that follows from the sets' sizes). With k about p / 2, a
   class stays only if enough of these n-grams occur in the same part of another class; most classes go here. These
   n-grams are most of what is moved, so they travel in packets: one for each block of documents and part of the n-grams,
   sorted, as differences, with the document's place in the block, three to four bytes an n-gram. A part is sorted in
   memory, and each packet is answered by counts for its block. N-grams are told apart by 28 bits and their part there;
   what clashes or is a copy seems common, so that a class too many stays, and none too few.
3. For the classes that stay, n-grams are ordered anew by their frequency among them; classes that share one of their
   first p n-grams, directly or over others, are a candidate cluster.
4. A cluster's classes are dealt into blocks of bounded size, by set size and then by hash. A pair of blocks whose
   sizes allow a link is one small job: sparse columns are accumulated tile by tile into overlap counts; pairs that
   can no longer reach their size-derived bound are discarded. A job returns a spanning forest of its links, not the pairs.
5. A cluster of one block is one job. In a larger one, first all blocks meet one block of each size; classes that are
   connected by then need not meet, so that after this only blocks of different components do. A large group of near
   copies costs about as many set transfers as it has members.
6. Connected components over links and copies give the result.

N-grams count by 64-bit hashes. Defined results: a null or empty text, or one without words, has 0 n-grams and links
with nothing; one with fewer words than n has one n-gram. A null doc_id has a null component. Rows of equal doc_id are
one node, each with its own n_shingles. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.common import bounded_batches, components, forest, join_hot, written
from gazeframe.llm.grams import gram_sets, mixed
from gazeframe.llm.token_ids import slices

BUCKET_BITS = 21
BUCKETS = 1 << BUCKET_BITS
#: Buckets of one row of counts, when tasks' counts are added up.
CHUNK = 1 << 15
#: Bits of the map that tells a task which documents stand for a class: so many a class, and at most so many in all. False
#: hits are classes that are looked at in vain or twice.
MAP_BITS_EACH = 32
MAP_BITS = 1 << 27
#: N-grams of a part, about, that a task sorts at once; of a block of documents, whose packets a task makes at once.
PART_GRAMS = 1 << 22
HELD_GRAMS = 1 << 21
#: Documents of such a block; bits that tell n-grams of a part apart.
HELD_DOCS = 1 << 16
CELL_BITS = 28
#: Sets of a block, and n-grams in all of them unless it is one set.
BLOCK = 256
BLOCK_GRAMS = 1 << 20
TILE = 4096
#: Rows of a table of three numbers that are broadcast at most (24 MB); sets that meet more are shuffled once more.
FEW = 1_000_000
SEGMENT_BYTES = 1 << 20


def required(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set it links to."""
    return -(-n * percent // 100)


def links(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = batch.column(1).cast(pa.large_string())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]).tolist() if len(texts) else []
    for lo, hi in slices(sizes, SEGMENT_BYTES):
        yield batch.slice(lo, hi - lo)


def _prints(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each set: a sum over its members, mixed with its size."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _count_rows(full: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(first bucket, compressed counts) of the chunks that aren't empty."""
    press = zstandard.ZstdCompressor(level=1)
    for k in range(0, BUCKETS, CHUNK):
        if full[k : k + CHUNK].any():
            yield k, press.compress(full[k : k + CHUNK].tobytes())


def _bucket_of(sets: np.ndarray) -> np.ndarray:
    return (sets & np.uint64(BUCKETS - 1)).astype(np.int64)


def _added(chunks: DataFrame) -> np.ndarray:
    """Counts of all buckets from tasks' rows (chunk, counts): added up chunk by chunk, one row for each to the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(k, np.zeros(CHUNK, np.int64))
                sums[k] += np.frombuffer(press.decompress(counts), np.uint32)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    full = np.zeros(BUCKETS, np.int64)
    for r in chunks.repartition("chunk").mapInArrow(added, "chunk long, counts binary").toLocalIterator():
        full[r["chunk"] : r["chunk"] + CHUNK] = np.frombuffer(r["counts"], np.int64)
    return full


def _ranks(full: np.ndarray) -> np.ndarray:
    rank = np.empty(BUCKETS, np.uint32)
    rank[np.argsort(full, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
    return rank


def _keys(sets: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A bijection of n-grams that sorts by the rank of their bucket."""
    return rank[_bucket_of(sets)].astype(np.uint64) << np.uint64(64 - BUCKET_BITS) | sets >> np.uint64(BUCKET_BITS)


def _smallest(keys: np.ndarray, m: int) -> np.ndarray:
    return keys if m >= len(keys) else np.partition(keys, m - 1)[:m]


def fingerprints(docs: DataFrame, n: int = 5) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, print) of every row, in the shared folder; and the n-grams in each bucket over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "print", "chunk", "counts"]
        full = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for part in _pieces(batch):
                sets, sizes = gram_sets(part.column(1), n)
                np.add.at(full, _bucket_of(sets), np.uint32(1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes), pa.array(_prints(sets, sizes)), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())], names)
        for k, counts in _count_rows(full):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), pa.nulls(1, pa.int64()), pa.array([k]), pa.array([counts], pa.binary())], names)

    kind = "doc_id long, n_shingles long, print long, chunk long, counts binary"
    both = written(docs.select("doc_id", "text").mapInArrow(work, kind), "jaccard-prints")
    return both.where("n_shingles >= 0").select("doc_id", "n_shingles", "print"), _added(both.where("n_shingles < 0").select("chunk", "counts"))


def prefix(n: int, percent: int) -> tuple[int, int]:
    """(p, k): of two linked sets, the first p n-grams of either have one in common, the first p + k - 1 the smaller one's k.

    Both grow with n, so a set of n has in common with any set that it links to k of the smallest size that allows a link.
    """
    p = n - required(n, percent) + 1
    return p, max(1, min((p + 1) // 2, n - p + 1))


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The numbers' lowest bytes, then their second bytes and so on: what they have in common compresses."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).ravel()


def _packet(cells: np.ndarray, who: np.ndarray) -> bytes:
    """Cells in ascending order (uint32) and the places of the documents that they are of (uint16)."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([_planes(np.diff(cells, prepend=np.uint32(0))), _planes(who)]).tobytes())


def _unpacked(packet: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packet), np.uint8)
    n = len(planes) // 6
    steps, who = (np.ascontiguousarray(x.reshape(-1, n).T) for x in (planes[: 4 * n], planes[4 * n :]))
    return np.cumsum(steps.view(np.uint32).ravel(), dtype=np.uint32), who.view(np.uint16).ravel()


def _packets(keys: np.ndarray, who: np.ndarray, prints: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, block, body) of a block of documents: their prints, with the number of packets below zero, and a packet for each part."""
    h = mixed(keys)
    part, cell = (h % np.uint64(parts)).astype(np.int32), (h >> np.uint64(64 - CELL_BITS)).astype(np.uint32)
    order = np.argsort(part.astype(np.int64) << CELL_BITS | cell)
    part, cell, who = part[order], cell[order], who[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*cuts[1:].tolist(), len(part)]
    body = prints.tobytes()
    block = xxhash.xxh3_64_intdigest(body) - (1 << 63)  # of its contents, so that a task which runs again makes the same blocks
    bodies = [body, *(_packet(cell[i:j], who[i:j]) for i, j in zip(cuts.tolist(), ends, strict=True))]
    numbers = np.concatenate([[-len(cuts)], part[cuts]]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([block] * len(bodies), pa.int64()), pa.array(bodies, pa.binary())], ["part", "block", "body"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packets sorted by part: how many common n-grams each document of the block has in the part. Rows of prints pass."""

    def answered(part: int, blocks: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        packets = [_unpacked(x) for x in bodies]
        cells = np.sort(np.concatenate([c for c, _ in packets]))
        common = np.unique(cells[1:][cells[1:] == cells[:-1]])
        counts = []
        for cell, who in packets:
            hit = common[np.minimum(np.searchsorted(common, cell), len(common) - 1)] == cell if len(common) else np.zeros(len(cell), bool)
            counts.append(press.compress(np.bincount(who[hit]).astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.array(counts, pa.binary())], ["part", "block", "body"])

    press = zstandard.ZstdCompressor(level=1)
    now, blocks, bodies = -1, [], []
    for batch in batches:
        for part, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part < 0:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block]), pa.array([body], pa.binary())], ["part", "block", "body"])
                continue
            if part != now and blocks:
                yield answered(now, blocks, bodies)
                blocks, bodies = [], []
            now = part
            blocks.append(block)
            bodies.append(body)
    if blocks:
        yield answered(now, blocks, bodies)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a block's prints and answers, sorted by block and part: (print, n)."""

    def summed(block: int, bodies: list[bytes], parts: list[int]) -> pa.RecordBatch:
        copies = sum(p < 0 for p in parts)  # blocks of equal prints are one
        if not copies or any(p != parts[0] for p in parts[:copies]) or len(parts) != copies * (1 - parts[0]):
            raise RuntimeError(f"block {block} of n-grams is not whole; its documents came in another order when a task ran again")
        prints = np.frombuffer(bodies[0], np.int64)
        n = np.zeros(len(prints), np.int64)
        for body in bodies[copies:]:
            counts = np.frombuffer(press.decompress(body), np.uint32) if body else ()
            n[: len(counts)] += counts
        return pa.RecordBatch.from_arrays([pa.array(prints[n > 0]), pa.array(n[n > 0])], ["print", "n"])

    press = zstandard.ZstdDecompressor()
    now, bodies, parts = None, [], []
    for batch in batches:
        for part, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now and bodies:
                yield summed(now, bodies, parts)
                bodies, parts = [], []
            now = block
            bodies.append(body)
            parts.append(part)
    if bodies:
        yield summed(now, bodies, parts)


def _first_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (gram, print) sorted by both: an edge from each print to the first one with the same n-gram."""
    last, first = None, 0
    for batch in batches:
        gram, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(gram):
            continue
        new = np.empty(len(gram), bool)
        new[0] = gram[0] != last
        new[1:] = gram[1:] != gram[:-1]
        start = np.flatnonzero(new)
        lead = own[start] if new[0] else np.concatenate([[first], own[start]])
        lo = lead[np.cumsum(new) - int(new[0])]
        last, first = gram[-1], lo[-1]
        edge = np.flatnonzero(own != lo)
        pairs = np.unique(np.stack([own[edge], lo[edge]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def _by_gram(postings: DataFrame) -> DataFrame:
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(parts, "gram").sortWithinPartitions("gram", "print")


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Three places in a map of so many bits for each hash."""
    return (np.stack([hashes, hashes >> np.uint64(18), hashes >> np.uint64(37)]) & np.uint64(bits - 1)).astype(np.int64)


def _id_hashes(ids: np.ndarray) -> np.ndarray:
    return mixed(ids.view(np.uint64) ^ np.uint64(0xA24BAED4963EE407))


class Stands:
    """Which documents stand for one of the classes (print, first): a map of bits, with false hits but no misses."""

    def __init__(self, classes: DataFrame):
        bits = self.bits = min(MAP_BITS, 1 << max(16, (MAP_BITS_EACH * classes.count() - 1).bit_length()))

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = _id_hashes(batch.column(0).to_numpy())
                places = np.unique(_places(np.concatenate([ids, mixed(ids ^ batch.column(1).to_numpy().view(np.uint64))]), bits))
                if len(places):
                    words, start = np.unique(places >> 6, return_index=True)
                    m = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), start)
                    yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(m.view(np.int64))], ["word", "m"])

        table = np.zeros(bits // 64, np.int64)
        marked = classes.select("first", "print").mapInArrow(marks, "word int, m long")
        got = marked.groupBy("word").agg(F.bit_or("m").alias("m")).toArrow()  # at most MAP_BITS / 64 rows
        table[got.column("word").to_numpy()] = got.column("m").to_numpy()
        self.table = classes.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def _hit(self, hashes: np.ndarray) -> np.ndarray:
        places = _places(hashes, self.bits)
        return (self.table.value[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).all(0)

    def sets(self, batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
        """(sets, ends, rows, prints) of pieces of a batch (doc_id, text): rows of those documents that stand for a class."""
        ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        for part in _pieces(batch.filter(pa.array(self._hit(_id_hashes(ids))))):
            sets, sizes = gram_sets(part.column(1), n)
            prints = _prints(sets, sizes)
            own = _id_hashes(part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False))
            rows = np.flatnonzero(self._hit(mixed(own ^ prints.view(np.uint64))) & (sizes > 0))
            yield sets, np.cumsum(sizes), rows.tolist(), prints[rows].tolist()


def likely(docs: DataFrame, classes: DataFrame, full: np.ndarray, n: int, percent: int) -> DataFrame:
    """The rows of ``classes`` (print, first, size) that may have a link: enough of their first n-grams are common."""
    spark = docs.sparkSession
    order, stands = spark.sparkContext.broadcast(_ranks(full)), Stands(classes)
    total = classes.agg(F.sum("size")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # of a set of n the first p + k - 1, about (100 - percent) * 3 / 2 % of it
    parts = max(tasks, min(1 << 20, int(total * (100 - percent) * 3 / 200) // PART_GRAMS + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # the first n-grams of a block's prints; copies need no second posting
        grams = 0

        def block() -> pa.RecordBatch:
            who = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held.values()])
            return _packets(np.concatenate(list(held.values())), who, np.array(list(held), np.int64), parts)

        for batch in batches:
            for sets, ends, rows, prints in stands.sets(batch, n):
                for row, own in zip(rows, prints, strict=True):
                    if own not in held:
                        start, end = int(ends[row - 1]) if row else 0, int(ends[row])
                        p, k = prefix(end - start, percent)
                        held[own] = _smallest(_keys(sets[start:end], order.value), p + k - 1)
                        grams += len(held[own])
                        if grams >= HELD_GRAMS or len(held) >= HELD_DOCS:
                            yield block()
                            held.clear()
                            grams = 0
        if held:
            yield block()

    kind = "part int, block long, body binary"
    packets = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(work, kind)
    dealt = packets.repartition(parts, "part", F.when(F.col("part") < 0, F.col("block"))).sortWithinPartitions("part").mapInArrow(_answers, kind)
    counted = dealt.repartition(tasks, "block").sortWithinPartitions("block", "part").mapInArrow(_counted, "print long, n long")
    common = counted.groupBy("print").agg(F.max("n").alias("common"))
    least = F.ceil(F.col("size") * percent / F.lit(100.0))  # of a set that it can link to
    p = least - F.ceil(least * percent / F.lit(100.0)) + 1
    k = F.greatest(F.lit(1), F.least(F.floor((p + 1) / 2), least - p + 1))
    return classes.join(common, "print").where(F.col("common") >= k).select("print", "first", "size")


def candidate_clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(print, cluster) of the classes that share one of their first n-grams with another class; sets: (print, grams)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for grams in batch.column(0).to_pylist():
                np.add.at(full, _bucket_of(np.frombuffer(grams, np.uint64)), np.uint32(1))
        for k, counts in _count_rows(full):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([counts], pa.binary())], ["chunk", "counts"])

    order = sets.sparkSession.sparkContext.broadcast(_ranks(_added(sets.select("grams").mapInArrow(count, "chunk long, counts binary"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = _keys(np.frombuffer(grams, np.uint64), order.value)
                keys = _smallest(keys, prefix(len(keys), percent)[0]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), own))], ["gram", "print"])

    edges = _by_gram(sets.select("print", "grams").mapInArrow(work, "gram long, print long")).mapInArrow(_first_edges, "u long, v long")
    return components(edges, "jaccard-candidates").select(F.col("node").alias("print"), F.col("root").alias("cluster"))


def class_sets(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(print, grams) of the documents that stand for ``classes`` (print, first), and a few others; grams as bytes."""
    stands = Stands(classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets, ends, rows, prints in stands.sets(batch, n):
                grams = [sets[int(ends[row - 1]) if row else 0 : int(ends[row])].tobytes() for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(grams, pa.binary())], ["print", "grams"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(work, "print long, grams binary")


def block_overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix left x right: which sets link. Overlaps are accumulated over tiles of shared n-grams."""
    flat = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), size)
    gram, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    many = times > 1
    number = np.cumsum(many) - 1
    keep = many[column]
    row, column, width = who[keep], number[column[keep]], int(many.sum())
    a, b = size[left][:, None], size[right][None, :]
    alive = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (left[:, None] != right[None, :])
    bound = -(-percent * (a + b) // (100 + percent))  # least overlap of two such sets that link
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    rest = np.bincount(row, minlength=len(sets))
    overlap = np.zeros(alive.shape, np.float32)
    for lo in range(0, width, TILE):
        alive &= overlap + np.minimum(rest[left][:, None], rest[right][None, :]) >= bound
        if not alive.any():
            break
        i, j = np.searchsorted(column, [lo, lo + TILE])
        tile = np.zeros((len(sets), min(TILE, width - lo)), np.float32)
        tile[row[i:j], column[i:j] - lo] = 1
        overlap += tile[left] @ tile[right].T
        rest = rest - np.bincount(row[i:j], minlength=len(sets))
    return alive & links(overlap.astype(np.int64), a, b, percent)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(cluster, comp, bin, blocks) of rows with these columns and size."""
    n = F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_GRAMS)
    return written(rows.groupBy("cluster", "comp", "bin").agg(F.ceil(n).cast("int").alias("blocks")), "jaccard-blocks")


def _block_links(sets: DataFrame, rows: DataFrame, percent: int, block: int, pivots: bool) -> DataFrame:
    """(u, v): a spanning forest of the links of each pair of blocks of near bins and different components (or component 0).

    sets: (print, grams); rows: (print, size, cluster, comp, bin). ``pivots``: only pairs in which one is a bin's block 0.
    """
    groups = _blocks(rows, block)
    near = groups.select(
        "cluster", F.col("comp").alias("other_comp"), F.col("bin").alias("other_bin"), F.col("blocks").alias("others"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")
    )
    meets = written(groups.join(near, ["cluster", "bin"]).where("comp = 0 or comp <> other_comp"), "jaccard-meets")
    places = rows.select("print", "cluster", "comp", "bin").join(meets, ["cluster", "comp", "bin"])
    places = places.withColumn("own", F.pmod(F.xxhash64("print"), "blocks").cast("int"))
    every = F.sequence(F.lit(0), F.col("others") - 1)
    places = places.withColumn("k", F.explode(F.when(F.col("own") == 0, every).otherwise(F.array(F.lit(0))) if pivots else every))
    mine, other = F.struct("comp", "bin", F.col("own").alias("k")), F.struct(F.col("other_comp").alias("comp"), F.col("other_bin").alias("bin"), "k")
    before, same = other < mine, other == mine
    job = F.xxhash64("cluster", F.when(before, other).otherwise(mine), F.when(before, mine).otherwise(other))
    side = F.when(same, F.lit(2)).when(before, F.lit(1)).otherwise(F.lit(0))
    places = written(places.select("print", job.alias("job"), side.alias("side")), "jaccard-places")
    placed = sets.join(F.broadcast(places) if places.count() <= FEW else places.hint("shuffle_merge"), "print")  # so that the sets need no shuffle to meet them
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    jobs = placed.select("job", "side", "print", "grams").repartition(parts, "job").sortWithinPartitions("job", "print")

    def run(names: list[int], sides: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        side, at = np.array(sides), np.arange(len(sides))  # a repeated row is there twice, which adds no edge
        left = at if side[0] == 2 else at[side == 0]
        right = at if side[0] == 2 else at[side == 1]
        if len(names) < 2 or not len(left) or not len(right):
            return []
        linked = block_overlaps([np.frombuffer(s, np.uint64) for s in sets], left, right, percent)
        i, j = np.nonzero(linked)
        return forest(np.array(names), left[i], right[j])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        out: list[tuple[int, int]] = []
        for batch in batches:
            for job, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if job != now:
                    if len(held[0]) > 1:
                        out += run(held[1], held[0], held[2])
                    now, held = job, ([], [], [])
                for h, v in zip(held, row, strict=True):
                    h.append(v)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pydict({"u": [a for a, _ in out], "v": [b for _, b in out]})
                out = []
        if len(held[0]) > 1:
            out += run(held[1], held[0], held[2])
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["u", "v"])

    return jobs.mapInArrow(work, "u long, v long")


def class_links(sets: DataFrame, classes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect all classes that links connect. sets: (print, grams); classes: (print, size, cluster)."""
    members = written(classes.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("grams")), "jaccard-members")
    size_bin = F.floor(F.log("size") / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int") + 1
    one = (F.col("members") <= block) & (F.col("grams") <= BLOCK_GRAMS)
    binned = classes.join(members, "cluster").select("print", "size", "cluster", F.lit(0).cast("long").alias("comp"), F.when(one, F.lit(-1)).otherwise(size_bin).alias("bin"))
    binned = written(binned, "jaccard-bins")
    first = written(_block_links(sets, binned, percent, block, True), "jaccard-pivots")
    large = binned.where("bin > 0").drop("comp")
    if not large.take(1):
        return first
    label = components(first, "jaccard-parts")
    parts = written(large.join(label.withColumnRenamed("node", "print"), "print", "left"), "jaccard-large")
    wide = parts.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("root").isNotNull() & (F.col("n") >= block)).select("cluster", "root", F.col("root").alias("comp"))
    rest = parts.join(wide, ["cluster", "root"], "left").select("print", "size", "cluster", F.coalesce("comp", F.lit(0)).alias("comp"), "bin")
    return first.unionByName(_block_links(sets, written(rest, "jaccard-rest"), percent, block, False))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    prints, full = fingerprints(bounded_batches(docs), n)
    known = prints.where("doc_id is not null and n_shingles > 0")
    first = written(known.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("rows")), "jaccard-classes")
    classes = written(likely(docs, first.select("print", "first", "size"), full, n, percent), "jaccard-likely")
    sets = written(class_sets(docs, classes, n), "jaccard-sets")
    clusters = candidate_clusters(sets, percent)
    found = written(class_links(sets, classes.join(clusters, "print"), percent), "jaccard-links")
    copies = join_hot(known.select("doc_id", "print"), first.where("first < last"), "print", "rows").where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    between = (
        found.join(first.select(F.col("print").alias("u"), F.col("first").alias("fu")), "u")
        .join(first.select(F.col("print").alias("v"), F.col("first").alias("fv")), "v")
        .select(F.col("fu").alias("u"), F.col("fv").alias("v"))
    )
    label = components(copies.unionByName(between), "jaccard")
    return prints.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
