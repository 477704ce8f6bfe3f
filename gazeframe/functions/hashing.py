"""Deterministic pseudo-random numbers: the same for a key on any partitioning, and in any engine with md5."""

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of md5 integers that ``md5_rank`` ranks apart from each other.
RANGES = 4096


def md5_int(*keys: Column | str | int) -> Column:
    """The first 32 bits of md5 over the keys joined by '|', as a long. Strings name columns; wrap constants in lit()."""
    text = F.concat_ws("|", *[F.col(k) if isinstance(k, str) else F.lit(k) if isinstance(k, int) else k for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
#: Messages that are hashed at once: their arrays fit a core's cache.
_AT_ONCE = 1 << 14


def _md5_of_one_block(words: list[np.ndarray | np.uint32]) -> np.ndarray:
    """The first word of md5 of many messages of a block each, given word by word; a word that all share is a number."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f = f + (a + np.uint32(_SINES[i]) + words[g])
            a, d, c = d, c, b
            b = b + (f << np.uint32(_TURNS[i]) | f >> np.uint32(32 - _TURNS[i]))
        return a + start[0]


def md5_ints(prefix: str, ids: np.ndarray) -> np.ndarray:
    """``md5_int`` of ``prefix`` followed by each of the ascending numbers ``ids``, as uint32: where a text fits a block, in numpy."""
    head = prefix.encode()
    out = np.empty(len(ids), np.uint32)
    cuts = [0, *np.searchsorted(ids, [0, *(10**k for k in range(1, 19))]).tolist(), len(ids)]  # negative ones, and of 1 to 19 digits
    for width, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        size = len(head) + width
        for i in range(lo, hi, _AT_ONCE):
            rest = ids[i : min(i + _AT_ONCE, hi)]
            if not width or size > 55:
                out[i : i + len(rest)] = np.frombuffer(b"".join([hashlib.md5(head + str(x).encode()).digest()[:4] for x in rest.tolist()]), ">u4")
                continue
            block = np.zeros((64, len(rest)), np.uint8)
            block[: len(head)] = np.frombuffer(head, np.uint8)[:, None]
            for k in range(size - 1, len(head) - 1, -1):
                rest, digit = np.divmod(rest, 10)
                block[k] = digit + 48
            block[size] = 0x80
            words = []
            for w in range(14):
                if 4 * w <= size and 4 * w + 4 > len(head):
                    words.append(np.ascontiguousarray(block[4 * w : 4 * w + 4].T).view("<u4").ravel())
                else:
                    words.append(np.uint32(int.from_bytes(block[4 * w : 4 * w + 4, 0].tobytes(), "little")))
            out[i : i + block.shape[1]] = _md5_of_one_block([*words, np.uint32(8 * size), np.uint32(0)]).byteswap()
    return out


def md5_uniform(*keys: Column | str | int) -> Column:
    """Uniform in [0, 1)."""
    return md5_int(*keys) / F.lit(4294967296.0)


def md5_rank(df: DataFrame, by: list[str], name: str, keys: list[Column | str | int], tie: str) -> DataFrame:
    """Adds ``name``: the row's rank from 1 within ``by``, by ``md5_int(*keys)`` and then ``tie``.

    A group may hold most rows. So it is cut into ranges of the md5 integer: rows are numbered within a range, and the
    ranges' counts (RANGES for each group at most) are summed up to where each one starts.
    """
    r = df.withColumn("_md5", md5_int(*keys)).withColumn("_range", F.floor(F.col("_md5") / F.lit(2**32 // RANGES)).cast("int"))
    counts = r.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_md5", tie))
    return r.withColumn("_inside", inside).join(starts, [*by, "_range"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_md5", "_range", "_inside", "_start")
