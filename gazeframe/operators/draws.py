"""Random counts by inverse distribution functions, in numpy on batches of rows: multinomial and multivariate hypergeometric.

Each draw turns one uniform number into a count. The support is cut to WIDTH deviations around the mean, beyond which a
uniform number of 32 bits can't reach; weights relative to the first count are built up by the ratios of neighbours and
summed. So the same uniform numbers give the same counts in any engine. A draw from n items costs the square root of n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 8.0
#: Weights that are held at a time.
MOST_WEIGHTS = 1 << 20


def _inverse(u: np.ndarray, first: np.ndarray, last: np.ndarray, ratio: Callable[[np.ndarray, slice], np.ndarray]) -> np.ndarray:
    """The smallest count whose cumulated weight reaches u of the total; ``ratio(k, rows)`` is weight(k + 1) / weight(k)."""
    out = np.empty(len(u))
    wide = int((last - first).max(initial=0)) + 1
    step = max(1, MOST_WEIGHTS // wide)
    for at in range(0, len(u), step):
        rows = slice(at, at + step)
        k = first[rows, None] + np.arange(wide - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            weights = np.where(k < last[rows, None], ratio(k, rows), 0.0)
        sums = np.cumsum(np.cumprod(np.concatenate([np.ones((len(k), 1)), weights], 1), 1), 1)
        out[rows] = first[rows] + (sums < (u[rows] * sums[:, -1])[:, None]).sum(1)
    return out


def hypergeometric(u: np.ndarray, population: np.ndarray, special: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of ``special`` items are among ``size`` drawn from ``population`` without replacement. All are doubles of whole numbers."""
    share = special / np.maximum(population, 1.0)
    mean = size * share
    spread = WIDTH * np.sqrt(mean * (1.0 - share) * (population - size) / np.maximum(population - 1, 1.0)) + WIDTH
    first = np.maximum(np.maximum(0.0, size - (population - special)), np.floor(mean - spread))
    last = np.minimum(np.minimum(special, size), np.ceil(mean + spread))
    s, n, rest = special[:, None], size[:, None], (population - special - size)[:, None]
    return _inverse(u, first, last, lambda k, r: (s[r] - k) * (n[r] - k) / ((k + 1) * (rest[r] + k + 1)))


def binomial(u: np.ndarray, size: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How many of ``size`` trials succeed, each with probability ``share``."""
    spread = WIDTH * np.sqrt(size * share * (1.0 - share)) + WIDTH
    sure = share >= 1
    first = np.where(sure, size, np.maximum(0.0, np.floor(size * share - spread)))
    last = np.where(sure, size, np.minimum(size, np.ceil(size * share + spread)))
    with np.errstate(divide="ignore"):
        odds = (share / (1.0 - share))[:, None]
    n = size[:, None]
    return _inverse(u, first, last, lambda k, r: (n[r] - k) / (k + 1) * odds[r])


def without_replacement(u: np.ndarray, cells: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of counts: ``size`` items drawn from cells of so many items, one cell after the other."""
    taken, rest = np.zeros_like(cells), cells.sum(1)
    for i in range(cells.shape[1]):
        taken[:, i] = hypergeometric(u[:, i], rest, cells[:, i], size)
        rest, size = rest - cells[:, i], size - taken[:, i]
    return taken


def with_replacement(u: np.ndarray, cells: np.ndarray, size: np.ndarray) -> np.ndarray:
    taken, rest = np.zeros_like(cells), cells.sum(1)
    for i in range(cells.shape[1]):
        taken[:, i] = binomial(u[:, i], size, np.where(cells[:, i] >= rest, 1.0, cells[:, i] / np.maximum(rest, 1.0)))
        rest, size = rest - cells[:, i], size - taken[:, i]
    return taken


def drawn(rows: DataFrame, keys: list[str], arrays: list[str], draw: Callable[..., np.ndarray]) -> DataFrame:
    """(keys..., drawn: array of doubles): ``draw`` gets a matrix for each of the columns ``arrays``, whose arrays are equally long in all rows."""
    kinds = dict(rows.dtypes)

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(len(column), -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                got = draw(*[matrix(b.column(len(keys) + i)) for i in range(len(arrays))])
                ends = np.arange(0, got.size + 1, got.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.ListArray.from_arrays(pa.array(ends), pa.array(got.ravel()))], [*keys, "drawn"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", drawn array<double>"
    return rows.select(*keys, *arrays).mapInArrow(work, schema)


def uniforms(md5: Callable[[int], Column], n: int) -> Column:
    """``n`` uniform numbers inside (0, 1) from md5 integers."""
    return F.array(*[(md5(i) + 0.5) / F.lit(4294967296.0) for i in range(n)])
