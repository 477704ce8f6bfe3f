"""Toxicity by compression distance: a text's windows are compressed with a dictionary of toxic and one of ordinary text.

Fitting. From labelled rows a bounded sample is taken (``most`` rows of either label, by the hash of their ids); near
copies within it are left out. It trains two Zstandard dictionaries of the same size, one on windows of ordinary texts
and one on windows of toxic texts. Most of a toxic text is ordinary, so its dictionary is trained on the windows that
hold a stretch of bytes which toxic texts have EXCESS times as often as ordinary ones; every text counts, so that no kind of toxic text
is crowded out by a more frequent one. Ordinary windows with such a stretch are left out. Behind both dictionaries
stands the same ordinary text, so that what all texts have in common is found with either. The calibration is
cross-fitted: for each of FOLDS parts of the sample dictionaries of the other parts compress its texts. The odds of
toxic and ordinary texts by the bytes that a window saves, and a logistic regression on sums of their logarithms and on shares of windows, make the score.

Scoring. Every text is cut at blanks into windows over its whole length; each window is compressed with either
dictionary, and the statistics of the differences give a score from 0 to 1. Nothing but the text enters.

Defined results: a null or empty text has one empty window, hence the score of no difference. Without labels of both
kinds every score is 0. Rows with contradicting labels are not learned from. Repeated rows give repeated results; a
null doc_id is kept. Extra columns are ignored in scores and kept by ``keep_clean``. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.common import bounded_batches, map_whole_rows
from gazeframe.llm.grams import eights, mixed

#: Labelled rows of either kind that a model is fitted on at most, and the characters of the longest one.
MOST_ROWS = 3000
MOST_CHARS = 100_000
#: Characters of all texts of either kind that a model is fitted on, at most.
MOST_TOTAL = 20_000_000
WINDOW, REACH = 96, 32
#: Windows that the dictionaries are trained on: of ordinary texts, of toxic texts; and the most that are used.
ORDINARY_WINDOW, TOXIC_WINDOW, TOXIC_REACH, MOST_WINDOWS = 48, 12, 12, 40_000
LEVEL = 9
#: Bytes of each dictionary, of the segments that it is put together from, and of the text behind it.
DICTIONARY_BYTES, SEGMENT, BASE_BYTES = 16_384, 16, 1_000_000
#: Lengths of stretches; how many times as often, at what distance from chance, and in how many texts a toxic one stands.
STRETCHES, EXCESS, DEVIATIONS, LEAST_TEXTS = (6, 8), 3.0, 6.0, 3
FOLDS = 4
#: What a toxic text counts in the calibration, where an ordinary one counts 1.
TOXIC_WEIGHT = 1.5
#: Saved bytes of a window count from -LOW to HIGH.
LOW, HIGH = 3, 6


@dataclass(frozen=True)
class Model:
    base: bytes
    ordinary: bytes
    toxic: bytes
    odds: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").replace(b"\n", b" ")


def windows(text: str, size: int = WINDOW, reach: int = REACH) -> list[bytes]:
    """The whole text in lower case as windows of about ``size`` bytes that end before a blank, if one is within ``reach``."""
    data = _bytes(text)
    out, at, n = [], 0, len(data)
    while at < n:
        end = at + size
        if end < n:
            blank = data.find(b" ", end, end + reach)
            end = blank if blank > 0 else end
        out.append(data[at:end])
        at = end
    return out or [b""]


def _compressor(content: bytes):
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress


class _Press:
    """The two compressors of a model."""

    def __init__(self, base: bytes, ordinary: bytes, toxic: bytes):
        self.plain, self.toxic = _compressor(ordinary + base), _compressor(toxic + base)

    def saved(self, text: str) -> np.ndarray:
        """How many windows save each number of bytes, from -LOW to HIGH, with the toxic dictionary."""
        plain, toxic = self.plain, self.toxic
        out = [0] * (LOW + HIGH + 1)
        for w in windows(text):
            out[max(-LOW, min(HIGH, len(plain(w)) - len(toxic(w)))) + LOW] += 1
        return np.array(out)


def statistics(saved: np.ndarray, odds: tuple[float, ...]) -> list[float]:
    """Of a text's windows by saved bytes: the sum of log odds, bounded and by the root of their number, and shares of windows."""
    n = int(saved.sum())
    total = float(saved @ np.array(odds))
    more = np.cumsum(saved[::-1])[::-1]
    return [max(-10.0, min(20.0, total)) / 10, max(-4.0, min(8.0, total / n**0.5)), *[min(0.3, more[LOW + k] / n) * 3 for k in (1, 2, 4)]]


def _distinct(texts: list[str]) -> list[str]:
    """Without texts that share one of the six smallest hashes of three words with one before."""
    seen: set[int] = set()
    out = []
    for t in texts:
        words = t.lower().split()
        marks = sorted(zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2)))[:6]
        if not any(m in seen for m in marks):
            seen.update(marks)
            out.append(t)
    return out


def _train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    samples = samples[:: max(1, len(samples) // MOST_WINDOWS)]
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8, f=18, accel=1, steps=1, split_point=1.0, level=3).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: the samples themselves
        return b"".join(samples)[-size:]


#: Stretches are counted in so many parts, by their hash, and windows searched so many at a time: what bounds the driver's memory.
PARTS, BLOCK = 4, 20_000


def _codes(data: bytes, size: int) -> np.ndarray:
    """The stretch of ``size`` bytes from each place on, as a number."""
    return eights(np.frombuffer(data, np.uint8))[: max(0, len(data) - size + 1)] & np.uint64((1 << 8 * size) - 1)


def _within(codes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """For each code its place among ``some``, which are in order, or -1."""
    if not len(some):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(some, codes), len(some) - 1)
    return np.where(some[at] == codes, at, -1)


def excess(toxic: list[bytes], ordinary: list[bytes]) -> dict[int, np.ndarray]:
    """The stretches, by length, that toxic texts have far more often than ordinary ones."""
    share = sum(map(len, toxic)) / max(1, sum(map(len, ordinary)))
    found = {}
    for size in STRETCHES:
        often = []
        for part in range(PARTS):
            own = []
            for t in toxic:
                codes = _codes(t, size)
                own.append(np.unique(codes[mixed(codes) % np.uint64(PARTS) == part], return_counts=True))
            codes, which = np.unique(np.concatenate([c for c, _ in own] or [np.zeros(0, np.uint64)]), return_inverse=True)
            texts, times = np.bincount(which, minlength=len(codes)), np.bincount(which, np.concatenate([n for _, n in own] or [np.zeros(0)]), len(codes))
            often.append((codes[texts >= LEAST_TEXTS], times[texts >= LEAST_TEXTS]))
        codes, times = (np.concatenate(x) for x in zip(*often, strict=True))
        order = np.argsort(codes)
        codes, times = codes[order], times[order]
        seen = np.zeros(len(codes))
        for k in range(0, len(ordinary), 50):
            at = _within(np.concatenate([_codes(t, size) for t in ordinary[k : k + 50]]), codes)
            seen += np.bincount(at[at >= 0], minlength=len(codes))
        expected = (seen + 1) * share
        found[size] = codes[(times >= EXCESS * expected) & (times - expected >= DEVIATIONS * np.sqrt(expected))]
    return found


def _holding(parts: list[bytes], marks: dict[int, np.ndarray]) -> np.ndarray:
    """Which windows hold one of the stretches."""
    out = np.zeros(len(parts), bool)
    for k in range(0, len(parts), BLOCK):
        block = parts[k : k + BLOCK]
        data, ends = b"".join(block), np.cumsum([len(p) for p in block])
        for size, codes in marks.items():
            at = np.flatnonzero(_within(_codes(data, size), codes) >= 0)
            row = np.searchsorted(ends, at, "right")
            out[k + row[at + size <= ends[row]]] = True
    return out


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, bytes]:
    """(text behind both, ordinary dictionary, toxic dictionary) from texts of both kinds."""
    marks = excess([_bytes(t) for t in toxic], [_bytes(t) for t in ordinary])
    plain = [w for t in ordinary for w in windows(t, ORDINARY_WINDOW)]
    clean = [w for w, marked in zip(plain, _holding(plain, marks).tolist(), strict=True) if not marked]
    order = np.random.default_rng(5).permutation(len(clean)).tolist()
    base = b"".join(clean[i] for i in order[::2])[:BASE_BYTES]
    parts = [w for t in toxic for w in windows(t, TOXIC_WINDOW, TOXIC_REACH)]
    chosen = [w for w, marked in zip(parts, _holding(parts, marks).tolist(), strict=True) if marked]
    return base, _train([clean[i] for i in order[1::2]]), _train(chosen or parts)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights, and the bias last, by Newton's method with a squared penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    count = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    ridge = np.diag([penalty] * (len(w) - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (count * p * (1 - p))[:, None]) + ridge, x.T @ (count * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model | None:
    """A model from texts of both kinds; None if there are too few."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    if len(toxic) < 4 or len(ordinary) < 4:
        return None
    rows, kinds = [], []
    for k in range(FOLDS):
        press = _Press(*dictionaries(*[[t for i, t in enumerate(part) if i % FOLDS != k] for part in (toxic, ordinary)]))
        for kind, part in ((1.0, toxic), (0.0, ordinary)):
            rows += [press.saved(t) for t in part[k::FOLDS]]
            kinds += [kind] * len(part[k::FOLDS])
    saved, y = np.array(rows), np.array(kinds)
    seen = [saved[y == kind].sum(0) + 1.0 for kind in (1.0, 0.0)]
    odds = tuple((np.log(seen[0] / seen[0].sum()) - np.log(seen[1] / seen[1].sum())).tolist())
    x = np.array([statistics(r, odds) for r in saved])
    middle, spread = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - middle) / spread, y)
    weights = w[:-1] / spread
    return Model(*dictionaries(toxic, ordinary), odds, tuple(weights.tolist()), float(w[-1] - weights @ middle))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): at most ``most`` rows of either label, and MOST_TOTAL characters."""
    agreed = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .where("toxic = other")
    )
    texts = docs.select("doc_id", "text").where((F.length("text") <= MOST_CHARS) & (F.length("text") > 0))
    found = []
    for kind in (1, 0):
        ids = agreed.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
        got = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toArrow()  # ``most`` rows
        rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("text").to_pylist(), strict=True))
        rows.sort(key=lambda r: zlib.crc32(str(r[0]).encode()))
        ends = np.cumsum([len(t) for _, t in rows[:most]])
        found.append([t for (_, t), end in zip(rows[:most], ends.tolist(), strict=True) if end <= MOST_TOTAL])
    return fit_texts(*found)


def _scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    press = _presses(model)
    z = np.array([statistics(press.saved(t or ""), model.odds) for t in texts]).reshape(-1, len(model.weights)) @ np.array(model.weights) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_made: dict[Model, _Press] = {}


def _presses(model: Model) -> _Press:
    if model not in _made:
        _made.clear()
        _made[model] = _Press(model.base, model.ordinary, model.toxic)
    return _made[model]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and BASE_BYTES of text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(_scores(model, part.column(1).to_pylist()))], ["doc_id", "score"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                yield part.filter(pa.array(_scores(model, part.column(at).to_pylist()) < threshold))

    return map_whole_rows(docs, work)
