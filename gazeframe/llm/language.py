"""Language by spans: script ranges narrow the candidates of each word, a Viterbi path over the words' scores labels spans.

Fitting. Of the labelled texts at most ``most`` of a language (and ``MOST_LANGUAGES`` languages, the most frequent ones)
are counted: each letter with the letter before and the one behind it, or the word's edge, gives a gram; a language's
scripts are those that at least SCRIPT_SHARE of its letters have.

Scoring. A word is a maximal run of letters of one script (combining marks belong to the letter before). Its score for a
language is the sum of its grams' log-probabilities; languages that don't have the word's script are no candidates for
it, unless none has. A path through the text pays ``penalty`` wherever the language changes; the best one is found word by word for
all texts of a batch at a time. The text's language is the one with the most letters on the path; ``score`` is its
share of the letters times its probability by the sum of all words' scores.

Defined results: a text that is null or has no letter has no spans, the language ``und`` and score 0. Without
any label all texts are ``und``. Of languages with equally many letters the one of the higher sum wins, then the more frequent
one. Repeated rows give repeated results; a null doc_id is kept; extra columns are ignored; rows without text or
label are not learned from; an empty table gives no rows. Very long texts are labelled whole, in time and memory linear in their words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.common import bounded_batches, written
from gazeframe.llm.grams import FOLD, raw, span_hashes

#: Texts of a language that a model is fitted on, about; the characters of the longest one; languages; grams of the model.
MOST_ROWS, MOST_CHARS, MOST_LANGUAGES, MOST_GRAMS = 1500, 100_000, 256, 1_000_000
#: The smallest share of a language's letters that makes a script one of its own.
SCRIPT_SHARE = 0.01
PENALTY = 16.0
SMOOTH = 0.5
UNKNOWN = "und"
#: Words that a process keeps the scores of.
MOST_WORDS = 400_000
#: Fewer texts than this go on by themselves.
FEW = 24

# Ranges of code points of scripts, as the Unicode standard lays them out in blocks.
SCRIPTS = {
    "Latin": ((0x41, 0x24F), (0x250, 0x2AF), (0x1D00, 0x1D25), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F), (0xFB13, 0xFB17)),
    "Hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)),
    "Devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x980, 0x9FF),),
    "Gurmukhi": ((0xA00, 0xA7F),),
    "Gujarati": ((0xA80, 0xAFF),),
    "Oriya": ((0xB00, 0xB7F),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Kannada": ((0xC80, 0xCFF),),
    "Malayalam": ((0xD00, 0xD7F),),
    "Sinhala": ((0xD80, 0xDFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Lao": ((0xE80, 0xEFF),),
    "Tibetan": ((0xF00, 0xFFF),),
    "Myanmar": ((0x1000, 0x109F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "Ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF)),
    "Khmer": ((0x1780, 0x17FF),),
    "Mongolian": ((0x1800, 0x18AF),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "Han": ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
#: Letters of other scripts, and marks, which are of the script of what stands before them.
OTHER, MARK = len(SCRIPTS) + 1, 255
_EDGE = 10


@lru_cache(1)
def script_table() -> np.ndarray:
    """For each code point 0 (no letter), the number of its script from 1 on, or MARK."""
    table = np.zeros(0x110000, np.uint8)
    letters = [cp for cp in range(0x110000) if chr(cp).isalpha()]
    table[letters] = OTHER
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            part = table[lo : hi + 1]
            part[part == OTHER] = number
    table[[cp for cp in range(0x300, 0x20000) if unicodedata.category(chr(cp))[0] == "M"]] = MARK
    return table


def _scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The script of each byte of UTF-8 texts, which is that of its code point."""
    table = script_table()
    found = table[:128][np.minimum(data, 127)]
    found[data > 127] = 0
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        a, b, c, d = (padded[lead + k] & 0x3F for k in range(4))
        size = 2 + (data[lead] >= 0xE0).astype(int) + (data[lead] >= 0xF0)
        point = np.select([size == 2, size == 3], [(a & 0x1F) << 6 | b, (a & 0xF) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            inside = k < size
            found[lead[inside] + k] = kind[inside]
        marks = np.flatnonzero(found == MARK)
        if len(marks):
            first = np.zeros(len(data), bool)
            first[offsets[:-1][offsets[:-1] < len(data)]] = True
            own = np.where((found != MARK) | first, np.arange(len(data)), 0)
            found = found[np.maximum.accumulate(own)]
            found[found == MARK] = 0
    return found


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, script of each word; number of words of each text)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(len(offsets) - 1, np.int64)
    script = _scripts(data, offsets)
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = script[1:] != script[:-1]
    change[offsets] = True
    cuts = np.flatnonzero(change)
    start, end = cuts[:-1], cuts[1:]
    inside = script[start] > 0
    start, end = start[inside], end[inside]
    return start, end, script[start], np.diff(np.searchsorted(start, offsets))


def gram_keys(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of the gram around each code point of the words in lower case, how many each word has)."""
    points = np.frombuffer((b"\n" + b"\n".join(spelled) + b"\n").decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    centre = np.flatnonzero(points != _EDGE)
    edges = np.flatnonzero(points == _EDGE)
    return points[centre - 1] << 42 | points[centre] << 21 | points[centre + 1], np.diff(edges) - 1


@dataclass(frozen=True)
class Model:
    """``keys`` are in ascending order; ``logs`` has a row for each, and one more for unknown grams."""

    languages: tuple[str, ...]
    keys: np.ndarray
    logs: np.ndarray
    allowed: np.ndarray  # by script and language


def fit(docs: DataFrame, most: int = MOST_ROWS) -> Model | None:
    """A model from labelled texts (text, lang): about ``most`` different texts of each language, chosen by hash; None without any."""
    docs = docs.select("text", "lang").where("text is not null and lang is not null")
    sizes = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    sizes = written(sizes, "languages")  # at most MOST_LANGUAGES rows
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    sample = docs.where(F.length("text") <= MOST_CHARS).join(F.broadcast(sizes), "lang").where(share * F.col("count") < most).select("text", "lang").dropDuplicates()
    counted = sample.mapInArrow(_gram_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    got = counted.orderBy(F.desc("n"), "lang", "key").limit(MOST_GRAMS).toArrow()
    ranked = [r.lang for r in sizes.orderBy(F.desc("count"), "lang").collect()]
    return model_of(got.column("lang").to_pylist(), got.column("key").to_numpy(), got.column("n").to_numpy(), ranked)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, number), and (lang, -script, number of letters)."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            data, offsets = raw(batch.column(0).filter(pa.array(langs == lang)))
            start, end, script, _ = words(data, offsets)
            whole = data.tobytes()
            keys, number = gram_keys([whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]) if len(start) else (start, end)
            key, n = np.unique(np.concatenate([keys, -np.repeat(script.astype(np.int64), number)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "key", "n"])


def model_of(lang: list[str], key: np.ndarray, n: np.ndarray, ranked: list[str]) -> Model | None:
    languages = tuple(x for x in ranked if x in set(lang))
    if not languages:
        return None
    column = np.array([languages.index(x) for x in lang])
    keys = np.unique(key[key > 0])
    counts = np.zeros((len(keys) + 1, len(languages)))
    grams = key > 0
    counts[np.searchsorted(keys, key[grams]), column[grams]] = n[grams]
    total = counts.sum(0)
    logs = np.log((counts + SMOOTH) / (total + SMOOTH * len(counts)))
    scripts = np.zeros((256, len(languages)))
    scripts[-key[~grams], column[~grams]] = n[~grams]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(languages, keys, logs.astype(np.float32), allowed)


class Scorer:
    """Scores of words, of which this process keeps the latest."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.code: dict[int, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.languages)), np.float32)

    def of(self, spelled: list[bytes], script: np.ndarray) -> np.ndarray:
        """A row for each word."""
        model = self.model
        keys, number = gram_keys(spelled)
        at = np.minimum(np.searchsorted(model.keys, keys), max(0, len(model.keys) - 1))
        if len(model.keys):
            at[model.keys[at] != keys] = len(model.keys)
        sums = np.add.reduceat(model.logs[at], np.cumsum(number) - number, axis=0)
        return np.where(model.allowed[script], sums, np.float32(-1e9))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, script: np.ndarray) -> np.ndarray:
        if len(self.code) > MOST_WORDS:
            self._forget()
        keys, first, which = np.unique(span_hashes(data, start, end, FOLD), return_index=True, return_inverse=True)
        names = keys.tolist()
        codes = np.array([self.code.get(k, -1) for k in names], np.int64)
        new = np.flatnonzero(codes < 0)
        if len(new):
            whole, at, n = data.tobytes(), first[new], len(self.code)
            rows = self.of([whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], script[at])
            while n + len(new) > len(self.scores):
                self.scores = np.resize(self.scores, (2 * len(self.scores), self.scores.shape[1]))
            self.scores[n : n + len(new)] = rows
            codes[new] = np.arange(n, n + len(new))
            self.code.update(zip((names[i] for i in new.tolist()), range(n, n + len(new)), strict=True))
        return self.scores[codes[which]]


def path(scores: np.ndarray, number: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path of each text; ``scores`` has a row for each word, ``number`` the words of each text.

    All texts go forward and back together, the longest ones first, so that those which go on are always the first.
    """
    n, k = scores.shape
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    first = (np.cumsum(number) - number)[(order := np.argsort(-number, kind="stable"))]
    size = number[order]
    going = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # texts that have a word at each place
    together = int(np.searchsorted(-going, -FEW, "right"))  # places up to which many texts go on
    best = np.zeros(n, np.int32)  # the best language of the word before
    stays = np.zeros((n, k), bool)  # whether a language does better by going on than by a change from the best
    value = np.zeros((k, len(size)))
    for t in range(together):
        m = int(going[t])
        at = first[:m] + t
        now = value[:, :m]
        if t:
            top = now.argmax(0)
            floor = now[top, np.arange(m)] - penalty
            best[at] = top
            stays[at] = (now >= floor).T
            now = np.maximum(now, floor)
        value[:, :m] = now + scores[at].T
    label = np.zeros(n, np.int64)
    after = value.argmax(0)  # of the place behind
    for row in range(int(going[together]) if together < len(going) else 0):  # the longest texts, one by one
        after[row] = _alone(value[:, row].tolist(), scores, int(first[row]), together, int(size[row]), penalty, best, stays, label)
    for t in range(together - 1, -1, -1):
        m = int(going[t])
        at = first[:m] + t
        label[at] = after[:m]
        after[:m] = np.where(stays[at, after[:m]], after[:m], best[at])
    return label


def _alone(value: list[float], scores: np.ndarray, first: int, start: int, size: int, penalty: float, best: np.ndarray, stays: np.ndarray, label: np.ndarray) -> int:
    """Goes on from place ``start`` to the text's end and back, and says the language at the place before."""
    rows = scores[first + start : first + size].astype(float).tolist()
    tops, going_on = [], []
    for row in rows:
        floor = max(value)
        tops.append(value.index(floor))
        floor -= penalty
        going_on.append([v >= floor for v in value])
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row, strict=True)]
    lang = value.index(max(value))
    found = []
    if start == 0:
        going_on[0] = [True] * len(value)
    for top, on in zip(reversed(tops), reversed(going_on), strict=True):
        found.append(lang)
        lang = lang if on[lang] else top
    label[first + start : first + size] = found[::-1]
    return lang


def labelled(texts: pa.Array, scorer: Scorer, penalty: float = PENALTY) -> tuple[list[str], np.ndarray, tuple[np.ndarray, ...]]:
    """(language of each text, its score, (data, first byte, end, language's number of each word, words of each text))."""
    data, offsets = raw(texts)
    start, end, script, number = words(data, offsets)
    rows, languages = len(number), scorer.model.languages
    k = len(languages)
    if not len(start):
        return [UNKNOWN] * rows, np.zeros(rows), (data, start, end, start, number)
    scores = scorer(data, start, end, script)
    label = path(scores, number, penalty)
    leads = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    letters = leads[end] - leads[start]
    row = np.repeat(np.arange(rows), number)
    by_language = np.bincount(row * k + label, letters, rows * k).reshape(rows, k)
    sums = np.zeros((rows, k))
    some = number > 0
    sums[some] = np.add.reduceat(scores.astype(float), (np.cumsum(number) - number)[some], axis=0)
    top = by_language == by_language.max(1, keepdims=True)
    chosen = np.where(top, sums, -np.inf).argmax(1)
    odds = np.exp(np.maximum(sums - sums.max(1, keepdims=True), -700))
    sure = odds[np.arange(rows), chosen] / odds.sum(1)
    share = by_language[np.arange(rows), chosen] / np.maximum(by_language.sum(1), 1)
    names = [languages[c] if s else UNKNOWN for c, s in zip(chosen.tolist(), some.tolist(), strict=True)]
    return names, np.where(some, share * sure, 0.0), (data, start, end, label, number)


_kept: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    """This process's scorer of a model, with the words that it has met."""
    if not _kept or _kept[0].model is not model:
        _kept[:] = [Scorer(model)]
    return _kept[0]


def identify(docs: DataFrame, model: Model | None, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_GRAMS grams at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                names, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            else:
                names, score, _ = labelled(batch.column(1), _scorer(shared.value), penalty)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang", "score"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(work, "doc_id long, lang string, score double")


#: A span as a column.
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])


def spans(docs: DataFrame, model: Model | None, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, spans) of every row: from the first letter of a language's words to the end of the last one, in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_GRAMS grams at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                cut, flat = np.zeros(len(batch) + 1, np.int32), [[], [], []]
            else:
                _, _, (data, start, end, label, number) = labelled(batch.column(1), _scorer(shared.value), penalty)
                row = np.repeat(np.arange(len(number)), number)
                new = np.ones(len(start), bool)
                new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                last = np.append(new[1:], True)[: len(start)]
                points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
                base = points[raw(batch.column(1))[1][:-1]]
                cut = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(number)))]).astype(np.int32)
                flat = [points[start[new]] - base[row[new]], points[end[last]] - base[row[last]], [shared.value.languages[i] for i in label[new].tolist()]]
            made = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, SPAN, strict=True)], fields=list(SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(cut), made)], ["doc_id", "spans"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(work, "doc_id long, spans array<struct<start:long,end:long,lang:string>>")

