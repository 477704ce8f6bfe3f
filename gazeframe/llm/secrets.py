"""Secret scan: each block of documents gets a trigram inverted index, which tells where a rule's pattern can match.

From each rule's pattern a Boolean query over trigrams is derived (every match holds them, letters folded). Within a
task, each Arrow batch is a segment: its index maps the trigrams of the queries to postings (rows of the segment), the
query of a rule intersects and unites postings, and the pattern runs on the rows that remain. A rule without mandatory
trigrams scans every row. Nothing is shuffled, and memory is that of one batch.

Defined results: a null or empty text has no spans (counts 0, digest of the empty string, empty ``spans``). Repeated
rows give repeated results; a null doc_id is kept. Extra columns are ignored. Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gazeframe.llm.common import bounded_batches, map_whole_rows


@dataclass(frozen=True)
class Rule:
    """kind; pattern; least length of a group (0: of the match), tested after the leftmost non-overlapping matching."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The base rules, in their order, and the rules that this method adds.
BASE = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: More strings than this for one part of a pattern count as unknown.
MOST_STRINGS = 64

# A query is True (matches anywhere), a trigram, or ("and" | "or", parts).


def _all_of(text: str):
    parts = [text[i : i + 3] for i in range(len(text) - 2)]
    return _join("and", parts) if parts else True


def _join(op: str, parts: list):
    parts = list(dict.fromkeys(parts))
    if op == "and":
        parts = [x for x in parts if x is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings(item) -> set[str] | None:
    """The strings that a part of a pattern can match, if they are few."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN and all(x[0] is C.LITERAL for x in arg):
        return {chr(x[1]).lower() for x in arg}
    if op is C.SUBPATTERN:
        return _sequence(arg[3])[1]
    if op is C.BRANCH:
        found = [_sequence(b)[1] for b in arg[1]]
        return None if None in found else set().union(*found)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2:
        one = _sequence(arg[2])[1]
        if one is not None:
            return {"".join(s) for n in range(arg[0], arg[1] + 1) for s in ([()] if n == 0 else [(a,) for a in one] if n == 1 else [(a, b) for a in one for b in one])}
    return None


def _sequence(items) -> tuple[object, set[str] | None]:
    """(query, strings or None) of the parts of a pattern that follow each other."""
    asked, run, whole = [], {""}, True
    for item in items:
        if item[0] in (C.AT, C.ASSERT, C.ASSERT_NOT):  # they match no characters of their own
            continue
        found = _strings(item)
        if found is not None and len(run) * len(found) <= MOST_STRINGS:
            run = {a + b for a in run for b in found}
            continue
        asked.append(_join("or", [_all_of(s) for s in sorted(run)]))
        run, whole = (found, False) if found is not None and len(found) <= MOST_STRINGS else ({""}, False)
        if found is None:
            asked.append(_inside(item))
    asked.append(_join("or", [_all_of(s) for s in sorted(run)]))
    return _join("and", asked), run if whole else None


def _inside(item):
    op, arg = item
    if op is C.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is C.BRANCH:
        return _join("or", [_sequence(b)[0] for b in arg[1]])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
        return _sequence(arg[2])[0]
    return True


def trigram_query(pattern: str):
    """The Boolean trigram query that every text with a match fulfils, over folded letters; True if there is none."""
    return _sequence(_parser.parse(pattern))[0]


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _candidates(query, postings: dict[str, np.ndarray], every: np.ndarray) -> np.ndarray:
    if query is True:
        return every
    if isinstance(query, str):
        return postings[query]
    found = _candidates(query[1][0], postings, every)
    for part in query[1][1:]:
        more = _candidates(part, postings, every)
        found = np.intersect1d(found, more, True) if query[0] == "and" else np.union1d(found, more)
        if query[0] == "and" and not len(found):
            break
    return found


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def numbers(wanted: dict[str, int]) -> np.ndarray:
    """For each three bytes, 0 or 1 + the number of the wanted trigram that they are: 32 MB, made once in a task."""
    table = np.zeros(1 << 24, np.uint16)
    for t, i in wanted.items():
        a, b, c = t.encode()
        table[a << 16 | b << 8 | c] = i + 1
    return table


def segment_index(texts: pa.Array, wanted: dict[str, int], table: np.ndarray) -> dict[str, np.ndarray]:
    """Postings (ascending rows) of each wanted trigram in one batch of texts. wanted: trigram to its number; table: ``numbers`` of it."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    empty = {t: np.zeros(0, np.int64) for t in wanted}
    if not len(texts) or offsets[-1] - offsets[0] < 3:
        return empty
    data = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    code = data[:-2].astype(np.uint32)
    code <<= 8
    code |= data[1:-1]
    code <<= 8
    code |= data[2:]
    got = table[code]
    at = np.flatnonzero(got)
    ends = offsets[1:] - offsets[0]
    row = np.searchsorted(ends, at, "right")
    inside = at + 3 <= ends[row]
    keys = np.unique((got[at][inside].astype(np.int64) - 1) * len(texts) + row[inside])
    cut = np.searchsorted(keys, np.arange(len(wanted) + 1) * len(texts))
    return {t: keys[cut[i] : cut[i + 1]] - i * len(texts) for t, i in wanted.items()}


def _matches(rule: Rule, found: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in found.finditer(text) if len(m.group(rule.group)) >= rule.least]


#: Bytes of a segment, about.
SEGMENT_BYTES = 8 << 20


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """Per document: doc_id, the counts of base spans by kind, ``base_sha256``, all ``spans``, and how many patterns had to be run on it."""
    rules = (*base, *added)
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = {t: i for i, t in enumerate(sorted(t for t in set().union(*map(trigrams, queries)) if len(t.encode()) == 3))}
    kinds = [r.kind for r in base]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, table = [re.compile(r.pattern) for r in rules], numbers(wanted)
        for whole in batches:
            step = max(1, int(len(whole) * SEGMENT_BYTES / max(1, whole.nbytes)))
            for k in range(0, len(whole), step):
                batch = whole.slice(k, step)
                texts = batch.column(1).fill_null("")
                postings = segment_index(texts, wanted, table)
                every = np.arange(len(texts))
                spans: list[list] = [[] for _ in range(len(texts))]
                runs = np.zeros(len(texts), np.int64)
                for n, (rule, pattern, query) in enumerate(zip(rules, found, queries, strict=True)):
                    rows = _candidates(query, postings, every)
                    runs[rows] += 1
                    for i in rows.tolist():
                        for start, end in _matches(rule, pattern, texts[i].as_py()):
                            spans[i].append((start, n, end))
                out = []
                for mine in spans:
                    mine.sort()
                    own = [f"{rules[n].kind}:{a}:{b}" for a, n, b in mine if n < len(base)]
                    count = [sum(n == i for _, n, _ in mine) for i in range(len(kinds))]
                    out.append((*count, hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in mine)))
                cols = list(zip(*out, strict=True)) or [()] * (len(kinds) + 2)
                names = ["doc_id", *[f"n_{k}" for k in kinds], "base_sha256", "spans", "n_verified"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in cols[: len(kinds)]], pa.array(cols[-2], pa.string()), pa.array(cols[-1], pa.string()), pa.array(runs)], names
                )

    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in kinds)}, base_sha256 string, spans string, n_verified long"
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(work, schema)


def redact(docs: DataFrame, mask: str = "[secret]", base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """``docs`` with all their columns; every span that ``scan`` finds in ``text`` is replaced by ``mask`` and n_chars, if there, counts anew."""
    from pyspark.sql import functions as F

    rules = (*base, *added)
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = {t: i for i, t in enumerate(sorted(t for t in set().union(*map(trigrams, queries)) if len(t.encode()) == 3))}
    at = docs.columns.index("text")
    names = docs.schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, table = [re.compile(r.pattern) for r in rules], numbers(wanted)
        for whole in batches:
            step = max(1, int(len(whole) * SEGMENT_BYTES / max(1, whole.nbytes)))
            for k in range(0, len(whole), step):
                batch = whole.slice(k, step)
                texts = batch.column(at)
                postings = segment_index(texts.fill_null(""), wanted, table)
                every = np.arange(len(texts))
                cuts: dict[int, list[tuple[int, int]]] = {}
                for rule, pattern, query in zip(rules, found, queries, strict=True):
                    for i in _candidates(query, postings, every).tolist():
                        if (text := texts[i].as_py()) and (got := _matches(rule, pattern, text)):
                            cuts.setdefault(i, []).extend(got)
                if cuts:
                    new = texts.to_pylist()
                    for i, spans in cuts.items():
                        kept, end = [], 0
                        for a, b in sorted(spans):
                            if a >= end:
                                kept += [new[i][end:a], mask]
                            end = max(end, b)
                        new[i] = "".join([*kept, new[i][end:]])
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))
                yield batch

    out = map_whole_rows(docs, work)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
