"""Periodic runs, spelling variants, languages: brute-force versions, through the queries too."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeframe.llm import language, queries, runs, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, runs string, word string, score int"


def rows_of(texts, langs=None):
    return [(i, t, langs[i] if langs else None, "x", "y", 1) for i, t in enumerate(texts)]


def brute_runs(ids, least=12):
    found, seen = [], set()
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i + q < len(ids):
            if ids[i] == ids[i + q]:
                j = i
                while j + q < len(ids) and ids[j] == ids[j + q]:
                    j += 1
                if j + q - i >= max(least, 2 * q) and (i, j + q - i) not in seen:
                    seen.add((i, j + q - i))
                    found.append((i, j + q - i, q))
                i = j
            i += 1
    return sorted(found, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_words(least):
    rng = random.Random(least)
    for _ in range(400):
        k, n = rng.choice([1, 2, 3, 5, 50]), rng.randrange(90)
        ids = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            ids = ids[:a] + [ids[a + i % p] for i in range(n - a)]
        assert sorted(runs.runs_of(ids, least), key=lambda x: (x[0], x[2])) == brute_runs(ids, least)


def test_suffix_automaton_has_all_stretches():
    rng = random.Random(1)
    for _ in range(60):
        ids = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        length, link, ends = runs.suffix_automaton(ids)
        different = {tuple(ids[i:j]) for i in range(len(ids)) for j in range(i + 1, len(ids) + 1)}
        assert sum(length[s] - length[link[s]] for s in range(1, len(length))) == len(different) and len(ends) == len(ids)


def test_long_and_hostile_runs_take_little_time():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert runs.runs_of([0] * 200_000) == [(0, 200_000, 1)]
    assert len(runs.runs_of(([0] * 300 + [1]) * 60)) == 61
    some = runs.runs_of(fibonacci[-1])
    assert len(some) == len(set(some)) > 1000


def brute_op11(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest(lines), digest(kept))


def test_op11_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    texts = [None, "", " \t\x0b\x0c\r\n ", "one", "a " * 11, "a " * 12, "   " * 9 + " x" * 13, "A a " * 20]
    for _ in range(400):
        line = " ".join(rng.choice(["the", "The", "of", "é", "x\u0085y", "-", "wörd", str(rng.randrange(50))]) for _ in range(rng.randrange(1, 30)))
        parts = [line] * rng.choice([1, 1, 2, 3, 9]) + [" ".join(str(rng.randrange(40)) for _ in range(rng.randrange(40)))]
        texts.append(rng.choice([" ", "\n", "  \t", "\r\n"]).join(parts))
    docs = spark.createDataFrame([*rows_of(texts), (7, texts[7], None, "x", "y", 1), (None, "b " * 15, None, "x", "y", 1)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    want = [brute_op11(i, t) for i, t in enumerate(texts)] + [brute_op11(7, texts[7])]
    none = [r for r in got if r[0] is None]
    assert len(none) == 1 and none[0][1:6] == (1, 0, 15, 1, 15000)
    assert sorted(r for r in got if r[0] is not None) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 100
    assert runs.find(docs.limit(0)).count() == 0


def test_collapsed_texts(spark):
    docs = spark.createDataFrame(rows_of(["x " + "a b c " * 5 + "y", "no run here"]), DOCS)
    got = {r["doc_id"]: r for r in runs.find(docs).collect()}
    assert [tuple(r) for r in got[0]["runs"]] == [(1, 15, 3)] and got[0]["collapsed"] == "x a b c y"
    assert got[1]["runs"] == [] and got[1]["collapsed"] == "no run here"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_groups(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x)) if others else None
        form = best if best and counts[best] >= ratio * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    for w, v in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (v[0], root, *v[1:])
    return out


def test_near_words_against_brute_force(spark):
    rng = random.Random(3)
    made = {"aaaa", "aaaaa", "aaaaaaa", "aaaaaaaa"}
    while len(made) < 700:
        w = "".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9)))
        i = rng.randrange(len(w))
        made |= {w, w[:i] + rng.choice("abcé") + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:]}
    counts = {w: rng.choice([2, 3, 20, 30, 400, 5000]) for w in sorted(made) if len(w) >= 4}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r["word"]: tuple(r)[1:] for r in spelling.group(words).collect()}
    assert got == brute_groups(counts)
    pairs = {(r["word"], r["near"]) for r in spelling.near_pairs(words).collect()}
    assert pairs == {(a, b) for a in counts for b in counts if near(a, b)}


def test_pivots_are_the_lightest_pair_that_does_not_overlap():
    rng = random.Random(4)
    for _ in range(500):
        ranks = [rng.randrange(12) for _ in range(rng.randrange(3, 12))]
        weights = [1 + r * r for r in ranks]
        prefix, pair = spelling.prefix_and_pivots(ranks, weights)
        assert prefix == [i for i, r in enumerate(ranks) if r <= sorted(ranks)[2]] and pair[1] - pair[0] >= 2 and set(pair) <= set(prefix)
        assert sum(weights[p] for p in pair) == min(weights[i] + weights[j] for i in prefix for j in prefix if j - i >= 2)


def test_words_and_their_keys_are_never_broadcast(spark, tmp_path):
    """Few compressed bytes of words are a dozen times as many keys: no table of words may go through the driver, however small it looks."""
    words = [f"{a}{b}ordinary{c}" for a in "abcdefgh" for b in "klmnop" for c in "uvwxyz"]
    spark.createDataFrame([(w, 2) for w in words], "word string, n long").write.parquet(f"{tmp_path}/words")
    table = spark.read.parquet(f"{tmp_path}/words")
    for found in (spelling.near_pairs(table), spelling.group(table)):
        assert found.count() > 0
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_chains_of_forms(spark):
    chain = ["aaaaaaa" + "b" * i for i in range(6)]
    words = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(chain)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.group(words).collect()}
    assert got == {w: (chain[i + 1] if i < 5 else None, chain[5]) for i, w in enumerate(chain)}
    assert spelling.group(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group(words, ratio=1)


def test_op12_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    stems = ["attention", "Attention", "ÀTTENTION", "straßenbahn", "élément", "éléments", "receive", "recieve", "abcdefg", "abcdefgh", "naïveté×÷", "x" * 3000]
    texts = [None, "", "?? 12"]
    for _ in range(250):
        some = [rng.choice(stems) for _ in range(rng.randrange(1, 60))]
        texts.append(rng.choice([" ", ", ", "1", "_"]).join(some))
    docs = spark.createDataFrame([*rows_of(texts), (5, texts[5], None, "x", "y", 1), (5, texts[5], None, "x", "y", 1)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in [*enumerate(texts), (5, texts[5]), (5, texts[5])]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.op12_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == brute_groups(counts) and len(got) > 15


def brute_path(scores, penalty):
    value, back = scores[0].astype(float), []
    for row in scores[1:]:
        top = int(value.argmax())
        stays = value >= value[top] - penalty
        back.append((top, stays))
        value = np.where(stays, value, value[top] - penalty) + row
    label = [int(value.argmax())]
    for top, stays in back[::-1]:
        label.append(label[-1] if stays[label[-1]] else top)
    return label[::-1]


@pytest.mark.parametrize("few", [1, 3, 24])
def test_paths_of_many_texts_at_once(monkeypatch, few):
    monkeypatch.setattr(language, "FEW", few)
    rng = np.random.default_rng(few)
    for _ in range(40):
        number = rng.integers(0, 40, rng.integers(1, 60))
        number[rng.integers(len(number))] = rng.choice([0, 300])
        k = int(rng.integers(1, 5))
        scores = rng.normal(0, 2, (int(number.sum()), k)).astype(np.float32)
        got, at = language.path(scores, number, 3.0), 0
        for m in number.tolist():
            if m:
                assert got[at : at + m].tolist() == brute_path(scores[at : at + m], 3.0)
            at += m


SYLLABLES = {"en": "th er ing on and", "fr": "eau ou ille ez que", "ru": "про ста вый не го", "el": "και του ας ιν μος"}


def texts_in(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_op13_languages(spark, tmp_path):
    rng = random.Random(13)
    langs = [rng.choice(["en", "fr", "ru", "el"]) for _ in range(400)]
    texts = [texts_in(x, rng, rng.randrange(4, 60)) for x in langs]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400)]
    odd = [(1000, None), (1001, ""), (1002, "12 -- ́ 7"), (1003, "日本語"), (1004, "x"), (1004, "x"), (None, "thering " * 9), (1005, "ther " * 200_000)]
    docs = spark.createDataFrame([*rows_of(texts, langs), *[(i, t, None, "x", "y", 1) for i, t in odd]], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_language_id(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 400 + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(got[i]["held_out"] == held[i] for i in range(400))
    assert sum(got[i]["lang_pred"] == langs[i] for i in range(400) if held[i]) >= 0.98 * sum(held)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003]["lang_pred"] in langs and got[None]["lang_pred"] == got[1005]["lang_pred"] == "en" and got[None]["held_out"] is False
    # nothing but texts enters a prediction
    mixed = docs.select((F.col("doc_id") * 4).alias("doc_id"), "text", F.lit("ru").alias("lang"), F.lit("z").alias("runs"))
    model = language.fit(docs)
    a = {r["doc_id"] * 4: (r["lang"], r["score"]) for r in language.identify(docs.where("doc_id is not null"), model).collect()}
    assert a == {r["doc_id"]: (r["lang"], r["score"]) for r in language.identify(mixed.where("doc_id is not null"), model).collect()}


def test_spans_of_mixed_texts(spark):
    rng = random.Random(14)
    langs = [rng.choice(["en", "fr", "ru", "el"]) for _ in range(200)]
    model = language.fit(spark.createDataFrame(rows_of([texts_in(x, rng, 40) for x in langs], langs), DOCS))
    parts = [texts_in(x, rng, 12) for x in ("en", "ru", "fr")]
    whole = "«é» ".join(parts)
    got = language.spans(spark.createDataFrame(rows_of([None, "", "1 2", whole]), DOCS), model).orderBy("doc_id").collect()
    assert [r["spans"] for r in got[:3]] == [[], [], []]
    assert [s["lang"] for s in got[3]["spans"]] == ["en", "ru", "fr"]
    starts = [whole.index(p) for p in parts]
    for s, p, at in zip(got[3]["spans"], parts, starts, strict=True):
        assert abs(s["start"] - at) <= 4 and abs(s["end"] - at - len(p)) <= 4
    assert {r["lang"] for r in language.identify(spark.createDataFrame(rows_of([whole]), DOCS), None).collect()} == {"und"}
    assert language.fit(spark.createDataFrame([], DOCS)) is None and language.identify(spark.createDataFrame([], DOCS), model).count() == 0


def test_scripts_of_bytes_equal_those_of_characters():
    rng = random.Random(15)
    table = language.script_table()
    import pyarrow as pa

    from gazeframe.llm.grams import raw

    for _ in range(200):
        texts = ["".join(rng.choice("ab1 éßяж日本語かな한́̈अक\U00020000\U0001f600") for _ in range(rng.randrange(12))) for _ in range(5)]
        want = []
        for t in texts:
            last = 0
            for c in t:
                last = last if table[ord(c)] == language.MARK else int(table[ord(c)])
                want += [last] * len(c.encode())
        assert language._scripts(*raw(pa.array(texts))).tolist() == want if any(texts) else True
