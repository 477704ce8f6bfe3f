"""N-gram Jaccard join and embedding join against all pairs."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeframe.llm import embedding_join, jaccard
from gazeframe.llm.common import components
from gazeframe.llm.grams import gram_sets


def roots(ids, linked):
    label = dict.fromkeys(ids)
    for i in ids:
        label[i] = i
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            lo = min(label[a], label[b])
            if label[a] != lo or label[b] != lo:
                label[a] = label[b] = lo
                changed = True
    return label


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def expected(docs):
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    linked = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return roots([i for i, _ in sets], linked)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(500)]
    shared = [rng.choice(words) for _ in range(30)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(n // 6)]
    docs = []
    for i in range(n):
        text = list(rng.choice(base)) if i % 2 else [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        if i % 5 == 0:
            text += shared
        docs.append((i, rng.choice([" ", "\n", "  \t"]).join(text).replace("v1", rng.choice(["v1", "V1"]))))
    return docs


@pytest.mark.parametrize("block", [4, 256])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard.class_links, "__defaults__", (block,))
    docs = corpus(block, 240) + [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "One  two"), (905, "é É"), (906, "é é"), (907, "w " * 40_000), (3, "another text of row three here"), (None, "one two")]
    docs += [docs[11]]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, print int, gram int, component_id string").repartition(5)
    got = jaccard.join(df).collect()
    want = expected(docs)
    assert len(got) == len(docs)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted((i or -1, len(shingles(t))) for i, t in docs)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_jaccard_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(df).count() == 0
    assert jaccard.join(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_sets_match_python():
    import pyarrow as pa

    texts = [t for _, t in corpus(1, 60)] + [None, "", "a b c d e f", "é ü\x0bß  x y z"]
    _, sizes = gram_sets(pa.array(texts))
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    _, alone = gram_sets(pa.array(texts).slice(7, 5))
    assert alone.tolist() == sizes[7:12].tolist()


def test_prefix_bound():
    for percent in (50, 80, 90, 100):
        for n in range(1, 200):
            p, k = jaccard.prefix(n, percent)
            assert 1 <= p <= n and 1 <= k and p + k - 1 <= n
            assert jaccard.prefix(n + 1, percent)[1] >= k


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (None, 3), (5, 9), (9, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("size", [40, 1024])
def test_embeddings(spark, size):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(12, size=400)] + rng.normal(size=(400, 16)) * rng.choice([0.05, 0.3, 1.0], size=(400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] + [1.0] * 15), (1005, [float("inf")] + [1.0] * 15), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, x[0].tolist()), (1008, (x[0] * 1e-30).tolist()), (1009, (x[0] * 1e30).tolist())]
    df = spark.createDataFrame([(i, v, 0, "y") for i, v in rows], "vec_id long, embedding array<double>, label int, x string")
    got = embedding_join.join(df, 0.9, size).collect()
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    linked = [(i, j) for i in good for j in good if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9]
    label = roots([i for i, _ in rows if i is not None], linked)
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            assert r["n_links"] == sum(r["vec_id"] in e for e in linked)
            assert (r["component_id"], r["kept"]) == (label[r["vec_id"]], label[r["vec_id"]] == r["vec_id"])


def test_embeddings_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_join.join(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert embedding_join.join(df.limit(0)).count() == 0
    assert embedding_join.join(df.selectExpr("vec_id", "cast(null as array<double>) as embedding")).where("kept").count() == 3


def thue_morse(k):
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_cheat_polynomials_are_different(spark):
    x = thue_morse(10)
    y = x.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"w1 {x} w2 w3 w4"), (2, f"w1 {y} w2 w3 w4"), (3, f"w1 {x} w2 w3 w4")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.join(docs).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_large_cluster_with_stragglers(spark, monkeypatch):
    """Two large groups and a chain between sizes, all in one candidate cluster, in blocks of a few sets."""
    monkeypatch.setattr(jaccard.class_links, "__defaults__", (8,))
    rng = random.Random(2)
    base = [f"k{k}" for k in range(120)]
    docs = []
    for i in range(150):
        text = list(base) if i < 60 else [*base[:60], *(f"z{k}" for k in range(60))] if i < 120 else base[: 40 + i - 120] + [f"q{i}x{k}" for k in range(60)]
        text[rng.randrange(len(text))] = f"r{i}"
        docs.append((i, " ".join(text)))
    docs += [(200 + k, " ".join(base[: 120 - 8 * k])) for k in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == expected(docs)


def test_embedding_jobs_are_spread_and_pruned(spark):
    """Vectors around far centres: most pairs of intervals are provably distant, and the others are dealt to several tasks."""
    rng = np.random.default_rng(3)
    centres = np.eye(12)[:, :12] * 3
    x = centres[np.arange(3000) % 12] + rng.normal(size=(3000, 12)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    eps = float(np.sqrt(0.2))
    turn = spark.sparkContext.broadcast(embedding_join.axes(df, 12))
    kept, _ = embedding_join.points(embedding_join.placed(df, turn, eps))
    cuts = embedding_join.intervals(kept, turn, 50)
    n = cuts.count()
    pairs = embedding_join.interval_pairs(cuts, embedding_join._dims(turn), eps)
    assert n >= 60 and pairs.count() < 0.25 * n * (n + 1) / 2
    found = embedding_join.interval_links(cuts, pairs, 0.9, eps)
    assert found.selectExpr("input_file_name() as f").distinct().count() > 1
    links = {r["id"]: r["n"] for r in found.groupBy("id").sum("links").withColumnRenamed("sum(links)", "n").collect()}
    assert links == {i: 249 for i in range(3000)}


def test_embeddings_of_many_lengths_and_copies(spark):
    rng = np.random.default_rng(9)
    long = rng.normal(size=3000)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(100, long.tolist()), (101, (long + 0.1).tolist()), (102, [5.0]), (103, [7.0]), (104, [-1.0]), (5, [3.0, 2.0, -1.0])]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(i, 39, 0) for i in range(40)} | {(100, 1, 100), (101, 1, 100), (102, 1, 102), (103, 1, 102), (104, 0, 104)}


def test_first_grams_travel_in_packets(spark, monkeypatch):
    """No row for each n-gram, nor the sets themselves, goes through a shuffle before clusters are known; blocks of any size find the same classes."""
    docs = corpus(9, 200) + [(7, "one two three four five six"), (None, "one two three four five six")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    prints, full = jaccard.fingerprints(df)
    classes = prints.where("doc_id is not null and n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("size"))
    found = {}
    for held in (1 << 21, 40):
        monkeypatch.setattr(jaccard, "HELD_GRAMS", held)
        got = jaccard.likely(df, classes, full, 5, 80)
        assert "hashpartitioning(gram" not in got._jdf.queryExecution().executedPlan().toString()
        found[held] = {r["print"] for r in got.collect()}
    sets = jaccard.class_sets(df, classes, 5)
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    grams = {r["print"]: np.frombuffer(r["grams"], np.uint64) for r in sets.collect()}
    rank, want = jaccard._ranks(full), set()
    first = {x: set(jaccard._smallest(jaccard._keys(g, rank), sum(jaccard.prefix(len(g), 80)) - 1).tolist()) for x, g in grams.items()}
    for x, own in first.items():
        least = jaccard.required(len(grams[x]), 80)
        if sum(any(g in o for y, o in first.items() if y != x) for g in own) >= jaccard.prefix(least, 80)[1]:
            want.add(x)
    assert found[40] == found[1 << 21] == want and 0 < len(want) < len(grams)


def test_packets_and_blocks_that_are_not_whole():
    rng = np.random.default_rng(1)
    cells, who = np.sort(rng.integers(0, 1 << 28, 9000).astype(np.uint32)), rng.integers(0, 1 << 16, 9000).astype(np.uint16)
    packet = jaccard._packet(cells, who)
    assert all((a == b).all() for a, b in zip(jaccard._unpacked(packet), (cells, who), strict=True)) and len(packet) < 5 * 9000
    keys = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    rows = jaccard._packets(np.concatenate([keys, keys[:100]]), np.repeat(np.arange(2, dtype=np.uint16), [500, 100]), np.array([11, 22]), 7)
    order = np.argsort(rows.column(0).to_numpy(), kind="stable")
    answers = list(jaccard._answers(iter([rows.take(order)])))
    assert {(r["print"], r["n"]) for b in jaccard._counted(iter(answers)) for r in b.to_pylist()} == {(11, 100), (22, 100)}
    with pytest.raises(RuntimeError, match="not whole"):
        list(jaccard._counted(iter(answers[:-1])))
