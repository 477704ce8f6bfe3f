"""The pipeline's stages against the operators' brute-force rules, on a small corpus."""

import os
import random
import re

import corpus_pipeline
from gazeframe.llm import common, toxicity


def make(tmp_path, spark):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 80))) for _ in range(90)]
    bench = " ".join(rng.choice(words) for _ in range(30))
    texts[10] += " " + bench
    texts[20] = texts[21]
    texts[22] = texts[21] + " extra"
    texts[30] += " password=abcdefghijklmnop12"
    rows = [(i, t + (" grumblex vilethorn" * 6 if i % 4 == 3 else ""), "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, "no id at all here", "en", "s", 17), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 3)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = corpus_pipeline.written(out, f"test-{name}")
        kept[name] = docs.collect()
    ids = {n: [r["doc_id"] for r in rs] for n, rs in kept.items()}
    assert all(not (r["text"] or "").endswith("vilethorn") for r in kept["toxicity"])
    assert {i for i in range(90) if i % 4 != 3} <= set(ids["toxicity"]) and {500, 501, None} <= set(ids["toxicity"])
    before, after = ids["toxicity"], ids["ngram_jaccard"]
    assert before.count(0) == 2 and after.count(0) == 1 and 20 in after and 21 not in after and 22 not in after
    assert set(before) - set(after) == {21, 22}
    assert set(after) - set(ids["decontamination"]) == {10}
    masked = {r["doc_id"]: r["text"] for r in kept["secrets"]}
    assert ids["secrets"] and sorted(map(str, ids["secrets"])) == sorted(map(str, ids["decontamination"])) and masked[30].endswith("[secret]")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(ids["secrets"])
    assert len(rows) == 94 and re.match("toxicity", corpus_pipeline.STAGES[0][0]) and toxicity.LEVEL == 9
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_rows_of_one_id_are_told_apart(spark):
    texts = [" ".join(f"t{k}w{j}" for j in range(30)) for k in range(5)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (2, texts[1]), (2, texts[1] + " extra"), (2, None), (2, None), (3, None), (3, texts[2]), (4, texts[2])]
    rows += [(5, texts[1]), (None, texts[3]), (None, texts[3]), (None, texts[0]), (6, texts[4])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    near = [t for i, t in left if i == 2 and t is not None]
    assert len(near) == 1 and near[0].startswith(texts[1])
    left.remove((2, near[0]))
    assert sorted(left, key=repr) == sorted([(1, texts[0]), (2, None), (3, None), (3, texts[2]), (None, texts[3]), (6, texts[4])], key=repr)


def test_columns_of_any_name_and_empty_tables(spark, tmp_path):
    """Extra columns called like the stages' own ones, repeated rows, a long text, and nothing at all."""
    names = ["made", "key", "other", "again", "gone", "_place", "component_id", "id", "stays", "dotted.name", "hits", "score", "rank"]
    long = "long text of words " * 20_000
    maps = ({"a": 1}, ({2: 3},))
    rows = [(1, "a b c d e f", *range(13), *maps), (1, "a b c d e f", *range(13), *maps), (2, "a b c d e f", *range(13), *maps), (None, None, *range(13), *maps), (3, long, *range(13), *maps)]
    kind = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names) + ", pairs map<string,int>, more struct<a:map<int,int>>"
    for case, (docs, left) in enumerate(((spark.createDataFrame(rows, kind), 3), (spark.createDataFrame([], kind), 0))):
        folder = f"{tmp_path}/{case}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            docs = corpus_pipeline.written(out, f"test-{name}")
        assert docs.count() == left
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).where("doc_tokens is null").count() == 0


def test_a_stage_leaves_only_its_table(spark, tmp_path, monkeypatch):
    """While a stage runs the disk holds its input and its own tables; in the end the last stage's table is left, and others' tables stay."""
    spark.range(20).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    theirs = common.written(spark.range(3), "theirs")
    before, seen = set(os.listdir(base)), []

    def stage(s, docs, sf_dir):
        seen.append({x.rpartition("-")[0] for x in set(os.listdir(base)) - before})
        return common.written(common.written(docs, "within"), "within").where(f"doc_id >= {len(seen)}")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage) for n in ("one", "two", "three")])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert seen == [set(), {"stage-one"}, {"stage-two"}]
    assert {x.rpartition("-")[0] for x in set(os.listdir(base)) - before} == {"stage-three"}
    assert got.count() == 17 and theirs.count() == 3
