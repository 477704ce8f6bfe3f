import json

import pytest
from pyspark.sql import functions as F

from gazeframe.operators import quality
from gazeframe.plans import queries
from gazeframe.schema import ANNOTATION_COLUMNS
from gazeframe.sources import annotations, sinks


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_columns_go_by_name(spark, tmp_path):
    row = {"clip": "c", "frame": "1", "person_id": "2", "bbox_x": "582", "bbox_y": "1.5", "bbox_width": "3", "bbox_height": "4", "gaze_class": "eyes_closed", "gaze_x": "-1", "gaze_y": "7", "is_child": "1", "more": "x"}
    put(tmp_path / "annotations/train/a.csv", [",".join(ANNOTATION_COLUMNS), ",".join(row[c] for c in ANNOTATION_COLUMNS)])
    other = [*reversed(ANNOTATION_COLUMNS), "more"]
    put(tmp_path / "annotations/train/b.csv", [",".join(other), ",".join(row[c] for c in other)])
    got = annotations.annotations(spark, f"file://{tmp_path}", "train").collect()
    assert len(got) == 2 and all((r["bbox_x"], r["gaze_y"], r["gaze_class"], r["child_id"]) == (582.0, 7.0, "eyes_closed", "c:person_2") for r in got)
    put(tmp_path / "annotations/val/c.csv", ["clip,frame", "c,1"])
    with pytest.raises(ValueError, match="lacks"):
        annotations.annotations(spark, f"file://{tmp_path}", "val")


def test_predictions_and_generations(spark, tmp_path):
    put(tmp_path / "p/ground_truth_3class.csv", ["child_id,final_3class", "a,mix"])
    put(tmp_path / "p/rule_based_3class.csv", ["child_id,true_3class,pred_3class,confidence,correct", "a,mix,mix,0.8,True"])
    put(tmp_path / "p/llm_x_3class.csv", ["child_id,pred_3class,confidence,reasoning", 'a,others,0.4,"well, so"'])
    put(tmp_path / "p/x_summary_3class.csv", ["child_id,pred_3class", "a,mix"])
    got = {r["system"]: (r["label"], r["confidence"], r["reasoning"]) for r in annotations.predictions(spark, f"file://{tmp_path}/p").collect()}
    assert got == {"rule_based": ("mix", 0.8, None), "llm_x": ("others", 0.4, "well, so")}
    put(tmp_path / "g/model-a__C1.jsonl", [json.dumps({"child_id": "a", "raw": "x"}), ""])
    (r,) = annotations.generations(spark, f"file://{tmp_path}/g").collect()
    assert (r["model"], r["condition"], r["item_id"], r["raw"]) == ("model-a", "C1", "a", "x")
    (tmp_path / "s.json").write_text(json.dumps({"C0": {"a": "p", "b": "q"}}))
    assert annotations.prompt_store(spark, f"file://{tmp_path}/s.json").count() == 2


def test_metadata_and_integrity(spark, tmp_path):
    put(tmp_path / "clips.csv", ["clip,split,video_id", "a,test,v", "b,test,w", "c,val,v"])
    put(tmp_path / "twice.csv", ["clip,split", "a,test", "a,test"])
    clips = annotations.metadata(spark, f"file://{tmp_path}/clips.csv", "clip")
    with pytest.raises(ValueError, match="more than once"):
        annotations.metadata(spark, f"file://{tmp_path}/twice.csv", "clip")
    splits = spark.createDataFrame([("a", "train"), ("b", "test")], "clip string, split string")
    videos = spark.createDataFrame([("v",)], "video_id string")
    bad = quality.integrity_violations(clips, splits, videos)
    assert sorted(map(tuple, bad.collect())) == [("no_split", "c"), ("no_video", "b"), ("split_differs", "a")]
    with pytest.raises(ValueError):
        quality.require_empty(bad, "clips")


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.write_csv(df, f"file://{tmp_path}/out", ["b", "missing"])
    r = spark.read.option("header", True).csv(f"file://{tmp_path}/out").first()
    assert (r["b"], r["missing"]) == ("x", None)
    for write in (lambda p: sinks.write_csv(df, p, ["a"]), lambda p: sinks.write_jsonl(df, p)):
        with pytest.raises(Exception, match="(?i)already exists"):
            write(f"file://{tmp_path}/out")
    sinks.write_bundle({"one": df}, f"file://{tmp_path}/bundle")
    assert spark.read.parquet(f"file://{tmp_path}/bundle/one").count() == 1


def test_whole_numbers(spark):
    rows = spark.createDataFrame([("224.0",), ("7",), (None,), ("-3",)], "frame string")
    assert [r[0] for r in rows.select(annotations._whole("frame")).collect()] == [224, 7, None, -3]
    for bad in ("1.7", "x"):
        with pytest.raises(Exception, match="whole number|CAST_INVALID"):
            spark.createDataFrame([(bad,)], "frame string").select(annotations._whole("frame")).collect()


def test_plain_csv_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'said "so", twice'), ("b", None)], "child_id string, reasoning string")
    sinks.write_csv_file(rows, f"file://{tmp_path}/one.csv")
    assert (tmp_path / "one.csv").read_text().splitlines()[0] == "child_id,reasoning" and not (tmp_path / "one.csv.parts").exists()
    back = spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/one.csv")
    assert sorted(map(tuple, back.collect())) == [("a", 'said "so", twice'), ("b", None)]
    with pytest.raises(FileExistsError):
        sinks.write_csv_file(rows, f"file://{tmp_path}/one.csv")


def test_labelled_rows(spark):
    rows = spark.createDataFrame([("\t mix\n",), ("others",), ("x",), (None,)], "label string")
    assert sorted(r[0] for r in quality.labelled(rows, "label", ["mix", "others"]).collect()) == ["mix", "others"]
    with pytest.raises(ValueError):
        quality.labelled(rows, "label", ["focused"])


def test_folders_of_parts_are_found_by_name(spark, tmp_path):
    rows = spark.range(100).selectExpr("cast(id as string) child_id", "'mix' pred_3class", "0.5 confidence").repartition(5)
    sinks.write_csv(rows, f"file://{tmp_path}/p/a_3class.csv", ["child_id", "pred_3class"])
    sinks.write_csv(rows, f"file://{tmp_path}/p/b_summary_3class.csv", ["child_id", "pred_3class"])
    sinks.write_csv(rows, f"file://{tmp_path}/p/other.csv", ["child_id", "pred_3class"])
    put(tmp_path / "p/c_3class.csv", ["child_id,pred_3class", "x,others"])
    found = annotations.predictions(spark, f"file://{tmp_path}/p")
    assert sorted((r["system"], r["n"]) for r in found.groupBy("system").agg(F.count("item_id").alias("n")).collect()) == [("a", 100), ("c", 1)]
    assert annotations.predictions(spark, f"file://{tmp_path}/p", "{x,y}_3class.csv").count() == 0


def test_discovered_files_are_in_parts(spark, tmp_path, monkeypatch):
    frame = spark.range(100).selectExpr("'rule_based' system", "id item_id", "'mix' label", "0.5D confidence").repartition(4)
    monkeypatch.setattr(queries.tables, "predictions", lambda spark, d: frame)
    monkeypatch.setattr(queries, "shared_folder", lambda spark, tag: f"file://{tmp_path}/{tag}")
    assert queries.file_discovery(spark, "").count() == 100
    assert len(list((tmp_path / "study/all_summary_3class.csv").glob("part-*"))) > 1
