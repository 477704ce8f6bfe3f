import pytest

from gazeframe.operators import labels, sequences

V, O, S, U, E, X = "inside_visible", "inside_occluded", "gaze_shift", "inside_uncertain", "eyes_closed", "outside_frame"


def by_child(df):
    return {r["child_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def feats(frames_of):
    cases = {
        "all_visible": [(V, 30)],
        "all_hidden": [(O, 20)],
        "mixed": [(V, 6), (S, 2), (O, 2)],
        "streaks": [(V, 3), (O, 1), (V, 5), (O, 2)],
        "uncertain": [(U, 10)],
        "closed": [(E, 5), (V, 5)],
        "steady": [(V, 50)],
        "covered": [(O, 50)],
    }
    return by_child(sequences.features(frames_of(cases)).withColumn("rule", labels.rule().label))


def test_ratios(feats):
    r = feats["all_visible"]
    assert (r["visible_ratio"], r["on_screen_ratio"], r["occlusion_ratio"], r["dominant_gaze_class"]) == (1, 1, 0, V)
    r = feats["all_hidden"]
    assert (r["visible_ratio"], r["occlusion_ratio"], r["max_visible_streak"], r["max_occlusion_streak"]) == (0, 1, 0, 20)
    r = feats["mixed"]
    assert (r["visible_ratio"], r["gaze_shift_ratio"], r["occlusion_ratio"]) == pytest.approx((0.6, 0.2, 0.2))
    assert (feats["streaks"]["max_visible_streak"], feats["streaks"]["max_occlusion_streak"]) == (5, 2)
    assert feats["uncertain"]["occlusion_ratio"] == 1
    r = feats["closed"]
    assert (r["eyes_closed_ratio"], r["visible_ratio"], r["on_screen_ratio"], r["dominant_gaze_class"]) == (0.5, 0.5, 0.5, E)


def test_rule(feats):
    assert feats["steady"]["rule"] == "focused" and feats["covered"]["rule"] == "others"
    assert 0 <= min(r["attention_stability_score"] for r in feats.values()) <= max(r["attention_stability_score"] for r in feats.values()) <= 1


def test_gaze_motion_bridges_hidden_rows(frames_of):
    r = by_child(sequences.features(frames_of({"a": [(V, 1), (O, 3), (V, 1)]})))["a"]
    assert r["mean_gaze_motion"] == pytest.approx(2 * 2**0.5)
    assert r["mean_head_motion"] == 0


def test_partitions_do_not_matter(frames_of):
    data = {f"c{k}": [(V, k % 5 + 1), (S, k % 3), (O, 2)] for k in range(12)}
    one = sorted(map(tuple, sequences.features(frames_of(data).coalesce(1)).collect()))
    many = sorted(map(tuple, sequences.features(frames_of(data, shuffle=True).repartition(13)).collect()))
    assert one == many


def test_segments(frames_of):
    segs = sequences.segments(frames_of({"a": [(V, 30)], "b": [(X, 3), (E, 3)]})).orderBy("child_id", "segment_index").collect()
    assert [(s["child_id"], s["segment_type"], s["frame_count"], s["duration"]) for s in segs] == [("a", "stable", 30, 1.0), ("b", "outside", 3, 0.1), ("b", "eyes_closed", 3, 0.1)]
    assert segs[1]["avg_gaze_x"] is None


def test_missing_frames_do_not_split(spark, frames_of):
    f = frames_of({"a": [(V, 10)]}).where("frame in (1, 2, 7, 8)")
    (s,) = sequences.segments(f).collect()
    assert (s["start_frame"], s["end_frame"], s["frame_count"], s["duration"]) == (1, 8, 4, round(8 / 30, 4))


def test_jump_is_a_shift(spark, frames_of):
    f = frames_of({"a": [(V, 3)]}).selectExpr("child_id", "frame", "bbox_x", "bbox_y", "bbox_width", "bbox_height", "gaze_class", "case frame when 3 then 160.5D else gaze_x end as gaze_x", "100D as gaze_y", "is_child", "fps")
    assert [s["segment_type"] for s in sequences.segments(f).orderBy("segment_index").collect()] == ["stable", "shift"]


def test_interactions(frames_of):
    data = {"long": [(V, 60)], "short": [(V, 15)], "three": [(S, 1), (V, 1), (S, 1), (V, 1), (S, 1)], "two": [(S, 1), (V, 1), (S, 1)]}
    events = sequences.interactions(sequences.segments(frames_of(data))).orderBy("child_id", "interaction_index").collect()
    kinds = {c: [e["interaction_type"] for e in events if e["child_id"] == c] for c in data}
    assert kinds["long"] == ["focused_attention"] and kinds["short"] == ["monitoring"]
    assert kinds["three"][-1] == "exploratory_behavior" and len(kinds["three"]) == 6 and "exploratory_behavior" not in kinds["two"]
    assert [e["supporting_segments"] for e in events if e["interaction_type"] == "exploratory_behavior"] == [[0, 2, 4]]


def test_empty(frames_of):
    none = frames_of({"a": [(V, 1)]}).where("false")
    assert sequences.features(none).count() == sequences.interactions(sequences.segments(none)).count() == 0


def test_source_frames(spark):
    clips = spark.createDataFrame([("vid_x_10-50", 3), ("vid_10-50-downsampled", 3), ("31lG75MDwSA_2857-2928", 1)], "clip string, frame int")
    got = sequences.source_frames(clips).collect()
    assert [(r["video_name"], r["source_frame"]) for r in got] == [("vid_x", 12), ("vid", 15), ("31lG75MDwSA", 2856)]


def test_duplicates(frames_of):
    f = frames_of({"a": [(V, 3)]})
    assert sequences.duplicate_frames(f.unionByName(f.where("frame = 2"))).collect()[0]["frame"] == 2
