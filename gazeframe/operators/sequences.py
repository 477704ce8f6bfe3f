"""Per-sequence analytics over frames: features, segments, interactions. One exchange by child_id feeds all of it.

Sequences are kept flat. A frame row has child_id, frame, bbox_x/y/width/height, gaze_class, gaze_x/y (and fps for
segments); rows are ordered by frame, and neighbours are neighbouring rows, whatever frames are missing in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.schema import LAGGED_CLIPS, MOTION_SCALE, SHIFT_PIXELS, STABILITY_WEIGHTS


def _order():
    """Rows of a sequence by frame; made when it is used, as it needs a session."""
    return Window.partitionBy("child_id").orderBy("frame")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def children(frames: DataFrame) -> DataFrame:
    """Rows of children only; the filter reaches the scan."""
    return frames.where("is_child = 1")


def duplicate_frames(frames: DataFrame) -> DataFrame:
    """(child_id, frame, n) that occur more than once, which sequences must not have."""
    return frames.groupBy("child_id", "frame").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _is(*classes: str) -> Column:
    return F.coalesce(F.col("gaze_class").isin(*classes), F.lit(False))


def _streak(mask: Column) -> Column:
    """Rows since the mask was last false, at a row where it is true; 0 elsewhere."""
    return F.when(mask, F.col("_n") - F.coalesce(F.max(F.when(~mask, F.col("_n"))).over(_so_far()), F.lit(0))).otherwise(0)


def stability(visible: Column, streak: Column, motion: Column, shift: Column, weights: tuple = STABILITY_WEIGHTS) -> Column:
    """Weighted sum of the four components, clipped to [0, 1]. streak: as a share of the frames."""
    w = [x if isinstance(x, Column) else F.lit(float(x)) for x in weights]
    total = w[0] * visible + w[1] * streak + w[2] * (F.lit(1.0) - F.least(motion / F.lit(MOTION_SCALE), F.lit(1.0))) + w[3] * (F.lit(1.0) - shift)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def enriched(frames: DataFrame) -> DataFrame:
    """Frames with row numbers, steps of head and gaze, and running streaks."""
    visible, hidden = _is("inside_visible"), _is("inside_occluded", "inside_uncertain")
    cx, cy = F.col("bbox_x") + F.col("bbox_width") / 2, F.col("bbox_y") + F.col("bbox_height") / 2
    seen = F.last(F.when(visible, F.struct("gaze_x", "gaze_y")), ignorenulls=True).over(_before())
    by_class = Window.partitionBy("child_id", "gaze_class")
    return (
        frames.withColumn("_n", F.row_number().over(_order()))
        .withColumn("_cx", cx)
        .withColumn("_cy", cy)
        .withColumn("_seen", seen)
        .withColumn("_head_step", distance(F.col("_cx") - F.lag("_cx").over(_order()), F.col("_cy") - F.lag("_cy").over(_order())))
        .withColumn("_gaze_step", F.when(visible, distance(F.col("gaze_x") - F.col("_seen.gaze_x"), F.col("gaze_y") - F.col("_seen.gaze_y"))))
        .withColumn("_visible", visible)
        .withColumn("_hidden", hidden)
        .withColumn("_visible_streak", _streak(visible))
        .withColumn("_hidden_streak", _streak(hidden))
        .withColumn("_class_n", F.count(F.lit(1)).over(by_class))
        .withColumn("_class_first", F.min("_n").over(by_class))
    )


def features(frames: DataFrame) -> DataFrame:
    """One row for each child_id with all behavioural features."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return (
        enriched(frames)
        .groupBy("child_id")
        .agg(
            F.count(F.lit(1)).alias("observed_frames"),
            share(F.col("_visible")).alias("visible_ratio"),
            share(F.col("_visible") | F.col("_hidden")).alias("on_screen_ratio"),
            share(_is("gaze_shift")).alias("gaze_shift_ratio"),
            F.count_if(_is("gaze_shift")).alias("gaze_shift_events"),
            share(F.col("_hidden")).alias("occlusion_ratio"),
            share(_is("eyes_closed")).alias("eyes_closed_ratio"),
            F.avg(F.col("bbox_width") * F.col("bbox_height")).alias("mean_head_area"),
            F.coalesce(F.avg("_head_step"), F.lit(0.0)).alias("mean_head_motion"),
            F.coalesce(F.avg("_gaze_step"), F.lit(0.0)).alias("mean_gaze_motion"),
            F.max("_visible_streak").cast("long").alias("max_visible_streak"),
            F.max("_hidden_streak").cast("long").alias("max_occlusion_streak"),
            F.max_by("gaze_class", F.struct("_class_n", -F.col("_class_first"))).alias("dominant_gaze_class"),
        )
        .withColumn("visible_gaze_fraction", F.col("visible_ratio"))
        .withColumn(
            "attention_stability_score",
            stability(F.col("visible_ratio"), F.col("max_visible_streak") / F.col("observed_frames"), F.col("mean_gaze_motion"), F.col("gaze_shift_ratio")),
        )
    )


def segment_types(frames: DataFrame) -> DataFrame:
    """Frames with their segment type; a visible frame is a shift if the row before is visible and the gaze jumped."""
    before = F.lag(F.struct("gaze_class", "gaze_x", "gaze_y")).over(_order())
    jump = (F.col("_b.gaze_class") == "inside_visible") & (distance(F.col("gaze_x") - F.col("_b.gaze_x"), F.col("gaze_y") - F.col("_b.gaze_y")) >= SHIFT_PIXELS)
    kind = (
        F.when(_is("inside_occluded", "inside_uncertain"), "occluded")
        .when(_is("outside_frame"), "outside")
        .when(_is("eyes_closed"), "eyes_closed")
        .when(_is("gaze_shift"), "shift")
        .when(_is("inside_visible"), F.when(F.coalesce(jump, F.lit(False)), "shift").otherwise("stable"))
        .otherwise("uncertain")
    )
    return frames.withColumn("_b", before).withColumn("segment_type", kind).drop("_b")


def segments(frames: DataFrame) -> DataFrame:
    """Maximal runs of one segment type over a sequence's rows; frames that are missing don't split a run."""
    starts = F.when(F.col("segment_type") == F.lag("segment_type").over(_order()), 0).otherwise(1)
    runs = segment_types(frames).withColumn("_starts", starts).withColumn("segment_index", (F.sum("_starts").over(_so_far()) - 1).cast("int"))
    seen = F.col("gaze_class") == "inside_visible"
    return (
        runs.groupBy("child_id", "segment_index")
        .agg(
            F.first("segment_type").alias("segment_type"),
            F.min("frame").alias("start_frame"),
            F.max("frame").alias("end_frame"),
            F.min_by("gaze_class", "frame").alias("gaze_class"),
            F.avg(F.when(seen, F.col("gaze_x"))).alias("avg_gaze_x"),
            F.avg(F.when(seen, F.col("gaze_y"))).alias("avg_gaze_y"),
            F.count(F.lit(1)).alias("frame_count"),
            F.first("fps").alias("fps"),
        )
        .withColumn("start_time", F.round((F.col("start_frame") - 1) / F.col("fps"), 4))
        .withColumn("end_time", F.round(F.col("end_frame") / F.col("fps"), 4))
        .withColumn("duration", F.round((F.col("end_frame") - F.col("start_frame") + 1) / F.col("fps"), 4))
        .drop("fps")
    )


def interactions(segs: DataFrame, least_shifts: int = 3) -> DataFrame:
    """An event for each segment, and one that spans the clip where there are ``least_shifts`` shift segments."""
    kind = (
        F.when((F.col("segment_type") == "stable") & (F.col("duration") >= 1.0), "focused_attention")
        .when(F.col("segment_type") == "shift", "attention_shift")
        .when(F.col("segment_type").isin("occluded", "outside", "eyes_closed"), "reduced_visual_availability")
        .otherwise("monitoring")
    )
    columns = ["child_id", "interaction_index", "interaction_type", "start_time", "end_time", "duration", "supporting_segments"]
    single = segs.select(
        "child_id", F.col("segment_index").alias("interaction_index"), kind.alias("interaction_type"), "start_time", "end_time", "duration", F.array("segment_index").alias("supporting_segments")
    )
    shift = F.when(F.col("segment_type") == "shift", F.col("segment_index"))
    spanning = (
        segs.groupBy("child_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("interaction_index"),
            F.min("start_time").alias("start_time"),
            F.max("end_time").alias("end_time"),
            F.array_sort(F.collect_list(shift)).alias("supporting_segments"),
        )
        .where(F.size("supporting_segments") >= least_shifts)
        .withColumn("interaction_type", F.lit("exploratory_behavior"))
        .withColumn("duration", F.round(F.col("end_time") - F.col("start_time"), 4))
    )
    return single.select(columns).unionByName(spanning.select(columns))


def payload(feats: DataFrame, segs: DataFrame, events: DataFrame) -> DataFrame:
    """Features with the numbers of segments and interactions, 0 where there are none."""
    n = lambda df, name: df.groupBy("child_id").agg(F.count(F.lit(1)).alias(name))
    joined = feats.join(n(segs, "num_segments"), "child_id", "left").join(n(events, "num_interactions"), "child_id", "left")
    return joined.fillna(0, ["num_segments", "num_interactions"])


def source_frames(frames: DataFrame) -> DataFrame:
    """Adds video_name, clip_start, clip_end, downsampled and source_frame, the clip frame's number in the source video."""
    part = lambda k: F.regexp_extract("clip", r"^(.*)_(\d+)-(\d+)(-downsampled)?$", k)
    lag = F.when(F.col("clip").isin(LAGGED_CLIPS), 1).otherwise(0)
    n = F.col("frame").cast("int")
    return (
        frames.withColumn("video_name", part(1))
        .withColumn("clip_start", part(2).cast("int"))
        .withColumn("clip_end", part(3).cast("int"))
        .withColumn("downsampled", part(4) != "")
        .withColumn("source_frame", (F.col("clip_start") + F.when(F.col("downsampled"), 2 * n).otherwise(n) - 1 - lag).cast("int"))
    )
