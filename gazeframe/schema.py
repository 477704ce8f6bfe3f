"""Column sets, label constants and thresholds of the annotation study."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The columns of annotation files, by name.
ANNOTATION_COLUMNS = ["clip", "frame", "person_id", "bbox_x", "bbox_y", "bbox_width", "bbox_height", "gaze_class", "gaze_x", "gaze_y", "is_child"]
ANNOTATION_TYPES = {"clip": "string", "frame": "int", "person_id": "int", "gaze_class": "string", "is_child": "int"}

# Results must equal published ones.
LABELS = ["focused", "mix", "others"]
FIVE_TO_THREE = {
    "focused_attention": "focused",
    "mixed_attention": "mix",
    "exploratory_attention": "mix",
    "occluded_attention": "others",
    "reduced_visual_availability": "others",
}
DESCRIPTIONS = {
    "focused": "The child shows stable, sustained visual attention on a target with minimal gaze shifts.",
    "mix": "The child actively switches gaze or scans across multiple targets, including mixed stable-plus-shifting and purely exploratory patterns.",
    "others": "Gaze is not reliably usable because of occlusion, extended eye closure, or the child being off-frame.",
}
SHIFT_PIXELS = 60.0
MOTION_SCALE = 300.0
STABILITY_WEIGHTS = (0.45, 0.25, 0.15, 0.15)
GATE = {"visible": 0.5, "occlusion_streak": 30, "eyes_closed": 0.3}
LAGGED_CLIPS = [
    "smwfiZd8HLc_7508-8408-downsampled",
    "smwfiZd8HLc_10346-12974-downsampled",
    "smwfiZd8HLc_16176-16586-downsampled",
    "smwfiZd8HLc_20322-20668-downsampled",
    "31lG75MDwSA_2857-2928",
    "31lG75MDwSA_3180-3306",
    "31lG75MDwSA_4686-4764",
    "EuYseDl2jm8_1869-2033",
    "EuYseDl2jm8_3680-3791",
]

# The thresholds and confidences of the rule, in the order of its tests.
RULE = {"eyes_closed": (0.3, 0.72), "occlusion": (0.35, 0.74), "steady": (0.75, 0.1, 120, 0.65, 0.84), "moving": (0.2, 180, 0.80), "rest": 0.68}

# The fourteen model features, in their order.
MODEL_FEATURES = [
    "observed_frames",
    "visible_ratio",
    "on_screen_ratio",
    "gaze_shift_ratio",
    "occlusion_ratio",
    "eyes_closed_ratio",
    "mean_head_area",
    "mean_head_motion",
    "mean_gaze_motion",
    "visible_gaze_fraction",
    "gaze_shift_events",
    "max_visible_streak",
    "max_occlusion_streak",
    "attention_stability_score",
]


def label_order(label: Column) -> Column:
    """1, 2, 3 in the order of the labels."""
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), label)
