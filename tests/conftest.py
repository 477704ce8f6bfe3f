import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FRAME = "child_id string, frame int, bbox_x double, bbox_y double, bbox_width double, bbox_height double, gaze_class string, gaze_x double, gaze_y double, is_child int, fps double"


@pytest.fixture(scope="session")
def frames_of(spark):
    """Frames of sequences given as {child_id: [(class, how often), ...]}; the gaze drifts by half a pixel a frame."""

    def make(sequences, fps=30.0, shuffle=False):
        rows = []
        for child, runs in sequences.items():
            classes = [c for c, n in runs for _ in range(n)]
            rows += [(child, i + 1, 0.0, 0.0, 50.0, 50.0, c, 100 + 0.5 * i, 100 + 0.5 * i, 1, fps) for i, c in enumerate(classes)]
        if shuffle:
            rows = rows[::-1]
        return spark.createDataFrame(rows, FRAME)

    return make
