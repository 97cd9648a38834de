"""Paths as movement tables and as tracking documents in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSE = "struct<x: double, y: double, rotation: double>"
#: One entry of a tracking document, in the present layout and with the columns of the old one.
ENTRY = (
    f"frame bigint, timestamp bigint, timestamp_us bigint, mode string, success boolean, reason string, sharpness struct<score: double>, raw {POSE}, pose {POSE}, "
    "x_px double, y_px double, rotation_deg double, raw_x_px double, raw_y_px double, raw_rotation_deg double, patches bigint, rms_px double"
)
DOCUMENT = f"format string, model_version int, video struct<name: string, width: int, height: int, frameCount: bigint>, path array<struct<{ENTRY.replace(' bigint', ': bigint').replace(' string', ': string').replace(' boolean', ': boolean').replace('sharpness struct', 'sharpness: struct').replace('raw struct', 'raw: struct').replace('pose struct', 'pose: struct').replace(' double', ': double').replace('::', ':')}>>"


def movement_rows(path: DataFrame) -> DataFrame:
    """The rows with a pose, angles in degrees."""
    return path.where("x IS NOT NULL").select("video_id", "frame", "timestamp_us", F.col("x").alias("x_px"), F.col("y").alias("y_px"), F.degrees("rotation").alias("rotation_deg"), F.col("points").alias("patches"))


def write_movement(path: DataFrame, folder: str) -> None:
    """A movement table per video, as CSV with a header; blanks for what is missing."""
    movement_rows(path).repartition("video_id").sortWithinPartitions("video_id", "frame").write.partitionBy("video_id").mode("overwrite").csv(folder, header=True)


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """The entries of tracking documents, one document a file.

    A document whose entries all have ``timestamp_us`` and none ``timestamp`` is of the old layout: its
    angles are degrees, and its mode is 'window'. ``file`` names the document. Entries with a negative
    frame or a pose that is not finite, and all of a frame that occurs twice, come with a ``fault``.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    old = F.forall("path", lambda e: e["timestamp_us"].isNotNull() & e["timestamp"].isNull())
    rows = docs.select("file", old.alias("old"), F.explode("path").alias("e"))
    pose = lambda x, y, r: F.when(F.col(f"e.{x}").isNotNull(), F.struct(F.col(f"e.{x}").alias("x"), F.col(f"e.{y}").alias("y"), F.radians(f"e.{r}").alias("rotation")))
    pick = lambda legacy, now: F.when(F.col("old"), legacy).otherwise(now)
    out = rows.select(
        "file", F.col("e.frame").alias("frame"), pick(F.col("e.timestamp_us"), F.col("e.timestamp")).alias("timestamp_us"),
        pick(F.lit("window"), F.col("e.mode")).alias("mode"), pick(pose("x_px", "y_px", "rotation_deg"), F.col("e.pose")).alias("pose"),
        pick(pose("raw_x_px", "raw_y_px", "raw_rotation_deg"), F.col("e.raw")).alias("raw"), F.col("e.sharpness.score").alias("sharpness"),
        F.coalesce("e.success", F.lit(True)).alias("success"),
    )
    twice = out.groupBy("file", "frame").agg((F.count("*") > 1).alias("twice"))
    wrong = F.col("pose").isNotNull() & (F.isnan("pose.x") | F.isnan("pose.y") | F.isnan("pose.rotation"))
    fault = F.when(F.col("frame").isNull() | (F.col("frame") < 0), "frame").when(F.col("twice"), "frame twice").when(wrong, "pose")
    return out.join(twice, ["file", "frame"], "left").withColumn("fault", fault).drop("twice")


def tracking_documents(path: DataFrame, video: str) -> DataFrame:
    """One JSON document per video, the entries by frame; a video is a document, so its path must fit in one row."""
    entry = F.struct("frame", F.col("timestamp_us").alias("timestamp"), F.struct(F.col("sharpness").alias("score")).alias("sharpness"),
                     F.when(F.col("x").isNotNull(), F.struct("x", "y", "rotation")).alias("pose"), "success")
    docs = path.groupBy(video).agg(F.array_sort(F.collect_list(entry)).alias("path"))
    return docs.select(video, F.to_json(F.struct(F.lit("tracking").alias("format"), F.lit(1).alias("model_version"), "path")).alias("document"))


def pattern_squares(spark: SparkSession, side: int = 100, size: int = 12) -> DataFrame:
    """The dark squares of a checkerboard of ``side`` by ``side``, with their corner in pixels."""
    cells = spark.range(side * side).select(F.floor(F.col("id") / side).alias("row"), (F.col("id") % side).alias("col"))
    return cells.where("(row + col) % 2 = 0").select("row", "col", (F.col("col") * size).alias("x"), (F.col("row") * size).alias("y"))
