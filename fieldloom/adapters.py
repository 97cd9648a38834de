"""Inputs of the operators from the test tables, each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import pose as P


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observation frames without their copies; roles in lower case."""
    return (
        table(spark, folder, "frames")
        .select("frame_id", "video_id", "timestamp_us", F.lower(F.trim("role")).alias("role"), "enabled", "reason", "points")
        .dropDuplicates(["frame_id"])
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    """The points of the observation frames, with their place in the list; a null confidence counts as 1."""
    return opened(observations(spark, folder))


def opened(frames: DataFrame) -> DataFrame:
    """The points of frames, one row each."""
    rows = frames.select("frame_id", "video_id", "role", "enabled", F.posexplode("points").alias("pos", "p"))
    return rows.select(
        "frame_id", "video_id", "role", "enabled", "pos", F.col("p.grid_col").cast("double").alias("col"), F.col("p.grid_row").cast("double").alias("row"),
        F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.coalesce("p.confidence", F.lit(1.0)).alias("w"),
    )


OBSERVATIONS = """obs AS (
    SELECT frame_id, any_value(video_id) AS video_id, any_value(timestamp_us) AS timestamp_us, any_value(lower(trim(role))) AS role,
           any_value(enabled) AS enabled, any_value(reason) AS reason, any_value(points) AS points
    FROM frames GROUP BY frame_id),
pts AS (
    SELECT frame_id, video_id, role, enabled, i - 1 AS pos, p.grid_col::DOUBLE AS col, p.grid_row::DOUBLE AS row, p.x AS x, p.y AS y,
           coalesce(p.confidence, 1.0::DOUBLE) AS w
    FROM (SELECT *, unnest(points) AS p, generate_subscripts(points, 1) AS i FROM obs))"""


def path(spark: SparkSession, folder: str) -> DataFrame:
    """The tracked path: the last result of every frame; the pose is null unless finite and within 1e7 px."""
    m = F.col("incremental_match")
    p = m["pose"]
    ok = P.valid(p) & (F.abs(p["x"]) < 1e7) & (F.abs(p["y"]) < 1e7)
    s = F.col("sharpness")
    rows = table(spark, folder, "path_entries").select(
        "video_id", "frame", "entry_no", "timestamp_us", F.when(ok, P.pose(p["x"], p["y"], p["rotation"])).alias("pose"),
        F.when(P.finite(s) & (s >= 0), s).alias("sharpness"), "success",
        F.struct(m["frame"].alias("matched"), m["accepted"].alias("accepted"), m["reason"].alias("reason"), m["score"].alias("score")).alias("match"),
    )
    last = F.max_by(F.struct("pose", "success", "timestamp_us", "match"), "entry_no").alias("last")
    held = rows.groupBy("video_id", "frame").agg(last, F.max("sharpness").alias("sharpness"))
    return held.select(
        "video_id", "frame", F.col("last.timestamp_us").alias("timestamp_us"), F.col("last.pose.x").alias("x"), F.col("last.pose.y").alias("y"),
        F.col("last.pose.rotation").alias("rotation"), "sharpness", (1 + F.col("frame") % 20).cast("double").alias("points"), F.col("last.success").alias("success"),
        F.col("last.match.matched").alias("matched"), F.col("last.match.accepted").alias("accepted"), F.col("last.match.reason").alias("reason"),
        F.col("last.match.score").alias("score"),
    )


PATH = """raw AS (
    SELECT video_id, frame, entry_no, timestamp_us, incremental_match.pose.x AS x, incremental_match.pose.y AS y, incremental_match.pose.rotation AS rotation,
           CASE WHEN isfinite(sharpness) AND sharpness >= 0 THEN sharpness END AS sharpness, success, incremental_match.frame AS matched,
           incremental_match.accepted AS accepted, incremental_match.reason AS reason, incremental_match.score AS score
    FROM path_entries),
ok AS (SELECT *, coalesce(isfinite(x) AND isfinite(y) AND isfinite(rotation) AND abs(x) < 1e7 AND abs(y) < 1e7, false) AS good FROM raw),
held AS (
    SELECT video_id, frame, max(sharpness) AS sharpness,
           arg_max({'x': CASE WHEN good THEN x END, 'y': CASE WHEN good THEN y END, 'rotation': CASE WHEN good THEN rotation END, 'success': success,
                    't': timestamp_us, 'matched': matched, 'accepted': accepted, 'reason': reason, 'score': score}, entry_no) AS l
    FROM ok GROUP BY video_id, frame),
path AS (
    SELECT video_id, frame, l.t AS timestamp_us, l.x AS x, l.y AS y, l.rotation AS rotation, sharpness, (1 + frame % 20)::DOUBLE AS points,
           l.success AS success, l.matched AS matched, l.accepted AS accepted, l.reason AS reason, l.score AS score
    FROM held)"""


def sky(spark: SparkSession, folder: str) -> DataFrame:
    """A path over one wide plane, from the events table."""
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        e.alias("frame"), F.col("user_id").alias("track"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"),
        ((e * 37) % 4000).cast("double").alias("x"), ((e * 91) % 3000).cast("double").alias("y"), (((e * 7919) % 6283) / 1000.0 - 3.1415).alias("rotation"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("sharpness"), (1 + e % 20).cast("double").alias("points"),
        (F.col("event_type") != "error").alias("success"), F.col("event_type").alias("kind"),
    )


SKY = """sky AS (
    SELECT event_id AS frame, user_id AS track, epoch_us(ts) AS timestamp_us, ((event_id * 37) % 4000)::DOUBLE AS x, ((event_id * 91) % 3000)::DOUBLE AS y,
           ((event_id * 7919) % 6283) / 1000.0::DOUBLE - 3.1415::DOUBLE AS rotation, CASE WHEN event_type <> 'error' THEN value END AS sharpness,
           (1 + event_id % 20)::DOUBLE AS points, event_type <> 'error' AS success, event_type AS kind
    FROM events)"""


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Small gray images of 8 by 8 pixels in 0..255, from the embeddings."""
    v = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * e.cast("double") + 0.5).cast("int"))))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("image"), F.col("label").alias("source"), v.alias("gray"))


PIXELS = """pixels AS (
    SELECT vec_id AS image, label AS source,
           list_transform(embedding, lambda e: least(255, greatest(0, floor(128 + 400 * e::DOUBLE + 0.5)::INT))) AS gray
    FROM embeddings)"""


def rounded(df: DataFrame, digits: int = 4, shift: float = 0.0) -> DataFrame:
    """Doubles rounded for comparison, without negative zeros; angles to seven digits.

    With a ``shift``, so much of the last place is added first, as sums that end on a half may fall to either side.
    """

    def place(c: str) -> int:
        return 7 if c in ("rotation", "theta") else digits

    return df.select(*[
        (F.round(F.col(c) + shift * 10.0 ** -place(c), place(c)) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])


def sql_rounded(value: str, digits: int = 4, shift: float = 0.123) -> str:
    return f"round({value} + {shift * 10.0 ** -digits:.12f}::DOUBLE, {digits}) + 0.0"
