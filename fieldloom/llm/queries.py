"""The queries of the training-data operators, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import groups, mixing, overlap, subjects, subset, tokenizer, topn

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.frame_groups(_table(spark, folder, "path_entries"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = topn.top_frames_per_cell(_table(spark, folder, "path_entries"), n=4)
    return found.select("video_id", "cell_col", "cell_row", "frame")


def p1_subset(spark: SparkSession, folder: str) -> DataFrame:
    return subset.varied_frames(_table(spark, folder, "frames"), size=2000)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.frame_pairs(_table(spark, folder, "frames"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, folder, "frames"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer.tokenizer_path(TOKENIZER)
    return tokenizer.encode_texts(_table(spark, folder, "documents"), "doc_id", "text", path)


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    return mixing.Mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"), tokenizer.tokenizer_path(TOKENIZER), block=256)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).blocks()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = subjects.subject_areas(_table(spark, folder, "documents"), _table(spark, folder, "area_labels"), "doc_id", "text")
    return found.select("doc_id", "area")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_subset": p1_subset,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p5_found": p5_found,
        "p5_report": p5_report,
        "p6_ids": p6_ids,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p8_found": p8_found,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            WITH f AS (
                SELECT video_id, cell_col, cell_row, frame,
                       max(CASE WHEN sharpness >= 0 AND isfinite(sharpness) THEN sharpness END) AS s
                FROM path_entries WHERE cell_col IS NOT NULL AND cell_row IS NOT NULL
                GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY video_id, cell_col, cell_row
                                               ORDER BY s DESC NULLS LAST, frame) AS place FROM f)
            SELECT video_id, cell_col, cell_row, frame FROM r WHERE place <= 4""",
        "p2_found": """
            WITH RECURSIVE rec AS (SELECT DISTINCT video_id, frame FROM path_entries),
            e AS (SELECT DISTINCT p.video_id, p.frame AS a, r.frame AS b
                  FROM path_entries p JOIN rec r
                    ON r.video_id = p.video_id AND r.frame = p.incremental_match.frame
                  WHERE p.incremental_match.accepted AND p.frame <> r.frame),
            n AS (SELECT video_id, a, b FROM e UNION SELECT video_id, b, a FROM e),
            w(video_id, frame, label) USING KEY (video_id, frame) AS (
                SELECT DISTINCT video_id, a, a FROM n
                UNION
                SELECT w.video_id, n.b, min(w.label)
                FROM w JOIN n ON n.video_id = w.video_id AND n.a = w.frame
                       JOIN recurring.w AS k ON k.video_id = n.video_id AND k.frame = n.b
                WHERE w.label < k.label
                GROUP BY w.video_id, n.b)
            SELECT video_id, label AS group_frame, frame FROM w""",
    }
