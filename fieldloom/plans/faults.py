"""Queries on faulty readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.operators import spikes
from fieldloom.plans.registry import query


@query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.match_faults(spark.read.parquet(f"{folder}/path_entries.parquet"))
