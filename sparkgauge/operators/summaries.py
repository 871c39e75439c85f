"""Totals of a file: its functions and its types; empty files have zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_summary(files: DataFrame, functions: DataFrame, key: str = "file_path") -> DataFrame:
    sums = functions.groupBy(key).agg(
        F.count("*").alias("total_functions"),
        F.avg("cyclomatic").alias("avg_cyclomatic"),
        F.avg("cognitive").alias("avg_cognitive"),
        F.max("cyclomatic").alias("max_cyclomatic"),
        F.max("cognitive").alias("max_cognitive"),
        F.sum("cyclomatic").alias("total_cyclomatic"),
        F.sum("cognitive").alias("total_cognitive"),
    )
    return files.select(key).distinct().join(sums, key, "left").na.fill(0)


def cohesion_summary(cohesions: DataFrame, key: str = "file_path") -> DataFrame:
    return cohesions.groupBy(key).agg(F.count("*").alias("total_classes"), F.avg("lcom4").alias("avg_lcom4"), F.max("lcom4").alias("max_lcom4"), F.count_if(F.col("lcom4") >= 3).alias("low_classes"))
