"""Sample-specific strings as text: lines keep their place in the file over all of its splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from svloom.operators import labels as lb


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line_no, text): split is the first byte of the input split that a line belongs to, line_no ascends within it."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line_no, read_id, contig, start_pos, end_pos) of a raw file, in which only the first line of a read bears its name."""
    return lb.sfs_tuples(lb.fill_names(read_lines(spark, path)))
