"""Tasks that are done once: a manifest of what each was made from and what it left behind.

A task is pending unless the manifest has its inputs as they are now (paths, lengths and times of change) and all the files it
left still have the lengths noted there. The manifest is a Parquet folder with one partition a batch; a batch that runs again
replaces its own rows. Nothing of the files' contents is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "task_id string, fingerprint long, outputs array<struct<path:string,length:long>>, batch long"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, changed) of the files below a folder whose names fit; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "path string, length long, changed timestamp")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("changed"))


def tasks(inputs: DataFrame, task_id) -> DataFrame:
    """(task_id, fingerprint, inputs) from ``inputs`` (of ``files``); ``task_id`` is a column of them. The fingerprint depends on no order."""
    seen = F.struct("path", "length", "changed")
    rows = inputs.groupBy(task_id.alias("task_id")).agg(F.array_sort(F.collect_list(seen)).alias("inputs"))
    return rows.select("task_id", F.xxhash64("inputs").alias("fingerprint"), F.transform("inputs", lambda x: x["path"]).alias("inputs"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, empty if there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)


def pending(wanted: DataFrame, manifest: DataFrame, there: DataFrame) -> DataFrame:
    """The tasks of ``wanted`` (task_id, fingerprint) that are new, changed, or lack an output; ``there``: files (path, length) of the output folder."""
    newest = manifest.groupBy("task_id").agg(F.max_by(F.struct("fingerprint", "outputs"), "batch").alias("x")).select("task_id", "x.*")
    left = newest.select("task_id", F.explode("outputs").alias("o")).select("task_id", "o.path", "o.length")
    broken = left.join(there.select("path", F.col("length").alias("now")), "path", "left").where("now is null or now <> length").select("task_id").distinct()
    good = newest.join(broken, "task_id", "left_anti").select("task_id", "fingerprint")
    return wanted.join(good, ["task_id", "fingerprint"], "left_anti")


def run(wanted: DataFrame, manifest_path: str, output_path: str, work: Callable[[DataFrame], DataFrame], batch: int) -> int:
    """Does the pending tasks of ``wanted`` and notes them as one batch; returns their number.

    ``work`` takes the tasks, writes their files before it returns, and gives back (task_id, path) of each.
    """
    spark = wanted.sparkSession
    todo = pending(wanted, read(spark, manifest_path), files(spark, output_path)).select("task_id", "fingerprint")
    # as a table, since what is pending changes with the work; readers of the manifest pass over its name
    todo.write.mode("overwrite").parquet(f"{manifest_path}/_pending/{batch}")
    todo = spark.read.schema(todo.schema).parquet(f"{manifest_path}/_pending/{batch}")
    count = todo.count()
    if not count:
        return 0
    made = work(todo)
    left = made.select("task_id", "path").join(files(spark, output_path).select("path", "length"), "path", "left")
    noted = left.groupBy("task_id").agg(F.array_sort(F.collect_set(F.struct("path", "length"))).alias("outputs"))
    rows = todo.join(noted, "task_id")
    rows.select("task_id", "fingerprint", "outputs").write.mode("overwrite").parquet(f"{manifest_path}/batch={batch}")
    return count


def follow(stream: DataFrame, manifest_path: str, output_path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """``run`` for each batch of a stream (task_id, fingerprint) until what is there now is done; a batch that is repeated replaces its rows."""

    def one(part: DataFrame, number: int) -> None:
        run(part, manifest_path, output_path, work, number)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
