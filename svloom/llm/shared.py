"""What the operators of this package share: the shared folder, tables in it, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset (tests on one machine), a
    temporary folder is made and kept in the session; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="svloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def release_memory() -> None:
    """Gives what was freed back to the system: a worker process serves one step after another and keeps what it once had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


class Workspace:
    """Tables of one call in a folder of their own below the shared folder.

    Writing a table cuts the lineage: a lost executor costs no more than the step that was running.
    ``drop`` removes a table that nothing reads any more. The tables that a returned DataFrame still
    reads stay until ``clear`` or until the owner of the shared folder removes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path(name)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.reread(path, df.schema)

    def reread(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._svloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._svloom_path)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reached.

    Every round lets each edge offer the smaller of its ends' labels to both ends and to both ends'
    current labels, then halves the paths by looking up each label's own label. Labels only fall, and a
    long chain needs logarithmically many rounds. Minima are combined before each shuffle, so a node
    with very many edges costs one row a task; nothing but one count a round comes to the driver.
    """
    edges = ws.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("component"))
    labels = ws.table(nodes.groupBy("node").agg(F.min("component").alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
        met = edges.join(of, "a").join(of.toDF("b", "lb"), "b")
        best = F.least("la", "lb")
        offers = met.where("la <> lb").select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), best.alias("component"))
        up = labels.select(F.col("node").alias("at"), F.col("component").alias("above"))
        shorter = labels.join(up, labels.component == up["at"]).select("node", F.col("above").alias("component"))
        kept = labels.select("node", F.col("component").alias("old"))
        new = offers.unionByName(shorter).groupBy("node").agg(F.min("component").alias("component"))
        new = kept.join(new, "node").select("node", "component", (F.col("component") < F.col("old")).alias("moved"))
        after = ws.table(new, "labels")
        ws.drop(labels)
        if after.where("moved").isEmpty():
            ws.drop(edges)
            return after.select("node", "component")
        labels = after.drop("moved")
        labels._svloom_path = after._svloom_path


def sample_ids(ids: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows of ``ids`` (id, ...): those whose id's hash is the smallest; the same rows on any cluster.

    Hashes are even, so all but some ``limit`` rows are left out where they are read, by a hash bound that their
    number gives; only what lies under it meets in one task. Should too few lie there (repeated ids), all are sorted.
    """
    hashed = ids.withColumn("__at", F.xxhash64("id", F.lit(seed)))
    rows = ids.count()
    under = hashed
    if rows > 2 * limit:
        share = (limit + 10 * limit**0.5 + 100) / rows
        under = hashed.where(F.col("__at") < int(min(share, 1.0) * 2**64) - 2**63)
        if under.count() < limit:
            under = hashed
    rest = [c for c in ids.columns if c != "id"]
    return under.orderBy("__at", "id", *rest).limit(limit).drop("__at")


def with_small_side(spark: SparkSession, small: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """``small`` marked for broadcast if its counted ``rows`` are at most ``limit``; else left to a shuffled join."""
    return F.broadcast(small) if rows <= limit else small
