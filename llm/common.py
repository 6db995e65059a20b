"""What the operators share: the shared folder, staged tables, document keys, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most; texts differ in length by four orders of magnitude.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text handled in one go by the numpy kernels.
CHUNK_BYTES = 1 << 21
#: The key of a row: see keyed().
RID = "struct<id:bigint,h:bigint>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; set here only where it is unset, in local mode."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Stages:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a rerun.

    What the returned DataFrame still reads stays until the session's owner clears the folder; the rest is dropped on the way.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
        """Write df and read it back.  Its shuffle files go with the write; rows: the most in one Arrow batch."""
        with setting(self.spark, CLEAN_CONF, "true"), setting(self.spark, BATCH_CONF, str(rows)):
            df.select("*").write.mode("overwrite").parquet(self.path(name))
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(sc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches for what the caller runs of a lazy result: the setting is read when that runs, so it stays."""
    if int(spark.conf.get(BATCH_CONF, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """rid, doc_id and text (null: empty) of the documents, and the columns of more.

    rid is the pair (doc_id, hash of the text).  It orders as doc_id, a null id before all others; rows of one id and equal texts
    share it (one document, listed repeatedly), other texts of that id have rids of their own.  It is made row by row,
    from the row alone: no ids clash, overflow or depend on other rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rid = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"))
    return docs.select(rid.alias("rid"), "doc_id", text.alias("text"), *more)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def chunks(data: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[range]:
    """Ranges of texts of about `limit` bytes together, one text at least."""
    at, held = 0, 0
    for i, x in enumerate(data):
        if held and held + len(x) > limit:
            yield range(at, i)
            at, held = i, 0
        held += len(x)
    if at < len(data):
        yield range(at, len(data))


def components(stages: Stages, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """node, component (its least node) of an undirected graph given as edges (a, b) of any type that has an order.

    Each round every node hooks onto its least neighbour, parents are shortened once and the edges are
    contracted, until none is left.  Only grouped minima and joins: a hub's neighbours never meet in a task.
    """
    e = stages.put(f"{tag}-edges-0", edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    roots = stages.put(f"{tag}-roots-0", e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    turn = 0
    while not e.isEmpty():
        turn += 1
        both = e.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("near")))
        least = stages.put(f"{tag}-least-{turn}", both.groupBy("node").agg(F.least("node", F.min("near")).alias("parent")))
        jump = least.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parent = stages.put(f"{tag}-parent-{turn}", least.join(jump, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")))
        to = lambda c: parent.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_to"))
        new = e.join(to("a"), "a").join(to("b"), "b").select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).filter("a <> b").distinct()
        e = stages.put(f"{tag}-edges-{turn}", new)
        moved = roots.join(parent.withColumnsRenamed({"node": "component"}), "component", "left")
        roots = stages.put(f"{tag}-roots-{turn}", moved.select("node", F.coalesce("parent", "component").alias("component")))
        stages.drop(*(f"{tag}-{x}-{turn}" for x in ("least", "parent")), *(f"{tag}-{x}-{turn - 1}" for x in ("edges", "roots")))
    return roots
