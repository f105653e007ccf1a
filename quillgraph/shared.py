"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session in one process gets one of its own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillgraph-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table in the shared folder."""
    return f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage is cut, sizes are known, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # small row groups: a task that writes long texts holds one of them in memory
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: In memory a row of labels takes some so many times its bytes in a compressed file, hash table included (900,000 edges: 3 MB in a file, 192 MB as a broadcast).
IN_MEMORY = 48
#: Most partitions that a shuffle begins with.
MOST_PARTITIONS = 4096
#: Bytes of input files for a partition of a shuffle, at most.
PARTITION_BYTES = 1 << 20
#: Bytes of a compressed file, or of a shuffle's compressed rows, that one task reads: hash tables of keys are some fifty times that.
TASK_BYTES = 8 << 20


def fit_plans(spark: SparkSession, paths: list[str]) -> None:
    """Let plans over these tables follow their size: tables that are small only in their compressed files aren't broadcast, and shuffles have partitions
    in proportion to the input (adaptive execution merges small ones). What the session sets itself stays."""
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", IN_MEMORY)
    fit_tasks(spark, paths)


def fit_tasks(spark: SparkSession, paths: list[str]) -> None:
    """Let the number of tasks follow the tables' size, so that the memory of one doesn't; what the session sets itself stays."""
    for key, usual in (("spark.sql.files.maxPartitionBytes", "134217728b"), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "67108864b")):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, f"{TASK_BYTES}b")
    held = 0
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        held += target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(name, None) or 0))
    if held > least * PARTITION_BYTES:
        spark.conf.set(name, min(-(-held // PARTITION_BYTES), MOST_PARTITIONS))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
