"""Reading the tables of a data directory, and the session's shared folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, else one of our own.

    ``spark.checkpoint.dir`` names a folder that all executors share.  Only a
    local session that sets nothing (tests, a laptop) gets a temporary folder; a
    cluster without one is refused, as its executors would not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix=f"skein-{os.getpid()}-"))
    return sc.getCheckpointDir()


#: A side of at most so many rows (which are counted first) may be sent to every task.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, how_many: int | None = None) -> DataFrame:
    """A side that is cheap to count, marked for broadcast if it has at most BROADCAST_ROWS rows; else joined by shuffle."""
    n = df.count() if how_many is None else how_many
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def one_content(files: DataFrame) -> DataFrame:
    """``(file_path, content)``: each path once, of repeated ones with the greatest content; rows without content are left out.

    Only paths are shuffled to find those given twice, and only the contents of
    those to choose one; all others stay where their scan reads them.
    """
    ensure_checkpoint_dir(files.sparkSession)
    twice = files.groupBy("file_path").agg(F.count("*").alias("n")).where("n > 1").select("file_path").checkpoint()
    rows = files.where("content is not null").select("file_path", "content")
    side = small_side(twice)
    chosen = rows.join(side, "file_path", "left_semi").groupBy("file_path").agg(F.max("content").alias("content"))
    return rows.join(side, "file_path", "left_anti").unionByName(chosen)


def tasks_for(df: DataFrame, bytes_per_task: int) -> int:
    """Tasks so that none gets more than about ``bytes_per_task`` of what the plan reads, and at least as many as a shuffle has.

    The size is the optimizer's, from the files' lengths and the columns read: no
    job runs for it.  Where it knows none, tasks are as many as the input has, twice.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // bytes_per_task) if size < 2**60 else 2 * df.rdd.getNumPartitions())


#: Plan nodes that run no shuffle, so that counting partitions starts no job.
_NARROW = {"Project", "Filter", "Relation", "LogicalRelation", "LogicalRDD", "LocalRelation", "RelationV2"}


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, if a scan has fewer splits than there are cores.

    For steps in Python that cost far more than moving a row.  Large inputs
    have more splits than cores and stay as they are; so does everything that
    is more than a scan.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*(\w+)", line))}
    cores = df.sparkSession.sparkContext.defaultParallelism
    if nodes <= _NARROW and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
