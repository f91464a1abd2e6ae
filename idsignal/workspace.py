"""Written intermediate tables.

A staged table cuts lineage and survives lost executors because it lives in the
folder all machines share (`spark.checkpoint.dir`).
"""

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a session in one process may fall back to a temp folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="idsignal-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_name(name: str) -> str:
    """A name that nothing has used before."""
    return f"{name}-{uuid.uuid4().hex[:12]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/idsignal/{spark.sparkContext.applicationId}/{fresh_name(name)}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a fresh Parquet table and read it back (runs a job)."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*jobs: Callable[[], object]) -> list:
    """Run independent Spark jobs at the same time; gives their results in order."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [done.result() for done in [pool.submit(job) for job in jobs]]


def spread(df: DataFrame) -> DataFrame:
    """At least one task per core for a costly step; larger inputs have more already.

    Meant for scans and narrow steps on them, whose task count is known without a job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_existing(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The Parquet table at `path`, None if there is no such path; other errors raise."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_or_write(spark: SparkSession, path: str, schema, build: Callable[[], DataFrame]) -> DataFrame:
    """The table saved at `path`, built and saved first if there is none."""
    saved = read_existing(spark, path, schema)
    if saved is None:
        build().write.mode("errorifexists").parquet(path)
        saved = spark.read.schema(schema).parquet(path)
    return saved
