"""Table input and output, and intermediate tables that outlive an executor."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.functions.links import link_type
from twinscan.session import checkpoint_folder

_LOCAL_FOLDER: list[str] = []
_OWN = threading.local()  # jobs of this thread: a stream's batches run in another one
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _jobs() -> list[str]:
    return _OWN.__dict__.setdefault("jobs", [])


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, a temporary one only for a local master; in a `job`, its folder there."""
    if _jobs():
        return _jobs()[-1]
    folder = checkpoint_folder(spark)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="twinscan-"))
    return _LOCAL_FOLDER[0]


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


@contextmanager
def job(spark: SparkSession) -> Iterator[str]:
    """Keep all intermediate tables of a job in one folder and remove it at the end, also after a failure. Results are
    computed when they are written or collected, so that belongs inside."""
    folder = f"{scratch_folder(spark)}/twinscan-job-{uuid.uuid4().hex}"
    _jobs().append(folder)
    try:
        yield folder
    finally:
        _jobs().remove(folder)
        files, target = _file_system(spark, folder)
        files.delete(target, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to this folder as a whole and committed."""
    files, target = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there. Unlike a failed read, this does not take a damaged or foreign table
    for none. For the few folders of one level."""
    files, target = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


@contextmanager
def step(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A `job` inside a larger one: its intermediate tables go at the end, what is given to `keep` stays."""
    outer = scratch_folder(spark)
    with job(spark):
        yield lambda df, hint="merge": materialize(df, outer, hint)


def write_once(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `df` once and read it back. Used where several branches of a plan share costly rows:
    each branch then reads just its columns, and a lost executor re-reads files instead of lineage."""
    spark = df.sparkSession
    path = f"{folder or scratch_folder(spark)}/twinscan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files that a write takes go with its end, not with the driver's next garbage collection."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def materialize(df: DataFrame, folder: str | None = None, hint: str | None = "merge") -> DataFrame:
    """`write_once` for tables of any size: what is read back is joined by sorting and merging. Files of token arrays
    are a hundredth of their rows in memory, so their size would let whole tables be broadcast through the driver."""
    with _shuffles_go(df.sparkSession):
        stored = write_once(df, folder)
    return stored.hint(hint) if hint else stored


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan anew before costly per-row work if a slice holds over twice a core's share. A row group is
    read by one slice, however many others its file is cut into, so rows are counted (from the footers), not slices."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # a number for each slice
    return df.repartition(max(wanted, df.rdd.getNumPartitions())) if max(held, default=0) * wanted > 2 * sum(held) else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def new_submissions(requests: DataFrame) -> DataFrame:
    """Fill the defaults of newly received submissions."""
    have = set(requests.columns)

    def given(name: str, default):
        return F.coalesce(F.col(name), default) if name in have else default

    now = F.localtimestamp()
    return (
        requests.withColumn("upload_time", given("upload_time", now))
        .withColumn("link_type", given("link_type", link_type(F.col("link"))))
        .withColumn("status", given("status", F.lit("pending")))
        .withColumn("created_at", given("created_at", now))
        .withColumn("id", given("id", F.uuid()))
    )


def append_by_step(df: DataFrame, path: str) -> None:
    """Append to a table partitioned by project and step, the two columns every report filters on."""
    df.write.mode("append").partitionBy("project", "step").parquet(path)
