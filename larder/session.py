"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Broadcasts are left to the optimizer, which compares measured sizes with
# spark.sql.autoBroadcastJoinThreshold; skewed join partitions are split by AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


SHUFFLE_BYTES = 256 * 1024**2


def sized_for(input_bytes: int) -> dict[str, str]:
    """Settings for an input of this size: enough shuffle partitions to fit in memory.

    AQE joins partitions that turn out small, so the number may be too high but not
    too low; the default of 200 would make partitions of hundreds of gigabytes.
    """
    partitions = min(max(-(-input_bytes // SHUFFLE_BYTES), 200), 65_536)
    return {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_BYTES),
        "spark.sql.files.maxPartitionBytes": str(SHUFFLE_BYTES),
    }


def build_session(
    app: str = "larder", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings above; ``conf`` uses ``__`` for dots in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = {} if input_bytes is None else sized_for(input_bytes)
    settings = DEFAULTS | sized | {name.replace("__", "."): value for name, value in conf.items()}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"larder-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local run that names none gets a temporary one: on a cluster the executors
    would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or _local_folder(spark.sparkContext)).rstrip("/")


def _local_folder(context) -> str:
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError(
            f"master {context.master}: spark.checkpoint.dir has to name a folder all executors reach"
        )
    return _own_folder(context.applicationId)


RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files: they go when its rows are stored.

    Otherwise they stay until the driver happens to collect its garbage, and all steps of a
    query lie on disk together. Not for a frame that is acted on twice.
    """
    before = spark.conf.get(RELEASED, None)
    spark.conf.set(RELEASED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASED)
        else:
            spark.conf.set(RELEASED, before)


def write(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "zstd") -> DataFrame:
    """A frame written to a folder and read back; its shuffle files go."""
    with releasing(df.sparkSession):
        df.write.option("compression", compression).mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """A frame written to the shared folder and read back.

    For input that a plan uses several times: it is computed once, its size is known
    to the join planner, and a lost executor costs no recomputation.
    """
    return write(df, f"{shared_folder(df.sparkSession)}/larder/staged-{uuid.uuid4().hex}/{name}")


def clear(spark: SparkSession, path: str) -> None:
    """Takes the data of a folder away: an empty frame overwrites it."""
    spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)


def discard(*stored: DataFrame) -> None:
    """Takes away the data of staged frames that no result reads any more."""
    for frame in stored:
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            clear(frame.sparkSession, folder)
