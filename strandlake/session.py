"""Session settings, the shared work folder and staged tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (as in local tests) is a folder of this machine made and set.
    """
    found = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if not found:
        found = spark.sparkContext._jvm.System.getProperty("strandlake.workdir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext._jvm.System.setProperty("strandlake.workdir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_RUN = f"run-{uuid.uuid4().hex[:16]}"
_cleaned_at_exit: list[bool] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this run's part of the work folder that no earlier call returned. All of the part is removed when the program ends, or by ``remove_staged``."""
    if not _cleaned_at_exit:
        _cleaned_at_exit.append(True)
        atexit.register(_remove_at_exit)
    return f"{work_dir(spark)}/strandlake/{_RUN}/{name}-{uuid.uuid4().hex}"


def remove_staged(spark: SparkSession) -> None:
    """Delete the tables that this run has staged so far. DataFrames that read them can't be read any more; what a caller stored elsewhere stays."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/strandlake/{_RUN}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _remove_at_exit() -> None:
    """As far as a session still runs; a lost one leaves its part of the folder, which is named by the run."""
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            remove_staged(spark)
            local = spark.sparkContext._jvm.System.getProperty("strandlake.workdir")
            if local:
                shutil.rmtree(local.removeprefix("file://"), ignore_errors=True)
    except Exception:  # noqa: BLE001 - nothing may fail at exit
        pass


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of an executor, so that what follows (often several
    readers) doesn't run the upstream again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of one ``staged`` table, which can't be read any more; any other is an error. Shuffles that nothing refers to any more are let go too (else they stay until the driver collects its garbage)."""
    spark = df.sparkSession
    own = f"/strandlake/{_RUN}/"
    folders = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
    if any(own not in x for x in folders):
        raise ValueError("not a staged table")
    for x in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(x)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark._jvm.System.gc()


def expected_splits(df: DataFrame) -> int:
    """About how many splits the files under ``df`` are read in, from the optimizer's estimate of their size. No job runs."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728b"))
    return max(1, min(1 << 24, -(-size // per)))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer splits than that (a small or unsplittable input); else as it is, without a shuffle.

    For scans whose rows are about to be multiplied. The number of splits is the optimizer's estimate; the plan isn't turned into anything else.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if expected_splits(df) < cores else df


def tokenizer_dir() -> str:
    """Folder of the public tokenizer vocabularies; override with STRANDLAKE_TOKENIZERS."""
    return os.environ.get("STRANDLAKE_TOKENIZERS", "/opt/tokenizers")
