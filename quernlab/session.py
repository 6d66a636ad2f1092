"""Session helpers: a local session, the driver's tables, and tables cut from their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether an execution deletes its shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quernlab")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per session, so that they find it wherever they start."""
    if getattr(spark.sparkContext, "_quernlab_sent", False):
        return
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="quernlab-")) / "quernlab.zip"
    atexit.register(shutil.rmtree, bundle.parent, ignore_errors=True)
    with zipfile.ZipFile(bundle, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(bundle))
    spark.sparkContext._quernlab_sent = True


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """One of the driver's tables; ``wide`` if a costly Python stage reads it.

    A scan has a task per some megabytes. Where that is fewer tasks than cores, as for a small table,
    a wide one is dealt to one task per core.
    """
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if wide and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to tasks, for a costly Python stage that follows a shuffle.

    Adaptive execution merges a shuffle's partitions by bytes, however long a row takes; a given
    number of partitions stays as it is.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local session, as in tests, that names none gets a temporary one; a cluster must name one.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="quernlab-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = f"file://{local}"
        spark.conf.set(CHECKPOINT_DIR, path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass  # the session is gone, and with a cluster also its folder


def scratch(spark: SparkSession, name: str = "quernlab") -> str:
    """A new path in the shared folder, deleted when the Python process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The result has no lineage, survives the loss of any executor, and is computed once however
    often it is read. It is deleted by ``discard``, or when the Python process ends. The shuffle files
    of the write are of no more use then and are deleted with its end, not when the driver's garbage is.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._quernlab_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote for ``df``; nothing may read it any more."""
    path = getattr(df, "_quernlab_path", None)
    if path:
        _delete(df.sparkSession, path)
