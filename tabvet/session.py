"""Session helpers.

On a cluster the session is created by the platform; operators only read its settings.
`get_spark` is for tests, the bench and local use.
"""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tabvet", shuffle_partitions: int | None = None) -> SparkSession:
    master = master or os.environ.get("TABVET_MASTER", "local[8]")
    if shuffle_partitions is None:
        shuffle_partitions = 8
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABVET_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        # wide one-pass aggregates generate large methods; let the JIT compile them
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application: they need not have it on their own path."""
    import shutil

    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="tabvet-package-"), "tabvet")
        sc.addPyFile(shutil.make_archive(name, "zip", root, "tabvet"))
        _SHIPPED.add(sc.applicationId)


_LOCAL_CKPT: str | None = None
_WRITTEN: list[tuple[SparkSession, str]] = []
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`, else the context's checkpoint folder.

    With neither, a local master gets a fresh scratch folder (tests, bench); a cluster gets an error, because a
    machine-local folder there is not visible to the other executors.
    """
    global _LOCAL_CKPT
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _LOCAL_CKPT
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _LOCAL_CKPT = tempfile.mkdtemp(prefix="tabvet-ckpt-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df, arrow_rows: int | None = None):
    """Write `df` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage for DataFrames consumed by several branches of one plan (each branch would
    otherwise recompute the scan and shuffles), and survives executor loss (the files live in
    the shared folder, not in executor memory). The table is deleted when the driver exits, or
    earlier by `release`. With `arrow_rows`, Python steps of the plan get so many rows in an Arrow
    batch at most while it is written: batches of whole texts or sets are held several times by an
    executor and its Python workers.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tabvet-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    if arrow_rows and (int(before) <= 0 or int(before) > arrow_rows):  # none or less than one is no limit
        spark.conf.set(ARROW_ROWS, arrow_rows)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if spark.conf.get(ARROW_ROWS) != before:
            spark.conf.set(ARROW_ROWS, before)
    if not _WRITTEN:
        atexit.register(_delete_all)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tabvet_path = path
    return out


def release(df) -> None:
    """Delete the table behind a frame returned by `materialize` that nothing reads any more."""
    path = getattr(df, "_tabvet_path", None)
    for item in [x for x in _WRITTEN if x[1] == path]:
        _WRITTEN.remove(item)
        _delete(*item)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_all() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended first
            return
