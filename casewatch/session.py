"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES_DIR = "spark.casewatch.tables.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of rows that a staged frame's Python steps get at a time

# What the plans in this package rely on. All are runtime settings, so they can
# also be applied to a session somebody else created.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "casewatch", cores: int | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own."""
    cores = cores or os.cpu_count()
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="casewatch-tables-"))
    )
    for name, value in PLAN_SETTINGS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, from `spark.checkpoint.dir`.

    Where the setting is absent a temporary folder is made, which is only right
    on a single machine; on a cluster that is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="casewatch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def tables_dir(spark: SparkSession) -> str:
    """Root of permanent tables: `spark.casewatch.tables.dir`, or the catalog's warehouse.

    Nothing under it is scratch; an age rule on the shared folder never touches it.
    """
    root = spark.conf.get(TABLES_DIR, None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def staging_folder(spark: SparkSession) -> str:
    """A folder for one run, which no other run uses."""
    return f"{shared_dir(spark)}/staging/{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str, root: str) -> None:
    """Remove a folder that lies under `root`."""
    folder, root = folder.rstrip("/"), root.rstrip("/")
    if not folder.startswith(f"{root}/") or ".." in folder:
        raise ValueError(f"{folder} is not under {root}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    What follows neither computes it again nor loses it with an executor, and
    Spark knows its size: a join broadcasts it only below the session's limit and
    shuffles it otherwise. The folder is one of this run alone. While it is written,
    Python steps get batches of a few megabytes, which both sides of the pipe hold.
    """
    spark, folder = df.sparkSession, folder or staging_folder(df.sparkSession)
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(folder)
