"""Session settings and lineage cuts in shared storage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SHIPPING = Lock()


def build_session(app: str = "terraloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names for checkpoints; only local runs may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def application_folder(spark: SparkSession) -> str:
    """Folder in shared storage that holds this application's tables and scratch files."""
    return f"{shared_folder(spark)}/materialized-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and continue from the written rows.

    Unlike a checkpointed RDD the table has real file sizes, so later joins and `fits_one_task` see how large it is,
    and it is read column by column. Executors can be lost without repeating what came before.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_materialized(spark: SparkSession) -> None:
    """Delete the tables and scratch folders of this application, once no result depends on them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers once per application, whatever folder the driver runs in.

    Studies call this from several threads; a second archive of the same name would be refused by the context.
    """
    context = spark.sparkContext
    with _SHIPPING:
        if getattr(context, "_terraloom_shipped", False):
            return
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / "terraloom.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._terraloom_shipped = True
