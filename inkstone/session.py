"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Everything is declared through Catalyst; these only switch on the run-time
# re-planning the operators count on (measured broadcast, skew splitting).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # few bytes can be much work here: small exchanges keep their tasks
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, app: str = "inkstone", **extra: str) -> SparkSession:
    """Build a session; on a cluster leave ``master`` unset and let spark-submit give it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context.

    Functions given to Spark refer to the package by name, and a worker need not see the folder
    that the driver imported it from.
    """
    context = spark.sparkContext
    if getattr(context, "_inkstone_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    bundle = os.path.join(tempfile.mkdtemp(prefix="inkstone-package-"), "inkstone.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("inkstone", os.path.relpath(path, top)))
    context.addPyFile(bundle)
    context._inkstone_shipped = True


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the store that Spark reads the path from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def use_checkpoints(spark: SparkSession) -> None:
    """Point the context at the cluster's checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="inkstone-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
