"""Session settings and the lineage-cutting folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "prismill", cpus: str | int = "*", memory: str = "12g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own settings."""
    partitions = str(cpus) if str(cpus).isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder is made only for a local master, where driver and executors share the disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="prismill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = os.path.join(folder, "checkpoints")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store an iteration's state in the shared folder so that a lost executor costs one step."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_round(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage`, for the state of a loop that joins it with itself.

    A checkpoint keeps the size the optimizer guessed. A join's guess is a product, so its digits would double with every
    round until the driver is full; a written table has the size of its files.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
