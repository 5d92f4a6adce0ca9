"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def session(app: str = "thicket", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; anything can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is made only for a ``local`` master, where the driver and the
    executors share one disk. On a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="thicket-")
    return _LOCAL_FOLDERS[app]


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    This cuts lineage so that a lost executor re-reads files instead of re-running the plan,
    and, being parquet, it keeps column pruning and gives the optimizer a real size. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    root = shared_folder(spark).rstrip("/")
    path = f"{root}/thicket-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of about ``most`` bytes for what is written inside, for rows that are megabytes each.

    A worker holds two or three batches while it reads, so its memory follows their size.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)
