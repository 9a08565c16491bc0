"""Session set-up, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by `materialize` in this process, by session id; removed at exit or by `cleanup`.
_written: list[tuple[SparkSession, str]] = []


def get_spark(app: str = "evidra", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library relies on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in a local session where that is unset, a temporary one.

    On a cluster each executor would write to a disk of its own, and the tables would come back incomplete, so there the
    setting is required.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        known = "file://" + tempfile.mkdtemp(prefix="evidra-")
        spark.conf.set("spark.checkpoint.dir", known)
        atexit.register(shutil.rmtree, known.removeprefix("file://"), True)
    return known.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and lets several later branches read only the
    columns they need, and of a table written `by` a column only the parts they need. The write runs when the plan is built, not when its result is read. The table is removed by
    `cleanup` or at the end of the process; a result that still reads it must be read or written before that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    if not _written:
        atexit.register(cleanup)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cleanup() -> None:
    """Remove every table that `materialize` wrote in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone; then only local folders can still be removed
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
