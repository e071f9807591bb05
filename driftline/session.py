"""Session defaults and the one place where lineage is cut."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

def get_spark(app="driftline", master=None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` wins over them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Rows with file bytes are wide: bound Arrow batches in bytes.
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`. Only where neither the
    configuration nor the context has one, and all executors are threads of this process, is a
    temporary folder set; on a cluster its executors would not see each other's files."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return configured or current
    if not configured and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="spark-driftline-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_MADE: list[str] = []


def scratch(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder. This session owns it; see `scratch_scope`."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def _delete(spark, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark):
    """Deletes the scratch folders made inside when it ends, but for those named in the list it gives:

        with scratch_scope(spark) as kept:
            result = cut(job(...), kept)

    What is not kept must be written by then: a lazy result would read folders that are gone."""
    start, kept = len(_MADE), []
    try:
        yield kept
    finally:
        mine, _MADE[start:] = _MADE[start:], []
        for path in mine:
            if path in kept:
                _MADE.append(path)
            else:
                _delete(spark, path)


def cut(df: DataFrame, kept: list = None) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read on from there. Used where
    later steps depend on how rows were laid out, so that a lost executor cannot change the
    answer, and where an intermediate result is read more than once. `kept` is the list of a
    `scratch_scope` that the table outlives."""
    path = scratch(df.sparkSession, "cut")
    if kept is not None:
        kept.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
