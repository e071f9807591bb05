"""Structured Streaming twins of the event operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.events import bytes_done, counters, error_text, is_type
from driftline.sources.tables import LOG_SCHEMA, events_from_log


def stream_events(spark, path: str, run_id=None, max_files=1000) -> DataFrame:
    """Transfer events from a folder that receives JSON logs."""
    raw = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    return events_from_log(raw, F.col("_metadata.file_name") if run_id is None else run_id)


def stream_snapshot(ev: DataFrame) -> DataFrame:
    """Running counters per run; use output mode update or complete."""
    return ev.groupBy("run_id").agg(*counters())


def _throughput():
    return [F.sum(bytes_done()).alias("bytes"), F.count_if(is_type("FileCompleted")).alias("files")]


def stream_ticks(ev: DataFrame, every="1 second", delay="10 seconds") -> DataFrame:
    """Bytes and files per tumbling interval; events later than `delay` are dropped."""
    return (ev.withWatermark("ts", delay).groupBy("run_id", F.window("ts", every)).agg(*_throughput())
            .select("run_id", F.col("window.start").alias("start"), "bytes", "files"))


def stream_rolling(ev: DataFrame, width="10 seconds", slide="1 second", delay="10 seconds") -> DataFrame:
    """Bytes and files per second over sliding windows."""
    secs = (F.unix_micros("window.end") - F.unix_micros("window.start")) / F.lit(1e6)
    return (ev.withWatermark("ts", delay).groupBy("run_id", F.window("ts", width, slide)).agg(*_throughput())
            .select("run_id", F.col("window.end").alias("end"), "bytes", "files",
                    (F.col("bytes") / secs).alias("bytes_per_s"), (F.col("files") / secs).alias("files_per_s")))


def live_failures(ev: DataFrame) -> DataFrame:
    """Failed copies and failed verifications as they come; stateless, append mode."""
    return ev.filter(is_type("FileFailed", "VerifyFailed")).select(
        "run_id", "ts", "seq", "type", "path", error_text().alias("error"))


def late_rows(seen: DataFrame, kept: DataFrame, keys) -> DataFrame:
    """Rows of a finished stream's input that its windows left out as late: `seen` is the input and
    `kept` the windows (keys and `events`), as batch tables; the result counts the difference."""
    n = seen.groupBy(*keys).agg(F.count("*").alias("seen"))
    k = kept.groupBy(*keys).agg(F.sum("events").alias("kept"))
    return n.join(k, list(keys), "left").select(*keys, (F.col("seen") - F.coalesce("kept", F.lit(0))).alias("late"))


def session_batches(tasks: DataFrame, gap="50 milliseconds", by=("run_id",), delay=None) -> DataFrame:
    """Batches that end when no task came for `gap`: start, end, files and bytes per batch. Without
    `delay` no task is ever too late (output mode complete or update; all sessions are kept). With
    it, tasks that much behind the newest are left out and sessions are forgotten after it."""
    seen = tasks.withWatermark("ts", delay) if delay else tasks
    return (seen.groupBy(*by, F.session_window("ts", gap))
            .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
            .select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"),
                    "files", "bytes"))
