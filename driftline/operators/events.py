"""Counters, outcomes and per-worker state from a transfer event table.

Everything here is an aggregate with partial combining, or a scan over range slices, so one run
or worker with a large share of the events does not end up in one task. `ts` orders events and
`seq` breaks ties.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordered import Scan, ordered_scan

# Event types that end whatever a worker was doing.
CLEARS = ("FileCompleted", "FileFailed", "DirCreated", "HardlinkCreated")


def moment() -> Column:
    return F.struct("ts", "seq")


def is_type(*names) -> Column:
    return F.col("type").isin(*names)


def bytes_done() -> Column:
    """Bytes an event adds to the copied total; skipped files count in full."""
    return F.when(is_type("FileCompleted", "FileSkipped"), F.coalesce("size", F.lit(0))).otherwise(F.lit(0))


def counters() -> list:
    """The counters of a run as aggregate columns, for batch and streaming use alike."""
    def count(*names):
        return F.count_if(is_type(*names))
    return [
        count("FileStarted").alias("files_scanned"), count("FileCompleted").alias("files_copied"),
        count("FileFailed").alias("files_failed"), count("FileSkipped").alias("files_skipped"),
        F.sum(bytes_done()).alias("bytes_copied"), count("DirCreated").alias("dirs_created"),
        count("HardlinkCreated").alias("hardlinks_created"),
        F.coalesce(F.max(F.when(is_type("ScanComplete"), F.col("total_size"))), F.lit(0)).alias("bytes_total"),
        F.coalesce(F.max(F.when(is_type("ScanComplete"), F.col("total"))), F.lit(0)).alias("files_total"),
        count("VerifyOK").alias("files_verified"), count("VerifyFailed").alias("files_verify_failed"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("elapsed_us"),
    ]


def snapshot(ev: DataFrame, by=()) -> DataFrame:
    """The counters over all events, or per key of `by`. Events of filtered entries look like
    skips and are counted as such."""
    return ev.groupBy(*by).agg(*counters())


def summary(ev: DataFrame) -> DataFrame:
    """Completion summary per run: files, bytes, average bytes per second, time, verified, errors."""
    elapsed = F.col("elapsed_us") / F.lit(1e6)
    return snapshot(ev, ["run_id"]).select(
        "run_id", F.col("files_copied").alias("files"), F.col("bytes_copied").alias("bytes"),
        F.when(elapsed > 0, F.col("bytes_copied") / elapsed).otherwise(F.lit(0.0)).alias("avg_bytes_per_s"),
        "elapsed_us", F.col("files_verified").alias("verified"),
        (F.col("files_failed") + F.col("files_verify_failed")).alias("errors"),
        (F.col("files_failed") == 0).alias("clean"))


def error_text() -> Column:
    return (F.when(is_type("VerifyFailed"), F.lit("CHECKSUM MISMATCH"))
             .otherwise(F.coalesce("error", F.lit("error"))))


def error_summary(ev: DataFrame) -> DataFrame:
    """First error of each run and how many more there were; where only verification failed, how
    many files did."""
    failed = is_type("FileFailed")
    bad = ev.filter(is_type("FileFailed", "VerifyFailed")).groupBy("run_id").agg(
        F.min_by(F.when(failed, F.coalesce("error", F.lit("error"))), F.when(failed, moment())).alias("_first"),
        F.count_if(failed).alias("_n"), F.count_if(~failed).alias("_unverified")).select(
        "run_id", F.coalesce("_first", F.concat(F.col("_unverified").cast("string"), F.lit(" files failed verification"))).alias("first_error"),
        F.greatest(F.col("_n") - 1, F.lit(0)).alias("more"))
    more = F.concat(F.col("first_error"), F.lit(" (and "), F.col("more").cast("string"), F.lit(" more errors)"))
    return bad.withColumn("message", F.when(F.col("more") > 0, more).otherwise(F.col("first_error")))


def run_outcome(ev: DataFrame) -> DataFrame:
    """0 without errors, 1 when something was copied in spite of them, 2 when nothing was."""
    bad = (F.col("files_failed") + F.col("files_verify_failed")) > 0
    code = F.when(~bad, 0).when(F.col("files_copied") > 0, 1).otherwise(2)
    return snapshot(ev, ["run_id"]).select("run_id", code.alias("code"))


def recent_errors(ev: DataFrame, n=5) -> DataFrame:
    """The last n errors over all runs; a failed verification counts as one."""
    return (ev.filter(is_type("FileFailed", "VerifyFailed"))
            .select("run_id", "ts", "seq", "path", error_text().alias("error"))
            .orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n))


def report_header(ev: DataFrame) -> DataFrame:
    """Per run: start and end, seconds, files, bytes, average bytes per second, and errors."""
    runs = ev.groupBy("run_id").agg(F.min("ts").alias("started"), F.max("ts").alias("completed"))
    secs = (F.unix_micros("completed") - F.unix_micros("started")) / F.lit(1e6)
    totals = snapshot(ev, ["run_id"]).select(
        "run_id", F.col("files_copied").alias("files"), F.col("bytes_copied").alias("bytes"),
        (F.col("files_failed") + F.col("files_verify_failed")).alias("errors"))
    return runs.join(totals, "run_id").select(
        "run_id", "started", "completed", secs.alias("duration_s"), "files", "bytes",
        F.when(secs > 0, F.col("bytes") / secs).otherwise(0.0).alias("bytes_per_s"), "errors")


def file_outcomes(ev: DataFrame) -> DataFrame:
    """Final outcome of every path of a run: done, skipped or failed."""
    last = F.max_by(F.struct("type", "size", F.when(is_type("FileFailed"), error_text()).alias("error")), moment())
    outcome = (F.when(F.col("last.type") == "FileCompleted", "done")
                .when(F.col("last.type") == "FileSkipped", "skipped").otherwise("failed"))
    return (ev.filter(is_type("FileCompleted", "FileSkipped", "FileFailed"))
            .groupBy("run_id", "path").agg(last.alias("last"))
            .select("run_id", "path", outcome.alias("outcome"), F.col("last.size").alias("size"),
                    F.col("last.error").alias("error")))


def in_flight(ev: DataFrame, at) -> DataFrame:
    """Files being copied at time `at`, with the time spent so far and the last progress seen."""
    at = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    state = is_type("FileStarted", *CLEARS)
    progress = is_type("FileProgress")
    last = ev.filter((F.col("ts") <= at) & (state | progress)).groupBy("run_id", "worker").agg(
        F.max_by(F.struct("type", "path", "size", "ts", "seq"), F.when(state, moment())).alias("s"),
        F.max_by(F.struct("size", "ts", "seq"), F.when(progress, moment())).alias("p"))
    fresh = F.struct("p.ts", "p.seq") > F.struct("s.ts", "s.seq")
    return (last.filter("s.type = 'FileStarted'")
            .select("run_id", "worker", F.col("s.path").alias("path"), F.col("s.size").alias("size"),
                    F.when(fresh, F.col("p.size")).alias("progress"),
                    (F.unix_micros(at) - F.unix_micros("s.ts")).alias("so_far_us")))


def worker_states(ev: DataFrame, parts=None) -> DataFrame:
    """Start and end events with the event before it of the same worker in `prev`."""
    rows = ev.filter(is_type("FileStarted", *CLEARS))
    return ordered_scan(rows, ["run_id", "worker"], ["ts", "seq"],
                        {"prev": Scan("last", F.struct("type", "path", "size", "ts"), before=True)}, parts)


def busy_workers(ev: DataFrame, parts=None) -> DataFrame:
    """Number of busy workers of the run after each event that can change it. A worker is busy or
    not; starting twice does not count twice."""
    now = is_type("FileStarted").cast("int")
    before = F.coalesce((F.col("prev.type") == "FileStarted").cast("int"), F.lit(0))
    steps = (worker_states(ev, parts).withColumn("step", now - before)
             .select("run_id", "ts", "seq", "worker", "type", "step"))
    return ordered_scan(steps, ["run_id"], ["ts", "seq"], {"busy": Scan("sum", F.col("step"))}, parts).drop("step")


def file_durations(ev: DataFrame, parts=None) -> DataFrame:
    """Time and speed of each finished file, from its worker's start event right before."""
    us = F.unix_micros("ts") - F.unix_micros("prev.ts")
    return (worker_states(ev, parts)
            .filter(is_type("FileCompleted", "FileFailed") & (F.col("prev.type") == "FileStarted"))
            .select("run_id", "worker", "seq", "path", F.col("prev.path").alias("started_path"), "size",
                    us.alias("duration_us"),
                    F.when(us > 0, F.col("size") / (us / F.lit(1e6))).alias("bytes_per_s")))
