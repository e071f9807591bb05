"""Rates, progress and time left from per-interval samples.

Events are first summed to ticks, so what is windowed grows with the run's duration and not with
its events, and the windows are cut into blocks of ticks, so a long run is spread over tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.events import bytes_done, is_type
from driftline.operators.ordered import BLOCK, Scan, block_scan, trailing_frames

BLOCK_TICKS = 4096


def ticks(ev: DataFrame, every_s=1) -> DataFrame:
    """Bytes and files done per interval of each run, with zero rows for idle intervals. `tick`
    counts intervals since the epoch, `idx` since the start of the run."""
    tick = F.expr(f"unix_seconds(ts) div {every_s}L")
    sums = ev.groupBy("run_id", tick.alias("tick")).agg(
        F.sum(bytes_done()).alias("bytes"), F.count_if(is_type("FileCompleted")).alias("files"))
    bounds = sums.groupBy("run_id").agg(F.min("tick").alias("lo"), F.max("tick").alias("hi"))
    # The spine is made block by block, so a long run is not exploded by one task.
    spine = (bounds.withColumn("b", F.explode(F.expr(f"sequence(0L, (hi - lo) div {BLOCK_TICKS}L)")))
             .repartition("run_id", "b")
             .select("run_id", "lo", F.explode(F.expr(
                 f"sequence(lo + b * {BLOCK_TICKS}, least(hi, lo + (b + 1) * {BLOCK_TICKS} - 1))")).alias("tick")))
    return (spine.join(sums, ["run_id", "tick"], "left")
            .select("run_id", "tick", (F.col("tick") - F.col("lo")).alias("idx"),
                    F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("files", F.lit(0)).alias("files")))


def rolling(t: DataFrame, n: int) -> DataFrame:
    """Average bytes and files per tick over the last n ticks, or over those there are."""
    return trailing_frames(t, ["run_id"], "idx", max(n, 1), {
        "avg_bytes": lambda w: F.avg("bytes").over(w), "avg_files": lambda w: F.avg("files").over(w)})


def last_samples(t: DataFrame, n: int) -> DataFrame:
    """The bytes of the last n ticks, oldest first."""
    return trailing_frames(t, ["run_id"], "idx", max(n, 1), {
        "samples": lambda w: F.collect_list("bytes").over(w)})


def _tick_scan(t: DataFrame, scans: dict) -> DataFrame:
    t = t.withColumn(BLOCK, F.floor(F.col("idx") / BLOCK_TICKS))
    return block_scan(t, ["run_id"], ["idx"], scans).drop(BLOCK)


def progress(t: DataFrame, total) -> DataFrame:
    """Bytes copied so far and their share of `total` (a number or a column of the tick table)."""
    total = total if isinstance(total, Column) else F.lit(total)
    done = _tick_scan(t, {"bytes_copied": Scan("sum", F.col("bytes")), "files_copied": Scan("sum", F.col("files"))})
    share = F.when(total > 0, F.col("bytes_copied") / total).otherwise(F.lit(0.0))
    return done.withColumn("bytes_total", total.cast("bigint")).withColumn("fraction", share)


def with_totals(t: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach (run_id, bytes_total) to every tick. One row per run against its ticks."""
    return t.join(totals.select("run_id", F.col("bytes_total").alias("run_total")), "run_id", "left")


def eta(t: DataFrame, total, n=10, every_s=1) -> DataFrame:
    """Whole seconds left at the rolling speed; 0 when nothing moves or nothing remains."""
    p = progress(rolling(t, n), total)
    left = F.col("bytes_total") - F.col("bytes_copied")
    speed = F.col("avg_bytes") / F.lit(float(every_s))
    secs = F.when((speed > 0) & (left > 0), (left.cast("double") / F.when(speed > 0, speed)).cast("bigint"))
    return p.withColumn("eta_s", F.coalesce(secs, F.lit(0).cast("bigint")))


def rate_mode(t: DataFrame, on=200.0, off=100.0, n=2) -> DataFrame:
    """Intervals with a high file rate: on above `on`, off below `off`, else as before."""
    fps = F.col("avg_files")
    flip = F.when(fps > on, True).when(fps < off, False)
    return _tick_scan(rolling(t, n), {"high": Scan("last", flip)}).withColumn(
        "high", F.coalesce("high", F.lit(False)))
