"""Planning while the source is still being listed."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.globs import FilterChain
from driftline.plans.sync import SyncOptions, sync_plan
from driftline.sources.tables import HASH_BUCKET, hash_bucket
from driftline.streaming.sinks import compact, read_latest, write_batches

# Paths of a micro-batch that are broadcast; a larger batch is joined by shuffle.
BROADCAST_PATHS = 200_000


def near_rows(s: DataFrame, d: DataFrame, buckets: int = None) -> DataFrame:
    """The destination rows that the paths of a micro-batch can meet. With `buckets`, those of a table
    of `write_hashed`, only the buckets of these paths are read: their numbers, at most as many as there
    are buckets, become a filter on folders."""
    paths = s.select("rel_path").distinct()
    few = paths.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    if buckets:
        touched = [r[0] for r in paths.select(hash_bucket(F.col("rel_path"), buckets)).distinct().collect()]
        d = d.filter(F.col(HASH_BUCKET).isin(touched)).drop(HASH_BUCKET)
    return d.join(F.broadcast(paths), "rel_path", "left_semi") if few else d


def incremental_plan(src_stream: DataFrame, d: DataFrame, path: str, chain=FilterChain(), opts=SyncOptions(), buckets: int = None, **trigger):
    """Plan source rows as they arrive against a destination manifest. Each micro-batch is a
    left join on `rel_path`; a path listed again replaces its earlier row in `read_plan`.
    Hardlinks and deletions need the whole source and are left to the batch plan.

    The paths of a micro-batch are broadcast, if they are few, to pick the destination rows that
    matter where they lie; only those are shuffled. A destination of `read_hashed`, stored with this
    number of `buckets`, is read in the buckets of the micro-batch alone."""
    step = replace(opts, delete=False, hardlinks=False, dst_rows=False)

    def plan(s):
        return sync_plan(s, near_rows(s, d, buckets), chain, step)

    return write_batches(src_stream, path, transform=plan, **trigger)


def read_plan(spark, path: str) -> DataFrame:
    """The plan so far, one row per path."""
    return read_latest(spark, path, sync_plan_schema(spark), ["rel_path"])


def compact_plan(spark, path: str) -> None:
    """Fold the micro-batches so far into one table; see `sinks.compact`."""
    compact(spark, path, sync_plan_schema(spark), ["rel_path"])


def sync_plan_schema(spark):
    from driftline.schemas import MANIFEST
    empty = spark.createDataFrame([], MANIFEST)
    return sync_plan(empty, empty, opts=SyncOptions(hardlinks=False)).schema
