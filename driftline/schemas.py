"""Canonical table schemas. Modification times are BIGINT nanoseconds, since a Spark
timestamp holds microseconds and skip detection compares times exactly."""

from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("rel_path", T.StringType(), False),
    T.StructField("file_type", T.StringType(), False),
    T.StructField("size", T.LongType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("atime_ns", T.LongType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("uid", T.LongType()),
    T.StructField("gid", T.LongType()),
    T.StructField("nlink", T.LongType()),
    T.StructField("dev", T.LongType()),
    T.StructField("ino", T.LongType()),
    T.StructField("link_target", T.StringType()),
    T.StructField("xattrs", T.MapType(T.StringType(), T.BinaryType())),
])

CONTENT = T.StructType([
    T.StructField("rel_path", T.StringType(), False),
    T.StructField("content", T.BinaryType()),
])

DELTA_OPS = T.StructType([
    T.StructField("rel_path", T.StringType(), False),
    T.StructField("src_offset", T.LongType()),
    T.StructField("block_idx", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("literal", T.BinaryType()),
])

TRANSFER_EVENTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("total_size", T.LongType()),
    T.StructField("worker", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

# The event type names of a transfer log.
EVENT_TYPES = (
    "ScanStarted", "ScanComplete", "FileStarted", "FileProgress", "FileCompleted",
    "FileFailed", "FileSkipped", "DirCreated", "HardlinkCreated", "DeleteFile",
    "VerifyStarted", "VerifyOK", "VerifyFailed",
)
