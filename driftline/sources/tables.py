"""Manifests, file contents, event logs, and the sink they share."""

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.schemas import EVENT_TYPES, MANIFEST, TRANSFER_EVENTS

# Field names of a structured transfer log line.
LOG_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampType()), T.StructField("level", T.StringType()),
    T.StructField("msg", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("worker", T.IntegerType()), T.StructField("error", T.StringType()),
    # Position of the line in its log, written by whoever writes the log; orders events of one moment.
    T.StructField("seq", T.LongType()),
])


def load_manifest(spark, path: str) -> DataFrame:
    """The stored manifest of a tree, empty before the first sync. The schema is given, so no
    footers are read for it, and columns that older files lack come out null."""
    try:
        return spark.read.schema(MANIFEST).parquet(table_folder(spark, path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], MANIFEST)


_COMMIT = re.compile(r"_committed-(\d{12})-(\w+)$")


def folder_names(spark, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def table_folder(spark, path: str) -> str:
    """Where the newest committed version of a table lies; `path` itself if it has no versions."""
    done = max((n for n in folder_names(spark, path) if _COMMIT.match(n)), default=None)
    return f"{path}/version-{done.removeprefix('_committed-')}" if done else path


def table_exists(spark, path: str) -> bool:
    return any(_COMMIT.match(n) for n in folder_names(spark, path))


def remove_folder(spark, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark, path: str, fmt="parquet") -> DataFrame:
    return spark.read.format(fmt).load(table_folder(spark, path))


def write_table(df: DataFrame, path: str, partition_by=(), fmt="parquet") -> None:
    """Replace a table as a whole. The rows go to a folder of their own, which counts only once an
    empty file says that it is complete: a write that fails leaves the table as it was, and readers
    keep the version they opened until the next but one write. Partition manifests by a coarse path
    column to prune directories at read time."""
    spark = df.sparkSession
    done = max((int(m[1]) for m in map(_COMMIT.match, folder_names(spark, path)) if m), default=0)
    version = f"{done + 1:012d}-{uuid.uuid4().hex[:8]}"
    w = df.write.format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(f"{path}/version-{version}")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(jvm.Path(f"{path}/_committed-{version}"), False).close()
    for name in folder_names(spark, path):
        number = re.match(r"(?:version|_committed)-(\d{12})-", name)
        if number and int(number[1]) < done:
            fs.delete(jvm.Path(f"{path}/{name}"), True)


def binary_listing(spark, root: str, recursive=True) -> DataFrame:
    """Manifest of an object store or shared folder: regular files only, times in whole
    microseconds. File contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    listed = raw.select("path", "length", "modificationTime")
    cols = {"rel_path": _below(root), "file_type": F.lit("regular"), "size": F.col("length"),
            "mtime_ns": F.unix_micros("modificationTime") * 1000}
    return listed.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST])


def read_content(spark, root: str) -> DataFrame:
    """(rel_path, content) of every file below `root`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(_below(root).alias("rel_path"), "content")


def _below(root: str) -> Column:
    bare = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    return F.expr("path").substr(F.instr("path", bare) + len(bare), F.length("path"))


def events_from_log(raw: DataFrame, run_id=None) -> DataFrame:
    """Transfer events from parsed log lines; lines of other kinds are dropped."""
    run = run_id if isinstance(run_id, Column) else F.lit(run_id).cast("string")
    cols = {"run_id": run, "ts": F.col("time"), "type": F.col("type"), "path": F.col("path"),
            "size": F.col("size"), "worker": F.col("worker"), "error": F.col("error"), "seq": F.col("seq")}
    return raw.filter(F.col("type").isin(*EVENT_TYPES)).select(
        *[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TRANSFER_EVENTS])


def read_events(spark, path: str, run_id=None) -> DataFrame:
    """Transfer events of JSON logs. By default each log file is one run."""
    raw = spark.read.schema(LOG_SCHEMA).json(path)
    return events_from_log(raw, F.col("_metadata.file_name") if run_id is None else run_id)


def write_bucketed(m: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store a manifest as an external table bucketed and sorted by `rel_path`. Plans over two
    manifests with equal bucket counts join without a shuffle."""
    (m.repartition(buckets, "rel_path").write.mode("overwrite").bucketBy(buckets, "rel_path").sortBy("rel_path")
      .option("path", path).saveAsTable(table))
    return m.sparkSession.table(table)


HASH_BUCKET = "bucket"


def hash_bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def write_hashed(m: DataFrame, path: str, buckets: int) -> None:
    """Store a manifest as a versioned table in folders by the hash of its paths, so that a reader who
    looks for some paths opens only their buckets."""
    dealt = m.withColumn(HASH_BUCKET, hash_bucket(F.col("rel_path"), buckets))
    write_table(dealt.repartition(buckets, HASH_BUCKET), path, [HASH_BUCKET])


def read_hashed(spark, path: str) -> DataFrame:
    """The manifest with its `bucket` column, empty before the first sync."""
    schema = T.StructType([*MANIFEST.fields, T.StructField(HASH_BUCKET, T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(table_folder(spark, path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)
