"""Manifests, contents and events derived from the given tables, in Spark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.paths import ancestors

RULES = ("+ **/*.md", "- *.tmp", "- src1/")
MIN_SIZE = 64

_FILE = ("rel_path", "file_type", "size", "mtime_ns", "mode", "uid", "gid", "dev", "ino", "nlink", "content")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PATH = """concat(source, '/', lang, '/doc_', doc_id, CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md'
           WHEN 2 THEN '.log' WHEN 3 THEN '.tmp' ELSE '.bin' END) AS rel_path"""


def source_columns(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(
        _PATH, "'regular' AS file_type", "CAST(octet_length(text) AS BIGINT) AS size",
        "1704067200000000000 + doc_id * 1000000000 AS mtime_ns",
        "CASE WHEN doc_id % 6 = 0 THEN 384 ELSE 420 END AS mode",
        "1000 + doc_id % 3 AS uid", "100L AS gid", "1L AS dev",
        "doc_id - CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END AS ino",
        "CASE WHEN doc_id % 50 IN (0, 1) THEN 2L ELSE 1L END AS nlink",
        "encode(text, 'utf-8') AS content")


def src_files(spark, sf_dir) -> DataFrame:
    return source_columns(table(spark, sf_dir, "documents"))


def dst_files(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("doc_id % 10 <> 0").selectExpr(
        _PATH, "doc_id", """CASE WHEN doc_id % 10 = 2
              THEN concat(substring(text, 1, length(text) div 2), '@@', substring(text, length(text) div 2 + 1))
            WHEN doc_id % 10 IN (3, 4) THEN concat('#', substring(text, 2)) ELSE text END AS body""",
        """1704067200000000000 + doc_id * 1000000000 + CASE doc_id % 10 WHEN 1 THEN 1L
            WHEN 2 THEN -1000000000L WHEN 3 THEN -1000000000L ELSE 0L END AS mtime_ns""")
    pages = table(spark, sf_dir, "pages").selectExpr(
        "concat('stale/', page_id % 7, '/page_', page_id, '.html') AS rel_path", "page_id AS doc_id",
        "html AS body", "1704067200000000000 + page_id * 1000000000 AS mtime_ns")
    return docs.unionByName(pages).selectExpr(
        "rel_path", "'regular' AS file_type", "CAST(octet_length(body) AS BIGINT) AS size", "mtime_ns",
        "420 AS mode", "1000L AS uid", "100L AS gid", "1L AS dev", "doc_id + 1000000 AS ino", "1L AS nlink",
        "encode(body, 'utf-8') AS content")


def manifest(files: DataFrame) -> DataFrame:
    """Files and the directories above them."""
    dirs = files.select(F.explode(ancestors("rel_path")).alias("rel_path")).distinct().selectExpr(
        "rel_path", "'dir' AS file_type", "0L AS size", "0L AS mtime_ns", "493 AS mode", "0L AS uid",
        "0L AS gid", "1L AS dev", "CAST(NULL AS BIGINT) AS ino", "1L AS nlink")
    both = files.drop("content").unionByName(dirs)
    return both.selectExpr("*", "CAST(NULL AS BIGINT) AS atime_ns", "CAST(NULL AS STRING) AS link_target",
                           "CAST(NULL AS MAP<STRING, BINARY>) AS xattrs")


def src(spark, sf_dir) -> DataFrame:
    return manifest(src_files(spark, sf_dir))


def dst(spark, sf_dir) -> DataFrame:
    return manifest(dst_files(spark, sf_dir))


def src_content(spark, sf_dir) -> DataFrame:
    return src_files(spark, sf_dir).select("rel_path", "content")


def dst_content(spark, sf_dir) -> DataFrame:
    return dst_files(spark, sf_dir).select("rel_path", "content")


# All types of a transfer log, from the five of the table.
EVENT_TYPE = """CASE event_type WHEN 'view' THEN CASE WHEN event_id % 8 = 3 THEN 'FileProgress' ELSE 'FileStarted' END
           WHEN 'click' THEN 'FileCompleted' WHEN 'error' THEN 'FileFailed'
           WHEN 'signup' THEN CASE event_id % 8 WHEN 0 THEN 'DirCreated' WHEN 1 THEN 'HardlinkCreated' WHEN 2 THEN 'DeleteFile'
             ELSE 'FileSkipped' END
           ELSE CASE event_id % 8 WHEN 0 THEN 'VerifyOK' WHEN 1 THEN 'VerifyStarted' WHEN 2 THEN 'ScanComplete'
             WHEN 3 THEN 'ScanStarted' ELSE 'VerifyFailed' END END"""


def event_columns(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "concat('run', user_id % 4) AS run_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS seq",
        f"{EVENT_TYPE} AS type",
        "concat('/dst/', user_id, '/f_', event_id) AS path", "CAST(round(value * 100) AS BIGINT) AS size",
        f"CASE WHEN {EVENT_TYPE} = 'ScanComplete' THEN event_id END AS total",
        f"CASE WHEN {EVENT_TYPE} = 'ScanComplete' THEN event_id * 1000 END AS total_size",
        "CAST(user_id % 8 AS INT) AS worker", "CASE WHEN event_type = 'error' THEN 'io error' END AS error")


def transfer_events(spark, sf_dir) -> DataFrame:
    return event_columns(table(spark, sf_dir, "events"))


def _stream(spark, sf_dir, name) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files. A stream over a plain path
    must name a folder, so the path is a pattern that this name alone matches."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("basePath", sf_dir).parquet(f"{sf_dir}/{name}.[p]arquet")


def event_stream(spark, sf_dir) -> DataFrame:
    return event_columns(_stream(spark, sf_dir, "events"))


def src_stream(spark, sf_dir) -> DataFrame:
    """Source files as they are listed; directories come with the batch manifest."""
    return source_columns(_stream(spark, sf_dir, "documents")).drop("content").selectExpr(
        "*", "CAST(NULL AS BIGINT) AS atime_ns", "CAST(NULL AS STRING) AS link_target",
        "CAST(NULL AS MAP<STRING, BINARY>) AS xattrs")


def listed_stream(spark, path: str) -> DataFrame:
    """Stored source files, a file of them at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).selectExpr(
        "*", "CAST(NULL AS BIGINT) AS atime_ns", "CAST(NULL AS STRING) AS link_target", "CAST(NULL AS MAP<STRING, BINARY>) AS xattrs")


def write_tree(spark, sf_dir, root: str) -> int:
    """The source files as files below a folder that all executors see, with their times; how many."""
    def write(batches):
        import os

        import pyarrow as pa

        for b in batches:
            for path, data, at in zip(*(b.column(c).to_pylist() for c in ("rel_path", "content", "mtime_ns"))):
                where = os.path.join(root, path)
                os.makedirs(os.path.dirname(where), exist_ok=True)
                with open(where, "wb") as f:
                    f.write(data)
                os.utime(where, ns=(at, at))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    files = src_files(spark, sf_dir).select("rel_path", "content", "mtime_ns")
    return files.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0]
