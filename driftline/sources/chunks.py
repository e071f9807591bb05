"""Files of any size, read in chunks by many tasks."""

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.content import CHUNK
from driftline.sources.tree import read_tree

COLUMNS = "rel_path string, size bigint, chunk_idx bigint, offset bigint, bytes binary"


def _ranges(root: str, chunk_bytes: int):
    def read(path, offset, length):
        """The bytes of a range, or None if they cannot be read or the file has become shorter."""
        try:
            with open(os.path.join(root, path), "rb") as f:
                f.seek(offset)
                data = f.read(length)
        except OSError:
            return None
        return data if len(data) == length else None

    def run(batches):
        for b in batches:
            for path, size, k in zip(*(b.column(c).to_pylist() for c in ("rel_path", "size", "chunk_idx"))):
                offset = k * chunk_bytes
                data = read(path, offset, min(chunk_bytes, size - offset))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([size], pa.int64()), pa.array([k], pa.int64()), pa.array([offset], pa.int64()),
                     pa.array([data], pa.binary())], names=["rel_path", "size", "chunk_idx", "offset", "bytes"])

    return run


def chunks_of(manifest: DataFrame, root: str, chunk_bytes=CHUNK, parts: int = None) -> DataFrame:
    """The chunks of the regular files of `manifest` below `root`, which every executor has mounted.
    The ranges to read are shuffled, not the bytes: chunks of one large file are read by many tasks.
    A task holds one chunk. Unreadable chunks have null bytes. The number of tasks is given, for the
    adaptive engine would judge by the size of the ranges."""
    spark = manifest.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    last = F.greatest(F.expr(f"(size - 1) div {chunk_bytes}L"), F.lit(0))
    ranges = (manifest.filter("file_type = 'regular'")
              .select("rel_path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_idx"))
              .repartition(parts, "rel_path", "chunk_idx"))
    return ranges.mapInArrow(_ranges(os.path.abspath(root), chunk_bytes), COLUMNS)


def read_chunks(spark, root: str, chunk_bytes=CHUNK, parts: int = None) -> DataFrame:
    """All files below `root`, in chunks."""
    return chunks_of(read_tree(spark, root), root, chunk_bytes, parts)
