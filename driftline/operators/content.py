"""File contents in chunks: (rel_path, size, chunk_idx, offset, bytes), no value above one chunk.

Chunks of a file have one length but for the last; an empty file is one empty chunk. `size` is the
length of the whole file. A table of whole values (rel_path, content) can be cut into chunks, for
files small enough to be one value; `sources.chunks` reads files of any size in chunks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4 << 20
# Chunk digests that one node of a digest tree covers; two levels then reach 64 PiB a file.
FANOUT = 4096


def is_chunked(content: DataFrame) -> bool:
    return "chunk_idx" in content.columns


def chunk_content(content: DataFrame, chunk_bytes=CHUNK, ahead=0) -> DataFrame:
    """Whole values cut into chunks, each with the `ahead` bytes behind it as well."""
    size = F.octet_length("content").cast("bigint")
    last = F.greatest(F.expr(f"(size - 1) div {chunk_bytes}L"), F.lit(0))
    return (content.select("rel_path", "content", size.alias("size"))
            .select("rel_path", "content", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_idx"))
            .select("rel_path", "size", "chunk_idx", (F.col("chunk_idx") * chunk_bytes).alias("offset"),
                    F.substring("content", (F.col("chunk_idx") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes + ahead)).alias("bytes")))


def as_chunks(content: DataFrame, chunk_bytes=CHUNK) -> DataFrame:
    """`content` cut into chunks of `chunk_bytes`; the job fails if it comes in chunks of another length."""
    if not is_chunked(content):
        return chunk_content(content, chunk_bytes)
    agrees = F.col("offset") == F.col("chunk_idx") * chunk_bytes
    return content.withColumn("offset", F.when(agrees, F.col("offset")).otherwise(
        F.raise_error(F.lit(f"chunks are not of {chunk_bytes} bytes")).cast("bigint")))


def file_sizes(content: DataFrame) -> DataFrame:
    """(rel_path, size) of every file."""
    if is_chunked(content):
        return content.filter("chunk_idx = 0").select("rel_path", "size")
    return content.select("rel_path", F.octet_length("content").cast("bigint").alias("size"))


def tree_hashes(chunks: DataFrame, fanout=FANOUT) -> DataFrame:
    """(rel_path, hash): a digest tree over the chunk digests of every file, in hex. Bytes are hashed
    where they are read; a node takes `fanout` digests, so no row or group holds a file. Two files with
    equal chunk lengths have equal hashes if and only if their bytes are equal. The hash is null where
    a chunk is missing or unreadable."""
    own = chunks.select("rel_path", "size", "chunk_idx", F.octet_length("bytes").cast("bigint").alias("length"), F.sha2("bytes", 256).alias("hash"))
    node = F.sha2(F.expr("listagg(hash, '') WITHIN GROUP (ORDER BY chunk_idx)").cast("binary"), 256)
    low = (own.groupBy("rel_path", F.expr(f"chunk_idx div {fanout}L").alias("node"))
           .agg(node.alias("hash"), F.sum("length").alias("length"), F.max("size").alias("size"), F.count("*").alias("n"), F.count("hash").alias("read")))
    whole = (F.sum("length") == F.max("size")) & (F.sum("n") == F.sum("read"))
    top = F.sha2(F.expr("listagg(hash, '') WITHIN GROUP (ORDER BY node)").cast("binary"), 256)
    return low.groupBy("rel_path").agg(F.when(whole, top).alias("hash"))


def whole_content(chunks: DataFrame) -> DataFrame:
    """(rel_path, content) of files that fit into one value of at most 2 GiB."""
    return chunks.groupBy("rel_path").agg(F.expr("listagg(bytes, X'') WITHIN GROUP (ORDER BY chunk_idx)").alias("content"))


def differing_chunks(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rel_path, chunk_idx, offset) of the chunks that differ between files on both sides, or that
    only the longer one has: where a mismatch lies. Digests are joined, not bytes."""
    def side(x, name):
        return x.select("rel_path", "chunk_idx", "offset", F.sha2("bytes", 256).alias(name))

    both = side(a, "x").join(side(b, "y").withColumnRenamed("offset", "o"), ["rel_path", "chunk_idx"], "full_outer")
    paths = a.filter("chunk_idx = 0").select("rel_path").join(b.filter("chunk_idx = 0").select("rel_path"), "rel_path")
    return (both.filter(~F.col("x").eqNullSafe(F.col("y"))).join(paths, "rel_path", "left_semi")
            .select("rel_path", "chunk_idx", F.coalesce("offset", "o").alias("offset")))
