"""The delta job end to end: sign the basis, match the source, rebuild, check digests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.content import CHUNK, as_chunks, file_sizes, is_chunked, tree_hashes
from driftline.operators.delta import MAX_BLOCK, delta_stats, match_lengths, match_signatures, rebuild_chunks, with_literals
from driftline.session import cut


def delta_ops(src: DataFrame, dst: DataFrame, delta_min=64 * 1024, chunk_bytes=CHUNK, reach=MAX_BLOCK) -> DataFrame:
    """Ops, without literal bytes, of the source files of at least `delta_min` bytes that have a basis,
    written once as a table. All others travel as they are and have no ops. Files below the threshold
    are left out where they are read."""
    size = F.col("size") if is_chunked(src) else F.octet_length("content")
    large = src.filter(size >= delta_min)
    sig = match_signatures(dst).join(file_sizes(large), "rel_path", "left_semi")
    return cut(match_lengths(large, sig, chunk_bytes, reach, unsigned=False))


def delta_sync(src: DataFrame, dst: DataFrame, delta_min=64 * 1024, chunk_bytes=CHUNK, reach=MAX_BLOCK) -> DataFrame:
    """Per source file the delta statistics and whether the rebuilt bytes equal the source, by digest
    trees over chunks. A file without ops arrives as it is read. Push and pull make no difference
    inside one cluster."""
    ops = delta_ops(src, dst, delta_min, chunk_bytes, reach)
    rebuilt = tree_hashes(rebuild_chunks(with_literals(ops, src, chunk_bytes), dst, chunk_bytes)).withColumnRenamed("hash", "rebuilt")
    stats = delta_stats(ops).drop("bytes", "saved_ratio")
    whole = file_sizes(src).filter("size > 0").join(tree_hashes(as_chunks(src, chunk_bytes)), "rel_path")
    same = F.when(F.col("matched_blocks").isNull(), F.col("hash").isNotNull()).otherwise(F.coalesce(F.col("hash") == F.col("rebuilt"), F.lit(False)))
    return (whole.join(stats, "rel_path", "left").join(rebuilt, "rel_path", "left")
            .select("rel_path", F.coalesce("matched_blocks", F.lit(0).cast("bigint")).alias("matched_blocks"),
                    F.coalesce("literal_bytes", "size").alias("literal_bytes"), F.col("size").alias("bytes"), same.alias("identical")))
