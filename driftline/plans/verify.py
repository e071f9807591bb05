"""Content verification by digest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.globs import FilterChain


def file_hashes(content: DataFrame) -> DataFrame:
    """SHA-256 of every file. Computed where the bytes are read; only digests are shuffled."""
    return content.select("rel_path", F.sha2("content", 256).alias("hash"))


def _compare(both: DataFrame) -> DataFrame:
    status = (F.when(F.col("s").isNull(), "src_error").when(F.col("d").isNull(), "dst_error")
               .when(F.col("s") == F.col("d"), "ok").otherwise("mismatch"))
    return both.select(
        "rel_path", F.coalesce("s", F.lit("error")).alias("src_hash"),
        F.when(F.col("s").isNull(), "n/a").otherwise(F.coalesce("d", F.lit("error"))).alias("dst_hash"),
        status.alias("status"))


def verify(src_hashes: DataFrame, dst_hashes: DataFrame) -> DataFrame:
    """Compare digests of paths on both sides; a null digest stands for a read error."""
    return _compare(src_hashes.select("rel_path", F.col("hash").alias("s")).join(
        dst_hashes.select("rel_path", F.col("hash").alias("d")), "rel_path"))


def verify_trees(s: DataFrame, d: DataFrame, src_content: DataFrame, dst_content: DataFrame,
                 chain=FilterChain(), hashes=file_hashes) -> DataFrame:
    """Verify the regular destination files that pass the filter (each path on its own, no
    pruning) and have a source entry. Files missing on either side are no failure; a file whose
    content cannot be read is. `hashes` gives (rel_path, hash); `content.tree_hashes` serves contents in
    chunks, for files of any size."""
    files = (d.filter((F.col("file_type") == "regular") & chain.matches()).select("rel_path")
              .join(s.select("rel_path"), "rel_path", "left_semi"))
    # The rules need the path only, so excluded files are never hashed.
    wanted = FilterChain(chain.rules).matches(is_dir=F.lit(False))
    src, dst = (hashes(c.filter(wanted)).withColumnRenamed("hash", n)
                for c, n in ((src_content, "s"), (dst_content, "d")))
    return _compare(files.join(src, "rel_path", "left").join(dst, "rel_path", "left"))


def verify_summary(v: DataFrame) -> DataFrame:
    return v.groupBy("status").agg(F.count("*").alias("files"))


def verify_failures(v: DataFrame) -> DataFrame:
    return v.filter("status <> 'ok'")
