"""Filters and projections over manifests."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.globs import FilterChain
from driftline.functions.paths import depth


def known_types(m: DataFrame) -> DataFrame:
    """Directories, symlinks and regular files; sockets and devices are dropped."""
    return m.filter(F.col("file_type").isin("dir", "symlink", "regular"))


def apply_filter(m: DataFrame, chain: FilterChain, prune: bool = True) -> DataFrame:
    """Entries the chain keeps; with `prune` an excluded directory takes its subtree along."""
    return m.filter(chain.keeps(prune))


def subtree(m: DataFrame, prefix: str = "", max_depth: int = None) -> DataFrame:
    """Entries below `prefix`, with paths relative to it; `max_depth=1` lists its children."""
    if prefix:
        p = prefix.strip("/") + "/"
        m = (m.filter(F.col("rel_path").startswith(p))
              .withColumn("rel_path", F.substring(F.col("rel_path"), len(p) + 1, 1 << 30)))
    return m.filter(depth("rel_path") <= max_depth) if max_depth else m


def orphan_temps(m: DataFrame, suffix: str) -> DataFrame:
    """Temporary files an interrupted run left behind: `.<name>.<tag>.<suffix>`."""
    pattern = r"(^|/)\.[^/]+\.[^/.]+\." + re.escape(suffix.lstrip(".")) + r"\z"
    return m.filter((F.col("file_type") == "regular") & F.col("rel_path").endswith("." + suffix.lstrip("."))
                    & F.col("rel_path").rlike(pattern))


def prescan(m: DataFrame, chain: FilterChain = FilterChain(), prune: bool = True) -> DataFrame:
    """One row: count and bytes of the regular files that pass, skipped ones included."""
    kept = m.filter((F.col("file_type") == "regular") & chain.keeps(prune))
    return kept.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
