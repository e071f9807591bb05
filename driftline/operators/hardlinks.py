"""Paths that share an inode."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.groups import HOT_GROUPS, lookup_groups
from driftline.session import cut


def hardlink_groups(m: DataFrame) -> DataFrame:
    """One row per inode with several paths: first path, member count and bytes saved by linking.
    The members themselves are the rows of `hardlink_targets`; no list is collected."""
    return (m.filter((F.col("file_type") == "regular") & (F.col("nlink") > 1))
             .groupBy("dev", "ino")
             .agg(F.min("rel_path").alias("first_path"), F.count("*").alias("n"), F.max("size").alias("size"))
             .filter("n > 1")
             .select("dev", "ino", "first_path", "n", ((F.col("n") - 1) * F.col("size")).alias("bytes_saved")))


def hardlink_targets(m: DataFrame, hot_groups=HOT_GROUPS) -> DataFrame:
    """(rel_path, first_path) for every path that links to an earlier path of its inode. The paths with
    several links are written once, so that the manifest is read once."""
    linked = cut(m.filter((F.col("file_type") == "regular") & (F.col("nlink") > 1)).select("rel_path", "dev", "ino"))
    groups = linked.groupBy("dev", "ino").agg(F.min("rel_path").alias("first_path"), F.count("*").alias("n"))
    return (lookup_groups(linked, groups.filter("n > 1"), ["dev", "ino"], hot_groups=hot_groups)
            .filter("rel_path <> first_path").select("rel_path", "first_path"))
