"""Several sources into one destination."""

import posixpath
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.globs import FilterChain
from driftline.operators.filtering import subtree
from driftline.plans.sync import SyncOptions, sync_plan


@dataclass(frozen=True)
class Source:
    """A source argument and its manifest; a single file has a manifest of one row."""

    arg: str
    manifest: DataFrame
    is_dir: bool = True

    @property
    def base(self) -> str:
        """Destination of the source below the destination root, empty for the root itself."""
        if self.is_dir and self.arg.endswith("/"):
            return ""
        return posixpath.basename(posixpath.normpath(self.arg))


def plan_sources(sources, d: DataFrame, chain=FilterChain(), opts=SyncOptions()) -> DataFrame:
    """One plan per source, side by side with `source_ord`, against the destination manifest `d`.

    Each directory source is compared with the subtree it lands in. Where several directory
    sources share a destination nothing is deleted, since each would remove the others' entries.
    A single file is copied as it is: neither the filter nor the skip test applies to it.
    """
    bases = [s.base for s in sources if s.is_dir]
    out = None
    for i, s in enumerate(sources):
        if s.is_dir:
            mine = replace(opts, dst_base=posixpath.join(opts.dst_base, s.base),
                           delete=opts.delete and bases.count(s.base) == 1)
            plan = sync_plan(s.manifest, subtree(d, s.base), chain, mine)
        else:
            mine = replace(opts, dst_base=opts.dst_base, dst_rows=False, hardlinks=False, delete=False)
            one = s.manifest.withColumn("rel_path", F.lit(s.base))
            plan = sync_plan(one, d, opts=mine).withColumn(
                "action", F.when(F.col("action") == "skip", "copy_changed").otherwise(F.col("action")))
        plan = plan.withColumn("source_ord", F.lit(i))
        out = plan if out is None else out.unionByName(plan)
    return out
