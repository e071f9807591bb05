"""Following a walk through many chunks at once.

A chunk maps the place where a walk enters it to the place where the walk leaves it, and so enters
the next. Such maps are piecewise constant: `starts` are the first entries of the pieces, `exits`
where they lead. Maps of consecutive chunks compose to one map, so the chunks of a file are taken in
runs, and runs in runs of runs, each composed on its own; walks over the few top runs, then over runs,
then over chunks give every entry. No step has the chunks of a file in one group.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunks to a run, and runs to a run of runs: at 4 MiB a chunk, a top run covers 256 GiB.
RUN = 256


def follow(starts, exits, at):
    """Where entries `at` lead. Without a map the next chunk is entered at its start."""
    if starts is None or len(starts) == 0:
        return np.zeros_like(at)
    return np.asarray(exits)[np.searchsorted(starts, at, side="right") - 1]


def compose(first, then):
    """The map of two chunks, one after the other. (None, None) leads every entry to 0."""
    if first[0] is None or len(first[0]) == 0:
        first = np.zeros(1, np.int32), np.zeros(1, np.int32)
    starts, to = np.asarray(first[0]), follow(*then, np.asarray(first[1]))
    kept = np.flatnonzero(np.diff(to, prepend=to[0] - 1))
    return starts[kept], to[kept]


def _composed(batches):
    """Rows sorted by (rel_path, run, idx) to one composed map per run."""
    cols = ["rel_path", "idx", "n", "starts", "exits"]
    key, total, at = None, 0, None
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if (r.rel_path, r.run) != key:
                if key is not None:
                    out.append((*key, total, *at))
                key, total, at = (r.rel_path, r.run), -(-r.n // RUN), (r.starts, r.exits)
            else:
                at = compose(at, (r.starts, r.exits))
        yield pd.DataFrame(out, columns=cols)
    if key is not None:
        yield pd.DataFrame([(*key, total, *at)], columns=cols)


def _entered(batches):
    """Rows sorted by (rel_path, run, idx), each with the entry of its run, to the entry of each row."""
    key, at = None, 0
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if (r.rel_path, r.run) != key:
                key, at = (r.rel_path, r.run), int(r.entry)
            out.append((r.rel_path, r.idx, at))
            at = int(follow(r.starts, r.exits, np.array([at]))[0])
        yield pd.DataFrame(out, columns=["rel_path", "idx", "entry"])


def _in_runs(maps: DataFrame) -> DataFrame:
    return maps.withColumn("run", F.expr(f"idx div {RUN}L")).repartition("rel_path", "run")


def chain_entries(maps: DataFrame, levels=2) -> DataFrame:
    """(rel_path, idx, entry) for the `n` maps (rel_path, idx, n, starts, exits) of every file, idx from
    0; the walk enters the first at 0. `levels` times runs of RUN are composed before a walk."""
    order = ("rel_path", "run", "idx")
    if levels:
        # Files of one run need no entries from above.
        runs = (_in_runs(maps.filter(F.col("n") > RUN)).sortWithinPartitions(*order)
                .mapInPandas(_composed, "rel_path string, idx bigint, n bigint, starts array<int>, exits array<int>"))
        above = chain_entries(runs, levels - 1).select("rel_path", F.col("idx").alias("run"), "entry")
        dealt = _in_runs(maps).join(above, ["rel_path", "run"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    else:
        dealt = maps.withColumn("run", F.lit(0)).withColumn("entry", F.lit(0)).repartition("rel_path")
    return dealt.sortWithinPartitions(*order).mapInPandas(_entered, "rel_path string, idx bigint, entry int")
