"""Work units: chunks of large files, batches of small ones, data segments, a rate-capped schedule."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators.ordered import BLOCK, Scan, block_scan, ordered_scan, range_blocks
from driftline.session import cut


def chunks(plan: DataFrame, chunk_bytes=256 << 20) -> DataFrame:
    """Offset and length of every piece of files above `chunk_bytes`; the last piece is short."""
    n = F.lit(chunk_bytes).cast("bigint")
    return (plan.filter(F.col("size") > chunk_bytes)
            .select("rel_path", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {chunk_bytes}L)")).alias("chunk_idx"))
            .select("rel_path", "chunk_idx", (F.col("chunk_idx") * n).alias("offset"),
                    F.least(n, F.col("size") - F.col("chunk_idx") * n).alias("length")))


@dataclass(frozen=True)
class BatchConfig:
    max_bytes: int = 4 << 20
    size_limit: int = 64 << 10
    max_count: int = 100


def _batch_ends(ok: np.ndarray, size: np.ndarray, cfg: BatchConfig):
    """For every position taken as a batch start: the end of the batch (exclusive) and the next
    start. A file that would overflow the batch, and any file that may not be batched, closes it
    and travels alone."""
    n = len(ok)
    at = np.arange(n)
    prefix = np.concatenate([[0], np.cumsum(size)])
    full = np.searchsorted(prefix[1:], prefix[:-1] + cfg.max_bytes)      # bytes reach the maximum here
    over = (full < n) & (prefix[np.minimum(full, n - 1) + 1] - prefix[:-1] > cfg.max_bytes) & (full > at)
    count = at + cfg.max_count - 1                                       # the count is reached here
    bad = np.flatnonzero(~ok)
    stop = np.append(bad, n)[np.searchsorted(bad, at)]                   # next file that may not be batched
    by_bytes = (full <= count) & (full < n)
    last = np.minimum(full, count)
    alone = by_bytes & over
    end = np.where(alone, full, np.minimum(last + 1, n))
    nxt = np.where(alone, full + 1, end)
    cut = (stop <= last) & (stop < n)
    end = np.where(cut, stop, end)
    nxt = np.where(cut, stop + 1, nxt)
    return np.where(ok, end, at), np.where(ok, nxt, at + 1)


def _block_table(cfg: BatchConfig, block_rows: int, by):
    """Per block, for every offset at which the first batch may start: where the next block's
    first batch starts, how many of its rows still belong to the last batch, batches begun."""
    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        block = int(pdf["_blk"].iloc[0])
        m = int((pdf["_at"] < (block + 1) * block_rows).sum())
        end, nxt = (a.tolist() for a in _batch_ends(pdf["_ok"].to_numpy(), pdf["size"].to_numpy(), cfg))
        leave, spill, begun = [0] * m, [0] * m, [0] * m
        for i in range(m - 1, -1, -1):
            j = nxt[i]
            starts = end[i] > i
            if j < m:
                leave[i], spill[i], begun[i] = leave[j], spill[j], begun[j] + starts
            else:
                leave[i], spill[i], begun[i] = j - m, max(0, end[i] - m), int(starts)
        k = min(m, cfg.max_count)
        row = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame([{**row, "at": block, "m": m, "leave": leave[:k], "spill": spill[:k], "begun": begun[:k]}])
    return table


def _follow(rows, entry, spill, base):
    """Offsets at which a walk enters each of some consecutive blocks, and where it ends up."""
    entered = []
    for r in rows:
        entered.append((r.at, entry, spill, base))
        if entry < r.m:
            base += r.begun[entry]
            entry, spill = r.leave[entry], r.spill[entry]
    return entered, (entry, spill, base)


def _compose(by):
    """The table of a run of consecutive blocks, by following every offset through them."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("at").itertuples())
        ends = [_follow(rows, e, 0, 0)[1] for e in range(len(rows[0].leave))]
        leave, spill, begun = (list(c) for c in zip(*ends))
        row = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame([{**row, "run": pdf["run"].iloc[0], "at": pdf["run"].iloc[0], "m": rows[0].m,
                              "leave": leave, "spill": spill, "begun": begun}])
    return compose


def _enter(by, inside):
    """Entry of every run of blocks or, `inside` a run whose own entry is known, of its blocks."""
    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        start = [int(pdf[c].iloc[0]) for c in ("entry", "spilled", "base")] if inside else (0, 0, 0)
        entered, _ = _follow(pdf.sort_values("at").itertuples(), *start)
        got = pd.DataFrame(entered, columns=["at", "entry", "spilled", "base"])
        for c in by:
            got[c] = pdf[c].iloc[0]
        return got
    return enter


def _number_batches(cfg: BatchConfig, out: list):
    """Rows of a block, with the entry of the walk, to the same rows with their batch."""
    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        entry, spill, batch = (rows.column(c)[0].as_py() for c in ("entry", "spilled", "base"))
        end, nxt = (a.tolist() for a in _batch_ends(rows.column("_ok").to_numpy(), rows.column("_size").to_numpy(), cfg))
        ids = np.full(rows.num_rows, -1, dtype=np.int64)
        ids[:spill] = batch - 1
        i = entry
        while i < rows.num_rows:
            if end[i] > i:
                ids[i:end[i]] = batch
                batch += 1
            i = nxt[i]
        return rows.select(out).append_column("batch_id", pa.array(ids, mask=ids < 0))
    return number


def pack_batches(plan: DataFrame, cfg=BatchConfig(), by=(), block_rows=1 << 17, run_blocks=1024, parts=None) -> DataFrame:
    """Greedy small-file batches in path order, exact and in parallel; batch_id is null for files
    that travel alone. `by` starts a separate order per key (for example a destination). All columns
    of `plan` stay."""
    ok = (F.col("file_type") == "regular") & F.col("size").between(0, cfg.size_limit)
    rows = ordered_scan(plan.withColumn("_ok", ok), list(by), ["rel_path"], {"_at": Scan("sum", F.lit(1), before=True)}, parts)
    return number_batches(rows, cfg, by, block_rows, run_blocks).select(*plan.columns, "batch_id")


def number_batches(rows: DataFrame, cfg=BatchConfig(), by=(), block_rows=1 << 17, run_blocks=1024) -> DataFrame:
    """`rows`, with their position in the order (`_at`) and whether they may be batched (`_ok`), and
    their batch.

    A batch spans at most `max_count` files, so what a block of rows needs to know about the
    blocks before it is one offset below `max_count`. Each block first gives its outcome for
    every such offset, runs of blocks are composed to one table each, and the few run tables are
    chained. Then each run enters its blocks and each block numbers its batches.
    """
    by = list(by)
    block_rows = max(block_rows, cfg.max_count)
    columns = rows.columns
    rows = (rows.withColumn("_size", F.coalesce("size", F.lit(0)).cast("bigint")).withColumn("_ok", F.coalesce("_ok", F.lit(False)))
            .withColumn("_blk", F.floor(F.col("_at") / block_rows).cast("bigint")))
    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in by)
    table = keys + "at bigint, m int, leave array<int>, spill array<int>, begun array<bigint>"
    entry = keys + "at bigint, entry int, spilled int, base bigint"

    lead = (F.pmod(F.col("_at"), F.lit(block_rows)) < cfg.max_count) & (F.col("_blk") > 0)
    ahead = rows.select(*by, "_at", "_ok", F.col("_size").alias("size"), F.explode(
        F.when(lead, F.array(F.col("_blk"), F.col("_blk") - 1)).otherwise(F.array("_blk"))).alias("_blk"))
    blocks = cut(ahead.groupBy(*by, "_blk").applyInPandas(_block_table(cfg, block_rows, by), table)
                 .withColumn("run", F.expr(f"at div {run_blocks}")))
    runs = blocks.groupBy(*by, "run").applyInPandas(_compose(by), table + ", run bigint")
    run_entries = runs.groupBy(*by).applyInPandas(_enter(by, inside=False), entry).withColumnRenamed("at", "run")
    entries = (blocks.join(run_entries, [*by, "run"]).groupBy(*by, "run")
               .applyInPandas(_enter(by, inside=True), entry).withColumnRenamed("at", "_blk"))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)
    return rows.join(entries, [*by, "_blk"]).groupBy(*by, "_blk").applyInArrow(_number_batches(cfg, columns), shape + ", batch_id bigint")


def approximate_batches(plan: DataFrame, cfg=BatchConfig(), parts=None) -> DataFrame:
    """Batches of about `max_bytes` by running size, without the exact limits."""
    small = plan.filter((F.col("file_type") == "regular") & F.col("size").between(0, cfg.size_limit))
    done = ordered_scan(small, [], ["rel_path"], {"_upto": Scan("sum", F.col("size"), before=True)}, parts)
    return done.withColumn("batch_id", F.floor(F.col("_upto") / cfg.max_bytes)).drop("_upto")


def batch_outcomes(files: DataFrame, results: DataFrame, failed_batches: DataFrame = None) -> DataFrame:
    """Copied, failed and unanswered files per batch. `files` is (batch_id, rel_path, size),
    `results` (batch_id, rel_path, ok); an entry in `failed_batches` fails all its files."""
    j = files.join(results.select("batch_id", "rel_path", "ok"), ["batch_id", "rel_path"], "left")
    ok = F.col("ok")
    if failed_batches is not None:
        j = j.join(failed_batches.select("batch_id", F.lit(True).alias("_broken")).distinct(), "batch_id", "left")
        ok = F.when(F.col("_broken"), False).otherwise(ok)
    return j.groupBy("batch_id").agg(
        F.count_if(ok).alias("copied"), F.count_if(~ok).alias("failed"),
        F.count_if(ok.isNull()).alias("unanswered"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("bytes"))


def segments(content: DataFrame, block=4096) -> DataFrame:
    """Runs of data and of holes that tile each file. A hole is a run of aligned blocks that are
    all zero. Runs are found within the row that holds the bytes: only runs become rows, and
    nothing is shuffled."""
    size = F.octet_length("content")
    zero = F.lit(bytearray(block))
    piece = lambda b: F.substring("content", (b * block + 1).cast("int"), F.lit(block))
    blocks = F.expr(f"sequence(0, (octet_length(content) - 1) div {block})")
    marked = (content.filter(size > 0)
              .select("rel_path", size.cast("bigint").alias("size"), F.transform(
                  blocks, lambda b: piece(b) != F.substring(zero, F.lit(1), F.octet_length(piece(b)))).alias("_data")))
    starts = marked.withColumn("_starts", F.filter(
        F.sequence(F.lit(0), F.size("_data") - 1), lambda b: (b == 0) | (F.get("_data", b) != F.get("_data", b - 1))))
    runs = starts.select("rel_path", F.explode(F.transform("_starts", lambda b, k: F.struct(
        (b.cast("bigint") * block).alias("offset"),
        F.coalesce(F.get("_starts", k + 1).cast("bigint") * block, F.col("size")).alias("end"),
        F.get("_data", b).alias("is_data")))).alias("r"))
    return runs.select("rel_path", "r.offset", (F.col("r.end") - F.col("r.offset")).alias("length"), "r.is_data")


def data_bytes(segs: DataFrame) -> DataFrame:
    """Bytes to move and bytes saved by holes, per file."""
    def total(c):
        return F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0))
    return segs.groupBy("rel_path").agg(total(F.col("is_data")).alias("data_bytes"), total(~F.col("is_data")).alias("hole_bytes"))


def schedule(plan: DataFrame, bytes_per_s: int, order=("rel_path",), arrival: Column = None, parts=None) -> DataFrame:
    """Start and end in seconds when the files pass one after another through a token bucket with
    the given rate and a burst of min(1 MiB, rate). With `arrival` (seconds) a file cannot start
    before it has arrived."""
    burst = float(min(1 << 20, bytes_per_s))
    rate = float(bytes_per_s)
    rows = plan.filter(F.col("size") >= 0)
    if arrival is None:
        done = ordered_scan(rows, [], order, {"_sum": Scan("sum", F.col("size"))}, parts)
        def at(c):
            return F.greatest(F.lit(0.0), (c.cast("double") - burst) / rate)
        return (done.withColumn("est_start_s", at(F.col("_sum") - F.col("size")))
                    .withColumn("est_end_s", at(F.col("_sum"))).drop("_sum"))
    rows = rows.withColumn("_arr", arrival.cast("double"))
    # Both scans go over the same slices of the order.
    done = block_scan(range_blocks(rows, [], order, parts), [], order, {"_sum": Scan("sum", F.col("size"))})
    idle = F.col("_arr") - (F.col("_sum") - F.col("size")).cast("double") / rate
    done = block_scan(done.withColumn("_idle", idle), [], order, {"_lag": Scan("max", F.col("_idle"))})
    end = F.greatest(F.col("_arr"), (F.col("_sum").cast("double") - burst) / rate + F.col("_lag"))
    return (done.withColumn("est_start_s", F.col("_arr")).withColumn("est_end_s", end)
                .drop("_sum", "_idle", "_lag", "_arr", BLOCK))
