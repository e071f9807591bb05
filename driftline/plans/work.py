"""The work of a sync in one table: how, with whom, in which pieces and when each entry travels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordered import BLOCK, Scan, block_scan, range_blocks
from driftline.operators.packing import BatchConfig, number_batches
from driftline.plans.sync import WRITES, Capabilities, with_strategy


def work_plan(plan: DataFrame, caps=Capabilities(), bytes_per_s: int = None, batch=BatchConfig(), chunk_bytes=256 << 20,
              delta_min=64 * 1024, data: DataFrame = None, parts=None, block_rows=1 << 17, run_blocks=1024) -> DataFrame:
    """Every entry of a sync plan that is written, with all its columns, in path order:

    strategy                               how the bytes of a copy travel
    batch_id                               small copies that travel together; null for what travels alone
    chunk_idx, chunk_offset, chunk_length  pieces of copies above `chunk_bytes`, a row each; others are one piece
    est_start_s, est_end_s                 when a piece passes a token bucket of `bytes_per_s` (null without one)

    The order is sliced once. Positions for batches and bytes for the schedule are counted in one pass
    over the slices; only copies cost bytes. Batches are for destinations that take several files at
    once, so a local destination has none. `data` (rel_path, data_bytes), as `packing.data_bytes` gives
    it, makes copies between local trees cost only what is no hole, if the source can tell holes.
    """
    columns = plan.columns
    copies = F.col("action").isin("copy_new", "copy_changed")
    tasks = with_strategy(plan.filter(F.col("action").isin(*WRITES)), caps, delta_min)
    cost = F.when(copies, F.col("size")).otherwise(F.lit(0)).cast("bigint")
    if data is not None and caps.src_local and caps.dst_local and caps.src_sparse:
        tasks = tasks.join(data.select("rel_path", "data_bytes"), "rel_path", "left")
        cost = F.when(copies, F.coalesce("data_bytes", "size")).otherwise(F.lit(0)).cast("bigint")
    batches = caps.dst_batches and not caps.dst_local
    small = copies & (F.col("file_type") == "regular") & F.col("size").between(0, batch.size_limit)
    tasks = tasks.withColumns({"_cost": cost, "_ok": small if batches else F.lit(False)})
    placed = block_scan(range_blocks(tasks, [], ["rel_path"], parts), [], ["rel_path"],
                        {"_at": Scan("sum", F.lit(1), before=True), "_sum": Scan("sum", F.col("_cost"))}).drop(BLOCK)
    rows = (number_batches(placed, batch, block_rows=block_rows, run_blocks=run_blocks) if batches else
            placed.withColumn("batch_id", F.lit(None).cast("bigint")))
    last = F.greatest(F.expr(f"(_cost - 1) div {chunk_bytes}L"), F.lit(0))
    rows = (rows.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
            .withColumn("chunk_offset", F.col("chunk_idx") * chunk_bytes)
            .withColumn("chunk_length", F.least(F.lit(chunk_bytes).cast("bigint"), F.col("_cost") - F.col("chunk_offset"))))
    before = F.col("_sum") - F.col("_cost") + F.col("chunk_offset")

    def passed(total):
        if not bytes_per_s:
            return F.lit(None).cast("double")
        burst, rate = float(min(1 << 20, bytes_per_s)), float(bytes_per_s)
        return F.greatest(F.lit(0.0), (total.cast("double") - burst) / rate)

    return rows.select(*columns, "strategy", "batch_id", "chunk_idx", "chunk_offset", "chunk_length",
                       passed(before).alias("est_start_s"), passed(before + F.col("chunk_length")).alias("est_end_s"))
