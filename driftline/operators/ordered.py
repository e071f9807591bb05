"""Prefix scans over an order without sorting everything in one task.

A running sum, maximum or "last value so far" splits into three steps: a window inside each
block, one summary row per block, and a window over the summaries that carries the state into
the next block. Blocks hold a slice of the order, so one hot key (a run with a third of all
events, a plan without any key) is spread over many tasks.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.session import cut

BLOCK = "_block"


@dataclass(frozen=True)
class Scan:
    """kind: sum, max or last (last non-null). `before` leaves the row itself out."""

    kind: str
    col: Column
    before: bool = False


def range_blocks(df: DataFrame, by, order, parts=None) -> DataFrame:
    """Range-partition on (by, order) and name each slice in `_block`. Without `parts` the
    adaptive engine sizes the slices; merged neighbours keep the order. The result is cut, so the
    slices stay the same when a lost executor's work is redone."""
    keys = [F.col(c) for c in (*by, *order)]
    sliced = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return cut(sliced.withColumn(BLOCK, F.spark_partition_id()))


def block_scan(df: DataFrame, by, order, scans: dict, block=BLOCK) -> DataFrame:
    """Add one column per scan to a table whose `block` column rises with the order."""
    by, order = list(by), list(order)
    at = F.struct(*order)
    inside = W.partitionBy(*by, block).orderBy(*order)
    across = W.partitionBy(*by).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    prior = inside.rowsBetween(W.unboundedPreceding, -1)

    window = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    total = {"sum": F.sum, "max": F.max,
             "last": lambda c: F.max_by(c, F.when(c.isNotNull(), at))}
    merge = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": lambda a, b: F.greatest(a, b),
        "last": lambda a, b: F.coalesce(b, a),
    }

    local = df.select("*", *[window[s.kind](s.col).over(prior if s.before else upto).alias(f"_in_{n}")
                             for n, s in scans.items()])
    summary = df.groupBy(*by, block).agg(*[total[s.kind](s.col).alias(f"_{n}") for n, s in scans.items()])
    carry = summary.select(*by, block, *[window[s.kind](F.col(f"_{n}")).over(across).alias(f"_up_{n}")
                                         for n, s in scans.items()])
    out = local.join(carry, [*by, block])
    kept = [F.col(c) for c in df.columns]
    return out.select(*kept, *[merge[s.kind](F.col(f"_up_{n}"), F.col(f"_in_{n}")).alias(n)
                               for n, s in scans.items()])


def ordered_scan(df: DataFrame, by, order, scans: dict, parts=None) -> DataFrame:
    """`block_scan` over range slices of the rows; `order` must be unique within `by`."""
    return block_scan(range_blocks(df, by, order, parts), by, order, scans).drop(BLOCK)


def trailing_frames(df: DataFrame, by, index: str, n: int, exprs: dict, block_rows=4096) -> DataFrame:
    """Window columns over the last `n` rows of a dense integer `index`. Each block also gets
    copies of the n-1 rows before it, so no window holds more than block_rows + n rows."""
    block_rows = max(block_rows, n)
    blk = F.floor(F.col(index) / block_rows)
    last_of_next = F.pmod(F.col(index), F.lit(block_rows)) >= block_rows - (n - 1)
    copies = F.when(last_of_next, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = (df.withColumn("_ahead", F.explode(copies))
                .withColumn(BLOCK, blk + F.col("_ahead")))
    w = W.partitionBy(*by, BLOCK).orderBy(index).rowsBetween(-(n - 1), W.currentRow)
    return (spread.select("*", *[f(w).alias(c) for c, f in exprs.items()])
                  .filter("_ahead = 0").drop("_ahead", BLOCK))
