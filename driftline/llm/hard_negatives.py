"""Hard negatives by the threshold algorithm over signed sorted lists.

Rows are dealt into blocks by the hash of their id, so that no label, however common, is one task.
A block keeps one list per dimension, its rows sorted by that component. A query vector reads every
list from the end that helps its score: the largest components where its own is positive, the smallest
where it is negative. Rows met for the first time are scored in whole (random access); a row not yet
met in any list scores at most the sum of the query's components times the components last read, the
threshold. Reading stops once the threshold lies strictly below what every window still needs: the
score of its k-th row, or its lower end while it has fewer. So ties are never cut, and no row that
belongs to an answer is missed. The answers of blocks are merged by Spark.

The first pass finds the positives of each anchor, the best other rows of its label; the second finds,
for the window of scores each positive opens, the best rows of other labels. Anchors are a stated
query set: blocks of anchors meet blocks of all rows, and nothing is broadcast.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no
part; vectors are padded with zeros to the longest of a block; integer components lie within 2**25,
larger ones count as that; rows equal in id, label and vector are one row, and a row is no candidate
for an anchor of the same id; ties go to the smaller id; anchors without positives, and windows
without rows, have no result rows; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches

# Rows and anchors that meet in one task.
BLOCK = 8192
ANCHORS = 1024
LARGEST = 1 << 25


@dataclass(frozen=True)
class Mining:
    """A negative's score lies between `low` and `high` percent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def whole_components(vector: Column, scale=256) -> Column:
    """floor(scale * x) of every component, x as double; null if a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    low, high = F.lit(float(-LARGEST)), F.lit(float(LARGEST))
    return F.when(~bad, F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, high), low)).cast("int")))


class Lists:
    """Rows of a block with their sorted lists, one per dimension."""

    def __init__(self, ids: np.ndarray, q: np.ndarray):
        self.ids, self.q = ids, q
        self.largest = int(np.abs(q).max(initial=0))
        # Sums of products stay exact in doubles up to 2**53, where the faster product may be used.
        self.exact = q.astype(np.float64)
        self.order = np.ascontiguousarray(np.argsort(q, axis=0, kind="stable").T)
        self.values = np.take_along_axis(q.T, self.order, axis=1)

    def score(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:
            return (self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.q[rows] @ anchor


def threshold_search(lists: Lists, anchor: np.ndarray, allowed: np.ndarray, windows, first=16):
    """Per window (low, high, k), of which low may be None: up to k rows with scores in it, best first,
    and the scores by row. The depth of reading doubles."""
    n = len(lists.ids)
    score, seen = np.zeros(n, np.int64), np.zeros(n, bool)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)

    def inside(low, high):
        at = seen & allowed & (score <= high)
        return at if low is None else at & (score >= low)

    def settled(bound, low, high, k):
        """No row unseen can enter the window, or change what it holds."""
        if low is not None and (low > high or bound < low):
            return True
        if bound > high:
            return False
        own = score[inside(low, high)]
        return len(own) >= k and bound < np.partition(own, len(own) - k)[len(own) - k]

    depth, step = 0, first if len(up) + len(down) else n
    while depth < n:
        upto = min(n, depth + step)
        new = np.zeros(n, bool)
        new[lists.order[up, n - upto:n - depth].ravel()] = True
        new[lists.order[down, depth:upto].ravel()] = True
        if upto == n:
            new[:] = True
        rows = np.flatnonzero(new & ~seen)
        score[rows] = lists.score(rows, anchor)
        seen[rows] = True
        bound = int(lists.values[up, n - upto] @ anchor[up] + lists.values[down, upto - 1] @ anchor[down])
        if seen.all() or all(settled(bound, *w) for w in windows):
            break
        depth, step = upto, 2 * step
    found = []
    for low, high, k in windows:
        rows = np.flatnonzero(inside(low, high))
        if len(rows) > k:
            least = np.partition(score[rows], len(rows) - k)[len(rows) - k]
            rows = rows[score[rows] >= least]
        found.append(rows[np.lexsort((lists.ids[rows], -score[rows]))][:k])
    return found, score


def _vectors(column, width: int) -> np.ndarray:
    """Rows of integer components, padded to `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy().astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _once(table: pa.Table) -> pa.Table:
    """Rows of one key once; `key` stands for id, label and vector."""
    _, first = np.unique(table.column("key").to_numpy(), return_index=True)
    return table if len(first) == table.num_rows else table.take(np.sort(first))


def _sides(table: pa.Table):
    width = int(np.diff(table.column("q").combine_chunks().offsets.to_numpy()).max(initial=0))
    for role in (0, 1):
        own = _once(table.filter(pa.array(table.column("role").to_numpy() == role)))
        yield own, own.column("id").to_numpy(), own.column("label").to_numpy(), _vectors(own.column("q"), width)


BEST = "key bigint, positive_id bigint, positive_score bigint"


def _positives(k: int):
    def run(table: pa.Table) -> pa.Table:
        (_, ids, labels, q), (anchors, anchor_ids, anchor_labels, aq) = _sides(table)
        keys, out = anchors.column("key").to_numpy(), []
        for label in np.unique(anchor_labels).tolist():
            mine = labels == label
            lists = Lists(ids[mine], q[mine])
            for a in np.flatnonzero(anchor_labels == label).tolist():
                (rows,), score = threshold_search(lists, aq[a], lists.ids != anchor_ids[a], [(None, np.iinfo(np.int64).max, k)])
                out += [(keys[a], lists.ids[r], score[r]) for r in rows]
        cols = list(zip(*out)) if out else [()] * 3
        return pa.table({n: pa.array(np.array(c, np.int64)) for n, c in zip(("key", "positive_id", "positive_score"), cols)})

    return run


FOUND = "key bigint, anchor_id bigint, slot int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _negatives(cfg: Mining):
    def run(table: pa.Table) -> pa.Table:
        (_, ids, labels, q), (anchors, anchor_ids, anchor_labels, aq) = _sides(table)
        lists, out = Lists(ids, q), []
        for a, (key, chosen) in enumerate(zip(anchors.column("key").to_pylist(), anchors.column("positives").to_pylist())):
            scores = [p["positive_score"] for p in chosen]
            windows = [(-(-cfg.low * s // 100), cfg.high * s // 100, cfg.negatives) for s in scores]
            allowed = (labels != anchor_labels[a]) & (ids != anchor_ids[a])
            found, score = threshold_search(lists, aq[a], allowed, windows)
            for slot, (p, rows) in enumerate(zip(chosen, found)):
                out += [(key, int(anchor_ids[a]), slot, p["positive_id"], p["positive_score"], int(ids[r]), int(score[r])) for r in rows]
        cols = list(zip(*out)) if out else [()] * 7
        kinds = [pa.int32() if k == 2 else pa.int64() for k in range(7)]
        return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(FOUND.split(", "), cols, kinds)})

    return run


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int) -> DataFrame:
    """Every block of rows beside every block of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    none = F.lit(None).cast(anchors.schema["positives"].dataType)
    shape = ("role", "block", "group", "key", "id", "label", "q", "positives")
    left = rows.withColumns({"role": F.lit(0), "block": place(blocks), "group": every(groups), "positives": none})
    right = anchors.withColumns({"role": F.lit(1), "block": every(blocks), "group": place(groups)})
    return left.select(*shape).unionAll(right.select(*shape)).groupBy("block", "group")


def hard_negatives(rows: DataFrame, is_anchor: Column, cfg=Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for `rows` (id,
    label, q), q whole components; `is_anchor` is a condition on id."""
    spark = rows.sparkSession
    bounded_batches(spark, rows=4096)
    rows = (rows.filter("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
            .select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "q")
            .withColumn("key", F.xxhash64("id", "label", "q")))
    anchors = rows.filter(is_anchor)
    n, m = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // BLOCK), min(-(-n // 256), spread))
    groups = max(1, -(-m // ANCHORS))

    none = F.lit(None).cast("array<struct<rank:int,positive_id:bigint,positive_score:bigint>>")
    best = _meet(rows, anchors.withColumn("positives", none), blocks, groups).applyInArrow(_positives(cfg.positives), BEST)
    order = W.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    chosen = (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.positives)
              .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives")))
    found = _meet(rows, anchors.join(chosen, "key"), blocks, groups).applyInArrow(_negatives(cfg), FOUND)
    order = W.partitionBy("key", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
