import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import packing
from driftline.operators.packing import BatchConfig

rng = random.Random(7)


def fold(rows, cfg):
    """The batcher one file at a time."""
    out, pending, size, batch = [], [], 0, 0

    def flush():
        nonlocal pending, size, batch
        for i in pending:
            out[i] = batch
        batch, pending, size = batch + bool(pending), [], 0
    for i, (_, kind, n) in enumerate(rows):
        out.append(None)
        if kind == "regular" and 0 <= n <= cfg.size_limit and not (size + n > cfg.max_bytes and pending):
            pending.append(i)
            size += n
            if len(pending) >= cfg.max_count or size >= cfg.max_bytes:
                flush()
        else:
            flush()
    flush()
    return out


CASES = [
    (0, BatchConfig(1000, 300, 5)), (1, BatchConfig(1000, 300, 5)), (60, BatchConfig(500, 600, 7)),
    (400, BatchConfig(2000, 400, 11)), (1500, BatchConfig(10**6, 10**5, 20)), (300, BatchConfig(100, 100, 3)), (300, BatchConfig(1, 1, 1)),
]


@pytest.mark.parametrize("n,cfg", CASES)
@pytest.mark.parametrize("block_rows,run_blocks", [(1, 4), (37, 3), (5000, 1024)])
def test_batches_equal_the_fold(spark, n, cfg, block_rows, run_blocks):
    rows = [(f"{i:06d}", "regular" if rng.random() > 0.03 else rng.choice(["dir", "symlink"]),
             rng.choice([0, 1, 10, 100, rng.randint(0, 400), 1000])) for i in range(n)]
    df = spark.createDataFrame(rows, "rel_path string, file_type string, size bigint").repartition(3)
    got = [r.batch_id for r in packing.pack_batches(df, cfg, block_rows=block_rows, run_blocks=run_blocks).orderBy("rel_path").collect()]
    assert got == fold(rows, cfg)


def test_batches_per_key(spark):
    cfg = BatchConfig(300, 200, 4)
    rows = [(k, f"{i:04d}", "regular", rng.randint(0, 250)) for i in range(200) for k in "ab"]
    df = spark.createDataFrame(rows, "dst string, rel_path string, file_type string, size bigint")
    out = packing.pack_batches(df, cfg, by=["dst"], block_rows=16, run_blocks=2).orderBy("rel_path").collect()
    for k in "ab":
        assert [r.batch_id for r in out if r.dst == k] == fold([r[1:] for r in sorted(rows) if r[0] == k], cfg)


def test_batch_limits(spark):
    df = spark.range(5000).select(F.format_string("%06d", "id").alias("rel_path"), F.lit("regular").alias("file_type"),
                                  (F.col("id") * 7919 % 70000).alias("size"))
    out = packing.pack_batches(df, block_rows=512).filter("batch_id is not null").groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("m"))
    assert out.filter(f"n > 100 or b > {4 << 20} or m > {64 << 10}").count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([("a", 10), ("b", 11), ("c", 20), ("d", 0), ("e", 25)], "rel_path string, size bigint")
    got = {}
    for r in packing.chunks(df, 10).orderBy("rel_path", "chunk_idx").collect():
        got.setdefault(r.rel_path, []).append((r.offset, r.length))
    assert got == {"b": [(0, 10), (10, 1)], "c": [(0, 10), (10, 10)], "e": [(0, 10), (10, 10), (20, 5)]}


def test_segments(spark):
    def seg(data):
        df = spark.createDataFrame([("f", bytearray(data))], "rel_path string, content binary")
        return [(r.offset, r.length, r.is_data) for r in packing.segments(df, 16).orderBy("offset").collect()]
    assert seg(b"A" * 32 + bytes(48) + b"B" * 20) == [(0, 32, True), (32, 48, False), (80, 20, True)]
    assert seg(bytes(40)) == [(0, 40, False)]
    assert seg(b"x" * 5) == [(0, 5, True)]
    assert seg(bytes(8) + b"x" + bytes(30)) == [(0, 16, True), (16, 23, False)]
    assert seg(b"") == []


def bucket(files, rate, burst):
    """A token bucket in small steps of one file: tokens refill up to the burst, debt is waited for."""
    tokens, now, out = float(burst), 0.0, []
    for size, arrival in files:
        start = max(now, arrival)
        tokens = min(burst, tokens + (start - now) * rate)
        tokens -= size
        now = start + max(0.0, -tokens / rate)
        tokens = max(tokens, 0.0)
        out.append(now)
    return out


@pytest.mark.parametrize("arrivals", [False, True])
def test_schedule_is_a_token_bucket(spark, arrivals):
    files = [(rng.randint(0, 3000), i * 0.7 if arrivals else 0.0) for i in range(80)]
    df = spark.createDataFrame([(f"{i:03d}", s, a) for i, (s, a) in enumerate(files)], "rel_path string, size bigint, arr double")
    out = packing.schedule(df, 1000, arrival=F.col("arr") if arrivals else None).orderBy("rel_path").collect()
    for r, want in zip(out, bucket(files, 1000, 1000)):
        assert r.est_end_s == pytest.approx(want, abs=1e-6)


def test_batch_outcomes(spark):
    files = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "c", 7), (2, "d", 8), (3, "e", 9)], "batch_id long, rel_path string, size long")
    res = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", True), (3, "e", True)], "batch_id long, rel_path string, ok boolean")
    lost = spark.createDataFrame([(3,)], "batch_id long")
    got = {r.batch_id: tuple(r)[1:] for r in packing.batch_outcomes(files, res, lost).collect()}
    assert got == {1: (1, 1, 0, 5), 2: (1, 0, 1, 7), 3: (0, 1, 0, 0)}
