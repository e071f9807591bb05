"""Contents in chunks: reading, digest trees, signatures, matching and rebuilding without a whole file."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_delta import PAIRS, greedy
from test_physical import explain

from driftline.operators import chains, content, delta
from driftline.plans.delta_sync import delta_sync
from driftline.plans.verify import verify_trees
from driftline.sources.chunks import chunks_of, read_chunks


def tree_hash(data, n, fanout):
    level = [hashlib.sha256(data[k:k + n]).hexdigest() for k in range(0, max(1, len(data)), n)]
    level = [hashlib.sha256("".join(level[k:k + fanout]).encode()).hexdigest() for k in range(0, len(level), fanout)]
    return hashlib.sha256("".join(level).encode()).hexdigest()


@pytest.fixture(scope="module")
def chunked(spark):
    def table(i, n):
        rows = [(name, len(v[i]), k, k * n, bytearray(v[i][k * n:k * n + n])) for name, v in PAIRS.items() for k in range(max(1, -(-len(v[i]) // n)))]
        return spark.createDataFrame(rows, "rel_path string, size bigint, chunk_idx bigint, offset bigint, bytes binary").repartition(3)
    return table


def test_digest_tree(chunked):
    got = {r.rel_path: r.hash for r in content.tree_hashes(chunked(0, 700), 3).collect()}
    assert got == {name: tree_hash(s, 700, 3) for name, (s, _) in PAIRS.items()}
    # A lost or unreadable chunk is an error, not another file.
    holes = chunked(0, 700).filter("rel_path <> 'shifted' OR chunk_idx <> 2").withColumn(
        "bytes", F.when(F.expr("rel_path = 'grown' AND chunk_idx = 1"), None).otherwise(F.col("bytes")))
    got = {r.rel_path: r.hash for r in content.tree_hashes(holes, 3).collect()}
    assert got["shifted"] is None and got["grown"] is None and got["zeros"] is not None


@pytest.mark.parametrize("n", [512, 700, 5000])
def test_signatures_of_chunks(chunked, spark, n):
    whole = spark.createDataFrame([(k, bytearray(v[1])) for k, v in PAIRS.items()], "rel_path string, content binary")
    names = ["rel_path", "block_idx", "offset", "length", "block_size", "weak", "strong"]
    assert sorted(delta.signatures(chunked(1, n)).select(names).collect()) == sorted(delta.signatures(whole).select(names).collect())


@pytest.mark.parametrize("n,together,run", [(512, 1, 2), (700, 3, 3), (3000, 16, 256)])
def test_match_and_rebuild_by_chunks(chunked, monkeypatch, n, together, run):
    monkeypatch.setattr(delta, "TOGETHER", together)
    monkeypatch.setattr(delta, "SPREAD", together)
    monkeypatch.setattr(chains, "RUN", run)
    src, dst = chunked(0, n), chunked(1, n)
    ops = delta.match_blocks(src, delta.match_signatures(dst), n, reach=512)
    got = {}
    for r in delta.numbered(ops).orderBy("rel_path", "seq").collect():
        mine = got.setdefault(r.rel_path, [])
        if r.block_idx < 0 and mine and mine[-1][0] < 0:
            mine[-1] = (-1, mine[-1][1] + r.length)
        else:
            mine.append((r.block_idx, r.length))
    rebuilt = delta.rebuild_chunks(ops, dst, n).collect()
    assert max(len(r.bytes) for r in rebuilt) <= n
    files = {}
    for r in sorted(rebuilt, key=lambda r: (r.rel_path, r.chunk_idx)):
        assert r.offset == r.chunk_idx * n == len(files.get(r.rel_path, b"")) and r.size == len(PAIRS[r.rel_path][0])
        files[r.rel_path] = files.get(r.rel_path, b"") + bytes(r.bytes)
    for name, (s, b) in PAIRS.items():
        assert got.get(name, []) == greedy(s, b), name
        assert files.get(name, b"") == s, name


def test_job_over_chunks(chunked):
    out = {r.rel_path: r for r in delta_sync(chunked(0, 1000), chunked(1, 1000), delta_min=100, chunk_bytes=1000, reach=512).collect()}
    assert all(r.identical for r in out.values()) and set(out) == {n for n, (s, _) in PAIRS.items() if s}
    assert out["identical"].literal_bytes == 0 and out["small_tail"].literal_bytes == 53


def test_chunk_lengths_must_agree(chunked):
    src = chunked(0, 700)
    with pytest.raises(Exception, match="chunks are not of 512 bytes"):
        delta.match_blocks(src, delta.match_signatures(src), 512, reach=512).collect()


def test_maps_compose_over_long_files(spark, monkeypatch):
    monkeypatch.setattr(chains, "RUN", 3)
    r, rows, want = random.Random(1), [], {}
    for f, n in enumerate([1, 2, 3, 4, 9, 10, 28, 40]):
        at = 0
        for k in range(n):
            want[f"f{f}", k] = at
            if k == n - 1 or r.random() < 0.1:
                starts = to = None
            else:
                starts = sorted({0, *r.sample(range(1, 50), 5)})
                to = [r.randrange(50) for _ in starts]
            rows.append((f"f{f}", k, n, starts, to))
            at = 0 if starts is None else to[int(np.searchsorted(starts, at, side="right")) - 1]
    maps = spark.createDataFrame(rows, "rel_path string, idx bigint, n bigint, starts array<int>, exits array<int>").repartition(4)
    for levels in (0, 1, 2, 3):
        assert {(x.rel_path, x.idx): x.entry for x in chains.chain_entries(maps, levels).collect()} == want


def test_a_large_file_is_spread(spark, chunked):
    """No group holds a file: what is dealt by path alone are hashes, sizes and maps."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        src = chunked(0, 512)
        met = (delta._source_chunks(src, 512, 512).select("rel_path", F.spark_partition_id().alias("task"))
               .groupBy("rel_path").agg(F.count_distinct("task").alias("tasks")))
        tasks = {r.rel_path: r.tasks for r in met.collect()}
        rebuilt = delta.rebuild_chunks(delta.match_blocks(src, delta.match_signatures(src), 512, reach=512), src, 512)
        text = explain(rebuilt)
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert tasks["grown"] > 1
    dealt = [part for part in text.split("\n\n") if re.match(r"\(\d+\) Exchange", part)]
    by_path = [part for part in dealt if re.search(r"hashpartitioning\(rel_path#\d+, \d+\)", part)]
    assert len(dealt) > len(by_path) > 0
    assert not any(re.search("(bytes|piece|literal|buf)#", part) for part in by_path)


def test_reading_in_chunks(spark, tmp_path, manifest):
    os.makedirs(tmp_path / "a")
    data = {"a/big": os.urandom(10_001), "small": b"abc", "none": b""}
    for name, d in data.items():
        (tmp_path / name).write_bytes(d)
    got = read_chunks(spark, str(tmp_path), 1000)
    assert {r.rel_path: r.hash for r in content.tree_hashes(got).collect()} == {n: tree_hash(d, 1000, content.FANOUT) for n, d in data.items()}
    rows = got.filter("rel_path = 'a/big'").withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 11 and len({r.task for r in rows}) > 1 and max(len(r.bytes) for r in rows) == 1000
    # A file that is gone, or shorter than its manifest says, cannot be read.
    m = manifest({"rel_path": "small", "size": 3}, {"rel_path": "a/big", "size": 20_000}, {"rel_path": "gone", "size": 5})
    hashes = {r.rel_path: r.hash for r in content.tree_hashes(chunks_of(m, str(tmp_path), 1000)).collect()}
    assert hashes["small"] and hashes["a/big"] is None and hashes["gone"] is None


def test_verify_and_locate_by_chunks(chunked, manifest):
    m = manifest(*PAIRS)
    found = {r.rel_path: r.status for r in verify_trees(m, m, chunked(0, 600), chunked(1, 600), hashes=content.tree_hashes).collect()}
    assert found == {n: "ok" if s == b else "mismatch" for n, (s, b) in PAIRS.items()}
    where = {}
    for r in content.differing_chunks(chunked(0, 600), chunked(1, 600)).collect():
        assert r.offset == 600 * r.chunk_idx
        where.setdefault(r.rel_path, set()).add(r.chunk_idx)
    for name, (s, b) in PAIRS.items():
        n = max(1, -(-max(len(s), len(b)) // 600))
        want = {k for k in range(n) if (s[600 * k:600 * k + 600], k < max(1, -(-len(s) // 600))) != (b[600 * k:600 * k + 600], k < max(1, -(-len(b) // 600)))}
        assert where.get(name, set()) == want, name
