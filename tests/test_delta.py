import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import delta, rolling
from driftline.plans.delta_sync import delta_sync
from driftline.plans.verify import file_hashes, verify_summary, verify_trees

rng = random.Random(42)


def noise(n):
    return rng.randbytes(n)


def greedy(src, basis):
    """Direct search of every position, the slow definition of the result."""
    width = max(512, min(131072, int(math.sqrt(len(basis)))))
    blocks = {}
    for k in range(0, len(basis), width):
        blocks.setdefault(basis[k:k + width], k // width)
    ops, lit, i = [], 0, 0
    while i < len(src):
        w = src[i:i + width]
        if w in blocks:
            if lit:
                ops.append((-1, lit))
            ops.append((blocks[w], len(w)))
            i, lit = i + len(w), 0
        else:
            lit, i = lit + 1, i + 1
    return ops + ([(-1, lit)] if lit else [])


B = noise(20000)
P = b"ABCDEFGHIJKLMNOP"
PAIRS = {
    "identical": (B[:4096], B[:4096]), "different": (noise(4096), noise(4096)), "shifted": (B[:7000] + b"@@" + B[7000:], B),
    "zeros": (bytes(10001), bytes(9000)), "mixed": (noise(700) + bytes(8000) + noise(33) + bytes(5000), bytes(3000) + noise(100)),
    "no_basis": (B, b""), "empty": (b"", B), "both_empty": (b"", b""), "grown": (B + noise(1024), B),
    "small_tail": (noise(50) + b"abc", b"abc"), "middle": (P * 64 + b"X" * 512 + P * 160, P * 256),
    "periodic": (P * 700, P * 300 + b"xyz"), "odd_period": (b"abc" * 3000 + b"q" + b"abc" * 2000, b"zz" + b"abc" * 2000),
    "two_period": (b"ab" * 3000 + b"q" + b"ab" * 2000, b"zz" + b"ab" * 2000), "shuffled": (B[9000:] + B[:9000], B),
}


@pytest.fixture(scope="module")
def pair_tables(spark):
    def table(i):
        return spark.createDataFrame([(k, bytearray(v[i])) for k, v in PAIRS.items()], "rel_path string, content binary")
    return table(0), table(1)


@pytest.mark.parametrize("chunk_bytes", [4 << 20, 512, 1000, 3000])
def test_greedy_match_for_any_chunk_size(pair_tables, chunk_bytes):
    src, dst = pair_tables
    ops = delta.numbered(delta.match_blocks(src, delta.match_signatures(dst), chunk_bytes, reach=512))
    got = {}
    for r in ops.orderBy("rel_path", "seq").collect():
        mine = got.setdefault(r.rel_path, [])
        if r.block_idx < 0 and mine and mine[-1][0] < 0:     # literals end at chunk borders
            mine[-1] = (-1, mine[-1][1] + r.length)
        else:
            mine.append((r.block_idx, r.length))
    for name, (s, b) in PAIRS.items():
        assert got.get(name, []) == greedy(s, b), name
    rebuilt = {r.rel_path: bytes(r.content) for r in delta.apply_delta(ops, dst).collect()}
    assert all(rebuilt.get(n, b"") == s for n, (s, _) in PAIRS.items())


def test_block_size(spark):
    for size, lo, hi in [(100, 512, 512), (256 * 1024, 512, 1024), (1 << 20, 512, 1200), (1 << 30, 32000, 33000), (1 << 40, 131072, 131072)]:
        v = spark.range(1).select(delta.block_size(F.lit(size)).alias("v")).first().v
        assert lo <= v <= hi


def test_signatures(pair_tables):
    src, _ = pair_tables
    sig = delta.signatures(src).filter("rel_path = 'grown'").orderBy("block_idx").collect()
    assert [r.length for r in sig] == [512] * 41 + [32]
    assert sig[3].strong == hashlib.sha256((PAIRS["grown"][0])[1536:2048]).hexdigest()
    assert delta.signatures(src).filter("rel_path = 'empty'").count() == 0


def test_stats_and_job(pair_tables):
    src, dst = pair_tables
    out = {r.rel_path: r for r in delta_sync(src, dst, delta_min=100, chunk_bytes=2000, reach=512).collect()}
    assert all(r.identical for r in out.values())
    assert out["identical"].literal_bytes == 0 and out["identical"].matched_blocks == 8
    assert out["different"].literal_bytes == 4096 and out["different"].matched_blocks == 0
    assert out["small_tail"].literal_bytes == 53          # below the delta threshold
    assert set(out) == {n for n, (s, _) in PAIRS.items() if s}


def test_aligned_matches(spark):
    a = spark.createDataFrame([("f", bytearray(b"A" * 512 + b"B" * 512 + b"C" * 100))], "rel_path string, content binary")
    b = spark.createDataFrame([("f", bytearray(b"B" * 512 + b"A" * 512 + b"A" * 512 + b"C" * 100))], "rel_path string, content binary")
    sa, sb = delta.signatures(a, 512), delta.signatures(b, 512)
    assert sorted((r.block_idx, r.basis_idx) for r in delta.block_matches(sa, sb).collect()) == [(0, 1), (1, 0), (2, 3)]
    assert delta.changed_blocks(sa, sb).count() == 0


def test_verify(spark, manifest):
    s = manifest("ok", "bad", "src_gone", "dst_gone", "only_src", "skip.log", {"rel_path": "l", "file_type": "symlink"})
    d = manifest("ok", "bad", "src_gone", "dst_gone", "only_dst", "skip.log", {"rel_path": "l", "file_type": "symlink"})

    def content(**files):
        return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "rel_path string, content binary")
    from driftline.functions.globs import filter_chain
    v = verify_trees(s, d, content(ok=b"1", bad=b"2", dst_gone=b"3"), content(ok=b"1", bad=b"x", src_gone=b"4"), filter_chain(["- *.log"]))
    got = {r.rel_path: (r.status, r.src_hash == "error", r.dst_hash in ("n/a", "error")) for r in v.collect()}
    assert got == {"ok": ("ok", False, False), "bad": ("mismatch", False, False), "src_gone": ("src_error", True, True),
                   "dst_gone": ("dst_error", False, True)}
    assert {r.status: r.files for r in verify_summary(v).collect()} == {"ok": 1, "mismatch": 1, "src_error": 1, "dst_error": 1}
    assert file_hashes(content(a=b"x")).first().hash == hashlib.sha256(b"x").hexdigest()


def test_chunks_of_a_file_share_tables_and_basis(monkeypatch):
    """Byte tables, powers and the look-up of a basis are made once, not once per chunk; the matches are the same."""
    rows = []
    for name, basis in (("x", B[:15_000]), ("y", b"q" + B[300:])):
        blocks = [basis[k:k + 512] for k in range(0, len(basis), 512)]
        rolls = rolling.block_hashes(blocks)
        strongs = [hashlib.sha256(b).digest() for b in blocks]
        for k in range(0, len(B), 1024):
            rows.append((name, len(B), -(-len(B) // 1024), k // 1024, k, min(1024, len(B) - k), B[k:k + 1024 + 511], 512, len(basis), rolls, strongs))
    pdf = pd.DataFrame(rows, columns=["rel_path", "src_size", "n_chunks", "chunk_idx", "start", "length", "buf", "block_size", "basis_size",
                                      "rolls", "strongs"])
    alone = [next(delta._find(512)(iter([pdf.iloc[k:k + 1]]))) for k in range(len(pdf))]
    made = []
    real, basis_of = np.random.default_rng, rolling.Basis
    monkeypatch.setattr(np.random, "default_rng", lambda *a: made.append("table") or real(*a))
    monkeypatch.setattr(rolling, "Basis", lambda *a: made.append("basis") or basis_of(*a))
    together = next(delta._find(512)(iter([pdf])))
    assert made == ["basis"] * 2
    assert pd.concat(alone).astype(str).values.tolist() == together.astype(str).values.tolist()
