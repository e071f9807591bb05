import pytest
from pyspark.sql import functions as F

from driftline.functions.globs import filter_chain
from driftline.operators.hardlinks import hardlink_groups, hardlink_targets
from driftline.plans import sync
from driftline.operators.packing import BatchConfig, schedule
from driftline.plans.sync import Capabilities, MetadataOptions, SyncOptions, copy_strategy, sync_plan
from driftline.plans.work import work_plan


def actions(plan):
    return {r.rel_path: r.action for r in plan.collect()}


def f(path, **kw):
    return {"rel_path": path, **kw}


TREE = ("root.txt", "sub/", "sub/mid.txt", "sub/deep/", "sub/deep/leaf.txt")


def test_first_sync_copies_and_second_skips(manifest):
    s = manifest(*TREE, f("link", file_type="symlink", link_target="root.txt"))
    plan = sync_plan(s, manifest())
    got = actions(plan)
    assert got == {"root.txt": "copy_new", "sub": "mkdir", "sub/mid.txt": "copy_new", "sub/deep": "mkdir",
                   "sub/deep/leaf.txt": "copy_new", "link": "symlink"}
    assert plan.filter("action = 'symlink'").first().link_target == "root.txt"
    after = sync.apply_plan(s, manifest(), plan)
    again = actions(sync_plan(s, after))
    assert {a for p, a in again.items() if p.endswith(".txt")} == {"skip"} and again["link"] == "symlink"


def test_one_nanosecond_and_size(manifest):
    s = manifest(f("a", mtime_ns=1704067200000000001), f("b", size=11), "c")
    d = manifest(f("a", mtime_ns=1704067200000000000), f("b", size=12), "c")
    plan = sync_plan(s, d)
    assert actions(plan) == {"a": "copy_changed", "b": "copy_changed", "c": "skip"}
    assert {r.rel_path: r.reason for r in plan.collect()} == {"a": "mtime", "b": "size", "c": "same"}
    coarse = sync_plan(s, d, opts=SyncOptions(mtime_granularity_ns=1_000_000_000))
    assert actions(coarse)["a"] == "skip"
    assert sync.skipped(s, d).count() == 1 and sync.not_skipped(s, d).count() == 2


def test_skip_ignores_the_destination_type(manifest):
    d = manifest(f("a", file_type="symlink"))
    assert actions(sync_plan(manifest("a"), d)) == {"a": "skip"}


def test_delete(manifest):
    s = manifest("file1", "file2", {"rel_path": "pipe", "file_type": "other"})
    d = manifest("file1", "file2", "extra", "keep.log", "old/", "old/deep/", "old/deep/nested", "old/x.log", "pipe")
    chain = filter_chain(["- *.log"])
    plan = sync_plan(s, d, chain, SyncOptions(delete=True))
    assert actions(plan) == {
        "file1": "skip", "file2": "skip", "extra": "delete_file", "keep.log": "excluded", "old": "delete_dir",
        "old/deep": "delete_dir", "old/deep/nested": "delete_file", "old/x.log": "excluded", "pipe": "keep"}
    assert actions(sync_plan(s, d, chain))["extra"] == "keep"
    gone = sync.delete_order(sync.extraneous(s, d, chain)).collect()
    assert [r.rel_path for r in gone] == ["extra", "old/deep/nested", "old/deep", "old"]
    # Removing old/ takes the protected file below it along; the one elsewhere stays.
    after = sorted(r.rel_path for r in sync.apply_plan(s, d, plan).collect())
    assert after == ["file1", "file2", "keep.log", "pipe"]


def test_delete_does_not_prune(manifest):
    """A destination file below an excluded directory is judged on its own path."""
    d = manifest("skip/", "skip/x")
    plan = sync_plan(manifest(), d, filter_chain(["- skip/"]), SyncOptions(delete=True))
    assert actions(plan) == {"skip": "excluded", "skip/x": "delete_file"}


def test_excluded_source_protects_its_destination(manifest):
    s, d = manifest("a.log", "d/", "d/b"), manifest("a.log", "d/", "d/b")
    got = actions(sync_plan(s, d, filter_chain(["- *.log", "- d/"]), SyncOptions(delete=True)))
    assert got == {"a.log": "excluded", "d": "excluded", "d/b": "excluded"}


def linked(path, ino, **kw):
    return f(path, nlink=2, ino=ino, **kw)


def test_hardlinks(manifest):
    s = manifest(linked("a", 1), linked("b", 1), linked("c/x", 2), linked("d", 2), linked("e", 3), "f")
    plan = {r.rel_path: (r.action, r.link_target) for r in sync_plan(s, manifest("c/x")).collect()}
    assert plan["a"] == ("copy_new", None) and plan["b"] == ("hardlink", "a")
    # c/x is skipped, so d is the first of its inode that travels.
    assert plan["c/x"] == ("skip", None) and plan["d"] == ("copy_new", None) and plan["e"] == ("copy_new", None)
    assert actions(sync_plan(s, manifest(), opts=SyncOptions(hardlinks=False)))["b"] == "copy_new"
    g = {r.ino: (r.first_path, r.n, r.bytes_saved) for r in hardlink_groups(s).collect()}
    assert g == {1: ("a", 2, 10), 2: ("c/x", 2, 10)}


@pytest.mark.parametrize("hot_groups", [1, 2, 5, 1_000_000])
def test_hot_inode_gives_the_same_targets(manifest, hot_groups):
    rows = [linked(f"p{i:03d}", 7) for i in range(60)] + [linked(f"q{i:03d}", i // 2) for i in range(100, 140)]
    got = {r.rel_path: r.first_path for r in hardlink_targets(manifest(*rows), hot_groups).collect()}
    want = {f"p{i:03d}": "p000" for i in range(1, 60)}
    want |= {f"q{i:03d}": f"q{i - 1:03d}" for i in range(101, 140, 2)}
    assert got == want


def test_sources(spark, manifest):
    out = sync.merge_sources([("/s/a/", manifest("x", "y.log"), True), ("/s/b", manifest("x"), True),
                              ("/s/one.log", manifest("one.log"), False)], "/d", filter_chain(["- *.log"]))
    got = sorted((r.source_ord, r.dst_path) for r in out.collect())
    assert got == [(0, "/d/x"), (1, "/d/b/x"), (2, "/d/one.log")]
    sources = spark.createDataFrame([("/s/a/", True), ("/s/b/", True), ("/s/c", True), ("/s/f", False)], "src_arg string, is_dir boolean")
    overlaps = sync.dst_overlaps(sources, "/d")
    assert [tuple(r) for r in overlaps.collect()] == [("/d", 2)]
    s = manifest("x").withColumn("dst_base", F.lit("/d/c"))
    d = manifest("x", "z").withColumn("dst_base", F.explode(F.array(F.lit("/d"), F.lit("/d/c"))))
    assert [(r.dst_base, r.rel_path) for r in sync.guarded_extraneous(s, d, overlaps).collect()] == [("/d/c", "z")]


def test_strategy(spark):
    def pick(size, basis, **caps):
        col = copy_strategy(Capabilities(**caps), size=F.lit(size), basis_size=F.lit(basis).cast("bigint"))
        return spark.range(1).select(col.alias("v")).first().v
    big = 64 * 1024
    assert pick(big, big) == "kernel"
    assert pick(big, big, bandwidth_limited=True) == "stream"
    remote = {"dst_local": False, "delta": True}
    assert pick(big, 1, dst_delta=True, **remote) == "delta_push"
    assert pick(big - 1, 1, dst_delta=True, **remote) == "stream"
    assert pick(big, 0, dst_delta=True, **remote) == "stream" and pick(big, None, dst_delta=True, **remote) == "stream"
    assert pick(big, 1, **remote) == "delta_basis"
    assert pick(big, 1, src_local=False, src_delta=True, delta=True) == "delta_pull"
    assert pick(big, 1, dst_local=False, dst_delta=True) == "stream"


def test_metadata_drift(manifest):
    s = manifest(f("a", mode=0o100644), f("b", mtime_ns=2, atime_ns=5), f("c", uid=1, gid=2), f("x", xattrs={"user.a": b"1", "user.b": b"2"}),
                 f("y", xattrs={"user.a": b"1"}))
    d = manifest("a", "b", "c", f("x", xattrs={"user.b": b"2", "user.a": b"1"}), f("y", xattrs={"user.a": b"2"}))
    got = {r.rel_path: r.drift for r in sync.metadata_drift(s, d, MetadataOptions(atime=True, xattrs=True)).collect()}
    assert got == {"b": ["mtime", "atime"], "c": ["uid", "gid"], "y": ["xattrs"]}
    assert set(r.rel_path for r in sync.metadata_drift(s, d).collect()) == {"b", "c"}


def test_plan_of_several_sources(manifest):
    from driftline.plans.multi import Source, plan_sources
    one = manifest("one.log")
    d = manifest("x", "gone", "one.log", "b/", "b/x", "b/old", "b/k.log")
    chain, opts = filter_chain(["- *.log"]), SyncOptions(delete=True, dst_base="/d")

    def run(*sources):
        return {(r.source_ord, r.dst_path): r.action for r in plan_sources(sources, d, chain, opts).collect()}
    got = run(Source("/s/b", manifest("x", "y")), Source("/s/one.log", one, False))
    assert got == {(0, "/d/b/x"): "skip", (0, "/d/b/y"): "copy_new", (0, "/d/b/old"): "delete_file", (0, "/d/b/k.log"): "excluded",
                   (1, "/d/one.log"): "copy_changed"}
    # Two sources with one destination: nothing is deleted there.
    both = run(Source("/s/a/", manifest("x")), Source("/t/c/", manifest("z")))
    assert both[(0, "/d/gone")] == "keep" and both[(1, "/d/x")] == "keep" and both[(1, "/d/z")] == "copy_new"
    assert not any(a.startswith("delete") for a in both.values())


@pytest.mark.parametrize("parts", [None, 5])
def test_delete_positions(manifest, parts):
    x = manifest("b", "a", "d/", "d/e/", "d/e/f", "z/", "c")
    got = [r.rel_path for r in sync.delete_positions(x, parts).orderBy("position").collect()]
    assert got == ["a", "b", "c", "d/e/f", "z", "d/e", "d"] == [r.rel_path for r in sync.delete_order(x).collect()]


def test_capabilities_narrow_options():
    none = Capabilities(src_hardlinks=False, dst_xattrs=False)
    assert not sync.within(SyncOptions(), none).hardlinks and sync.within(SyncOptions(), Capabilities()).hardlinks
    assert not sync.within(MetadataOptions(xattrs=True), none).xattrs
    assert sync.within(MetadataOptions(xattrs=True), Capabilities()).xattrs and not sync.within(MetadataOptions(), Capabilities()).xattrs


REMOTE = Capabilities(src_local=True, dst_local=False, dst_delta=True, delta=True)


def test_work_plan(manifest):
    s = manifest("a/", *[f(f"a/{k:02d}", size=10) for k in range(7)], f("big", size=2500), f("changed", size=500, mtime_ns=9),
                 linked("h1", 4, size=30), linked("h2", 4, size=30), "same", f("z", size=0))
    d = manifest("same", f("changed", size=400), "gone")
    plan = sync_plan(s, d, opts=SyncOptions(delete=True))
    rows = work_plan(plan, REMOTE, 1000, BatchConfig(max_bytes=1000, size_limit=100, max_count=3), chunk_bytes=1000, delta_min=450, parts=3,
                     block_rows=3, run_blocks=2)
    assert rows.columns == [*plan.columns, "strategy", "batch_id", "chunk_idx", "chunk_offset", "chunk_length", "est_start_s", "est_end_s"]
    got = sorted(rows.collect(), key=lambda r: (r.rel_path, r.chunk_idx))
    assert [(r.rel_path, r.chunk_idx, r.chunk_length) for r in got if r.rel_path == "big"] == [("big", 0, 1000), ("big", 1, 1000), ("big", 2, 500)]
    by = {r.rel_path: r for r in got if r.chunk_idx == 0}
    assert set(by) == {"a", *[f"a/{k:02d}" for k in range(7)], "big", "changed", "h1", "h2", "z"}
    assert [by[f"a/{k:02d}"].batch_id for k in range(7)] == [0, 0, 0, 1, 1, 1, 2]
    assert by["big"].batch_id is None and by["h2"].batch_id is None and by["h1"].batch_id == 3 and by["z"].batch_id == 4
    assert {n: r.strategy for n, r in by.items() if n in ("a", "big", "changed", "h2")} == {
        "a": None, "big": "stream", "changed": "delta_push", "h2": None}
    # Pieces follow one another, links and folders cost nothing.
    total = 70 + 2500 + 500 + 30
    assert by["h2"].est_start_s == by["h2"].est_end_s and got[-1].est_end_s == (total - 1000) / 1000
    ends = [r.est_end_s for r in got]
    assert ends == sorted(ends) and all(a.est_end_s == b.est_start_s for a, b in zip(got, got[1:]))


def test_work_plan_of_local_trees(manifest, spark):
    plan = sync_plan(manifest(f("a", size=100), f("b", size=1000)), manifest())
    data = spark.createDataFrame([("b", 300, 700)], "rel_path string, data_bytes bigint, hole_bytes bigint")
    got = {r.rel_path: r for r in work_plan(plan, data=data, bytes_per_s=10).collect()}
    assert got["a"].strategy == "kernel" and got["a"].batch_id is None
    assert got["b"].chunk_length == 300 and got["b"].est_end_s == (400 - 10) / 10 and got["b"].size == 1000
    whole = {r.rel_path: r for r in work_plan(plan, Capabilities(src_sparse=False), data=data).collect()}
    assert whole["b"].chunk_length == 1000 and whole["b"].est_end_s is None
    assert work_plan(plan.filter("false"), REMOTE, 10).count() == 0
    # The same times as the schedule of the copies alone.
    alone = {r.rel_path: (r.est_start_s, r.est_end_s) for r in schedule(plan, 10).collect()}
    assert {r.rel_path: (r.est_start_s, r.est_end_s) for r in work_plan(plan, bytes_per_s=10).collect()} == alone
