import json
import os

import pytest
from pyspark.sql import functions as F

from driftline.schemas import MANIFEST
from driftline.sources import tables, tree
from driftline.sources.tree import read_tree


def build(root):
    os.makedirs(root / "sub" / "deep")
    (root / "root.txt").write_text("hello")
    (root / "sub" / "mid.txt").write_text("mid")
    (root / "sub" / "deep" / "leaf.txt").write_text("leaf")
    os.link(root / "root.txt", root / "sub" / "hard.txt")
    os.symlink("root.txt", root / "link")
    os.mkfifo(root / "pipe")
    os.utime(root / "sub" / "mid.txt", ns=(5, 1704067200123456789))
    os.chmod(root / "sub" / "mid.txt", 0o640)


def test_tree(spark, tmp_path):
    build(tmp_path)
    for parts in (1, 2, 50):
        rows = {r.rel_path: r for r in read_tree(spark, str(tmp_path), parts).collect()}
        assert sorted(rows) == ["link", "pipe", "root.txt", "sub", "sub/deep", "sub/deep/leaf.txt", "sub/hard.txt", "sub/mid.txt"]
    assert rows["link"].file_type == "symlink" and rows["link"].link_target == "root.txt"
    assert rows["pipe"].file_type == "other" and rows["sub"].file_type == "dir"
    mid = rows["sub/mid.txt"]
    assert (mid.size, mid.mtime_ns, mid.mode) == (3, 1704067200123456789, 0o640)
    assert rows["root.txt"].nlink == 2 and rows["root.txt"].ino == rows["sub/hard.txt"].ino
    assert read_tree(spark, str(tmp_path / "missing"), 2).count() == 0


def test_large_directories_are_shared_by_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "LOOK", 20)
    for k in range(60):
        (tmp_path / f"f{k}").write_bytes(b"x" * k)
    for k in range(5):
        os.makedirs(tmp_path / f"d{k}" / "e")
        (tmp_path / f"d{k}" / "e" / "leaf").write_text("y")
    for parts in (1, 3, 7):
        reader = tree.TreeReader(str(tmp_path), parts)
        dealt = reader.partitions()
        # The driver names the directory, and none of its entries.
        assert len(dealt) == parts and (parts == 1 or all(p.shared and not p.flat and not p.deep for p in dealt))
        rows = [r for p in dealt for r in reader.read(p)]
        assert sorted(r[0] for r in rows) == sorted([f"f{k}" for k in range(60)] + [f"d{k}{x}" for k in range(5) for x in ("", "/e", "/e/leaf")])
        assert all(r[2] == int(r[0][1:]) for r in rows if r[0][0] == "f")


def test_content_and_listing(spark, tmp_path):
    os.makedirs(tmp_path / "a" / "x")
    (tmp_path / "a" / "x" / "f g.txt").write_bytes(b"\x00\x01")
    (tmp_path / "a" / "top").write_bytes(b"t")
    got = {r.rel_path: bytes(r.content) for r in tables.read_content(spark, str(tmp_path / "a")).collect()}
    assert got == {"x/f g.txt": b"\x00\x01", "top": b"t"}
    listed = tables.binary_listing(spark, str(tmp_path / "a"))
    assert {(r.rel_path, r.size) for r in listed.collect()} == {("x/f g.txt", 2), ("top", 1)}
    assert listed.schema.names == MANIFEST.names


def test_manifest_table(spark, manifest, tmp_path):
    path = str(tmp_path / "m")
    assert tables.load_manifest(spark, path).count() == 0
    tables.write_table(manifest("a", "b"), path)
    tables.write_table(manifest("c"), path)
    assert [r.rel_path for r in tables.load_manifest(spark, path).collect()] == ["c"]
    # A write that fails leaves the table as it was.
    broken = manifest("x").withColumn("size", F.expr("CAST(raise_error('no') AS BIGINT)"))
    with pytest.raises(Exception, match="no"):
        tables.write_table(broken, path)
    assert [r.rel_path for r in tables.load_manifest(spark, path).collect()] == ["c"]
    # A manifest written with fewer columns reads with nulls.
    tables.write_table(manifest("d").select("rel_path", "file_type", "size", "mtime_ns"), path)
    row = tables.load_manifest(spark, path).first()
    assert row.rel_path == "d" and row.mode is None


def test_log(spark, tmp_path):
    lines = [{"time": "2024-01-01T00:00:00.123456Z", "level": "INFO", "msg": "e", "type": "FileCompleted", "path": "/d/a", "size": 5, "worker": 2},
             {"time": "2024-01-01T00:00:01Z", "level": "INFO", "msg": "e", "type": "FileFailed", "path": "/d/b", "size": 6, "worker": 1, "error": "io"},
             {"time": "2024-01-01T00:00:02Z", "level": "DEBUG", "msg": "other"}]
    (tmp_path / "run1.json").write_text("\n".join(map(json.dumps, lines)))
    rows = tables.read_events(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.run_id, r.type, r.path, r.size, r.worker, r.error) for r in rows] == [
        ("run1.json", "FileCompleted", "/d/a", 5, 2, None), ("run1.json", "FileFailed", "/d/b", 6, 1, "io")]


def test_scratch_folders_are_deleted_by_their_owner(spark):
    """A job's intermediate tables go with its scope, its kept result with the scope around it."""
    from driftline import session

    def alive(n):
        return [os.path.exists(p.removeprefix("file:")) for p in session._MADE[n:]]

    start = len(session._MADE)
    with session.scratch_scope(spark):
        with session.scratch_scope(spark) as kept:
            a = session.cut(spark.range(5).toDF("x"))
            b = session.cut(a.filter("x > 2"), kept)
            none = session.cut(a.filter("x > 9"), kept)
            paths = session._MADE[start:]
            assert alive(start) == [True] * 3
        assert alive(start) == [True] * 2 and not os.path.exists(paths[0].removeprefix("file:"))
        assert sorted(r.x for r in b.collect()) == [3, 4] and none.count() == 0
    assert len(session._MADE) == start and not any(os.path.exists(p.removeprefix("file:")) for p in paths)
    with pytest.raises(ZeroDivisionError), session.scratch_scope(spark):
        session.cut(spark.range(1))
        1 / 0
    assert len(session._MADE) == start
