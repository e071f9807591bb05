from pyspark.sql import functions as F

from driftline.functions import paths


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_root_prefix(spark):
    for root, served, want in [
        ("/srv/data", "/srv/data", ""), ("/srv/data/subdir", "/srv/data", "subdir"), ("/srv/data/a/b/c", "/srv/data", "a/b/c"),
        ("/home/u/dst", "/", "home/u/dst"), ("/other/path", "/srv/data", ""), ("/", "/tmp/src", ""), ("/srv", "/srv/data", ""),
        ("/srv/data2", "/srv/data", ""), ("/srv/data//x/", "/srv/data/", "x"),
    ]:
        assert one(spark, paths.root_prefix(F.lit(root), F.lit(served))) == want, (root, served)


def test_served_round_trip(spark):
    for prefix, rel, served in [("", "a/b", "a/b"), ("x/y", "a/b", "x/y/a/b"), ("x", ".", "x")]:
        assert one(spark, paths.to_served(F.lit(rel), F.lit(prefix))) == served
        assert one(spark, paths.from_served(F.lit(served), F.lit(prefix))) == rel


def test_strip_root(spark):
    for root, path, want in [("", "/a/b", "/a/b"), ("/dst", "/dst/a", "a"), ("/dst/", "/dst/a", "a"), ("/dst", "/dst2/a", "/dst2/a"),
                             ("/dst", "rel", "rel")]:
        assert one(spark, paths.strip_root(F.lit(path), root)) == want


def test_destination(spark):
    for arg, is_dir, base, mapped in [("/s/tree/", True, "/d", "/d/x/y"), ("/s/tree", True, "/d/tree", "/d/tree/x/y"),
                                      ("/s/f.txt", False, "/d/f.txt", "/d/f.txt")]:
        assert one(spark, paths.destination_base(arg, "/d", is_dir)) == base
        assert one(spark, paths.map_path(F.lit("x/y"), arg, "/d", is_dir)) == mapped


def test_parts(spark):
    assert one(spark, paths.ancestors(F.lit("a/b/c"))) == ["a", "a/b"]
    assert one(spark, paths.ancestors(F.lit("a"))) == []
    assert one(spark, paths.parent(F.lit("a/b/c"))) == "a/b"
    assert one(spark, paths.parent(F.lit("a"))) is None
    assert one(spark, paths.basename(F.lit("a/b"))) == "b"
