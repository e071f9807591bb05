import itertools
import random

import pytest
from pyspark.sql import functions as F

from driftline.functions import globs
from driftline.functions.globs import filter_chain, glob_col, glob_regex, load_rules, parse_rule
from driftline.operators.filtering import apply_filter, known_types, orphan_temps, prescan, subtree

GLOBS = [
    ("*.log", "app.log", False, True), ("*.log", "dir/app.log", False, True), ("*.log", "app.log.bak", False, False),
    ("*.log", "app.txt", False, False),
    ("**/*.go", "main.go", False, True), ("**/*.go", "cmd/x/main.go", False, True), ("**/*.go", "main.txt", False, False),
    ("/root.txt", "root.txt", False, True), ("/root.txt", "sub/root.txt", False, False),
    ("*.tmp", "a/b/c/file.tmp", False, True),
    ("build/", "build", True, True), ("build/", "sub/build", True, True), ("build/", "build", False, False),
    ("file?.txt", "file1.txt", False, True), ("file?.txt", "file12.txt", False, False), ("file?.txt", "file/.txt", False, False),
    ("sub/dir/*.txt", "sub/dir/file.txt", False, True), ("sub/dir/*.txt", "other/sub/dir/file.txt", False, False),
    # Classes, negation, literals that mean something to a regular expression.
    ("f[0-9].txt", "f7.txt", False, True), ("f[!0-9].txt", "f7.txt", False, False), ("f[!0-9].txt", "fx.txt", False, True),
    ("f[]a].txt", "f].txt", False, True), ("f[", "f[", False, True), ("f[!", "f[!", False, True),
    ("f[a&&b]", "f&", False, True), ("f[[x]", "f[", False, True), ("f[[:digit:]]", "f7", False, True),
    ("f[[:digit:]]", "fx", False, False), ("a+b(c){1}^$|.x", "a+b(c){1}^$|.x", False, True), ("a.b", "axb", False, False),
    # End of text is the end, not the spot before a last line break; ** stops at line breaks only.
    ("*.log", "x.log\n", False, False), ("a*", "ab\n", False, True), ("d/**", "d/a\rb", False, True), ("d/**", "d/a\nb", False, False),
    ("x", "xx", False, False), ("x", "a/x", False, True), ("*", "any", False, True), ("", "a", False, False),
]


def test_globs(spark):
    for i, (glob, path, is_dir, want) in enumerate(GLOBS):
        row = spark.range(1).select(glob_col(glob, F.lit(path), F.lit(is_dir)).alias("m")).first()
        assert row.m == want, (glob, path, is_dir)


def test_fast_forms_agree_with_the_regular_expression(spark):
    paths = ["a.log", "x/a.log", "log", ".log", "x.log/y", "build", "x/build", "xbuild", "build/x", "src/a"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for glob in ("*.log", "build", "/build", "src/a", "*g", "*"):
        body = glob.removeprefix("/")
        anchored = "/" in glob
        regex = ("^" if anchored else "(^|/)") + glob_regex(body) + r"\z"
        rows = df.select(glob_col(glob, F.col("p"), F.lit(False)).alias("a"), F.col("p").rlike(regex).alias("b")).collect()
        assert all(r.a == r.b for r in rows), glob


def test_bad_pattern():
    with pytest.raises(ValueError):
        filter_chain(["f[z-a]?"]).matches(F.lit("x"), F.lit(False))


CHAINS = [
    ([], 0, 0, "any/file.txt", False, 1024, True),
    (["- *.log"], 0, 0, "sub/debug.log", False, 100, False), (["- *.log"], 0, 0, "app.txt", False, 100, True),
    (["+ important.log", "- *.log"], 0, 0, "important.log", False, 100, True),
    (["+ important.log", "- *.log"], 0, 0, "debug.log", False, 100, False),
    (["- *.log", "+ important.log"], 0, 0, "important.log", False, 100, False),
    (["- build/"], 0, 0, "build", True, 0, False), (["- build/"], 0, 0, "build", False, 100, True),
    (["+ **/*.go", "- *"], 0, 0, "internal/engine.go", False, 100, True), (["+ **/*.go", "- *"], 0, 0, "readme.md", False, 1, False),
    ([], 100, 10000, "tiny", False, 50, False), ([], 100, 10000, "medium", False, 500, True),
    ([], 100, 10000, "huge", False, 50000, False), ([], 100, 10000, "somedir", True, 0, True),
    (["+ tiny"], 100, 0, "tiny", False, 50, False),
]


def test_chains(spark):
    for rules, lo, hi, path, is_dir, size, want in CHAINS:
        col = filter_chain(rules, lo, hi).matches(F.lit(path), F.lit(is_dir), F.lit(size))
        assert spark.range(1).select(col.alias("m")).first().m == want, (rules, path)


def test_rule_lines(spark, tmp_path):
    assert parse_rule("  + *.md ") == (True, "*.md")
    assert parse_rule("- *.tmp") == (False, "*.tmp")
    assert parse_rule("*.tmp") == (False, "*.tmp")
    assert parse_rule("# note") is None and parse_rule("   ") is None
    f = tmp_path / "rules"
    f.write_text("# c\n\n+ keep.tmp\n*.tmp\n")
    chain = filter_chain(load_rules(str(f), first=["- first"]))
    assert chain.rules == ((False, "first"), (True, "keep.tmp"), (False, "*.tmp"))
    table = spark.createDataFrame([(2, "*.tmp"), (1, "+ keep.tmp")], "ord int, rule string")
    assert filter_chain(table).rules == ((True, "keep.tmp"), (False, "*.tmp"))


def paths_of(df):
    return sorted(r.rel_path for r in df.collect())


def test_prune_takes_the_subtree(manifest):
    m = manifest("keep/", "keep/a.txt", "skip/", "skip/a.txt", "skip/deep/", "skip/deep/b.txt", "x/", "x/skip/", "x/skip/c")
    chain = filter_chain(["- /skip/"])
    assert paths_of(apply_filter(m, chain, prune=True)) == ["keep", "keep/a.txt", "x", "x/skip", "x/skip/c"]
    assert "skip/a.txt" in paths_of(apply_filter(m, chain, prune=False))
    # A file below an excluded directory stays out although a rule includes it.
    assert paths_of(apply_filter(m, filter_chain(["+ a.txt", "- skip/"]), True)) == ["keep", "keep/a.txt", "x"]


def test_both_ways_to_prune_agree(spark):
    """Exclude-only chains look at the path once; a leading include that never matches forces the
    ancestor-by-ancestor test."""
    parts = ["a", "b.tmp", "build", "xbuild", "d1"]
    paths = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    for rule in ["build/", "build", "/build", "*.tmp", "a/build/", "**/d?", "d[0-9]", "/a/*", "b*", "*", "a/**", "**"]:
        fast, slow = filter_chain([rule]), filter_chain(["+ /no/such/path", rule])
        rows = df.select("rel_path", fast.under_excluded_dir().alias("a"), slow.under_excluded_dir().alias("b")).collect()
        assert all(r.a == r.b for r in rows), rule
        assert rule in ("*", "**") or 0 < sum(r.a for r in rows) < len(rows)


def test_small_filters(manifest):
    m = manifest("a/", "a/.f.txt.0a1b2c3d.part", "a/.f.txt.1.part", "a/f.part", ".x.12345678.part",
                 {"rel_path": "sock", "file_type": "other"})
    assert paths_of(orphan_temps(m, "part")) == [".x.12345678.part", "a/.f.txt.0a1b2c3d.part", "a/.f.txt.1.part"]
    assert "sock" not in paths_of(known_types(m))
    assert paths_of(subtree(m, "a/")) == [".f.txt.0a1b2c3d.part", ".f.txt.1.part", "f.part"]
    assert paths_of(subtree(m, max_depth=1)) == [".x.12345678.part", "a", "sock"]
    assert prescan(m).first() == (4, 40)
    assert prescan(m, filter_chain(["- a/"])).first() == (1, 10)
    assert prescan(m, filter_chain(["- a/"]), prune=False).first() == (4, 40)


def test_long_rule_tables(spark):
    rules = spark.range(10_050).selectExpr("id AS ord", "concat('- x', id) AS rule")
    assert len(filter_chain(rules).rules) == 10_050


def test_the_index_agrees_with_the_chain(spark, monkeypatch):
    """Every kind of rule, alone and mixed in any order, by the index and by the CASE."""
    parts = ["a", "b.tmp", "build", "x[1]", "d1", "naïve.txt"]
    paths = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)]
    df = spark.createDataFrame([(p, d) for p in paths for d in (True, False)], "rel_path string, d boolean")
    rules = ["build/", "build", "/build", "*.tmp", "a/build/", "**/d?", "d[0-9]", "/a/*", "b*", "*", "a/**", "**", "b[!a]b*", "x[[]1]", "[[:alpha:]]",
             "[![:digit:]]*.t?p", "a/*/d1", "n*ve.txt", "**.txt", "/a", "d1/**/build", "b**p", "*ld", "?", "*/d1/"]
    rng = random.Random(7)
    chains = [[r] for r in rules] + [[rng.choice(["+ ", "- "]) + r for r in rng.sample(rules, 9)] for _ in range(25)]
    found = []
    for limit in (0, 200):
        monkeypatch.setattr(globs, "INDEXED", limit)
        cols = [c for k, r in enumerate(chains) for c in (filter_chain(r).matches(is_dir=F.col("d")).alias(f"m{k}"), filter_chain(r).under_excluded_dir().alias(f"p{k}"))]
        found.append(sorted(df.select("rel_path", "d", *cols).collect()))
    for x, y in zip(*found):
        for k, r in enumerate(chains):
            assert (x[f"m{k}"], x[f"p{k}"]) == (y[f"m{k}"], y[f"p{k}"]), (r, x.rel_path, x.d)


def test_twenty_thousand_rules(spark):
    rules = [f"- name{k}" for k in range(8000)] + [f"+ *.e{k}" for k in range(4000)] + [f"- /top{k}/*.txt" for k in range(4000)] + [f"- p{k}*/" for k in range(4000)]
    chain = filter_chain(rules)
    rows = [("x/name7999", False, False), ("a/name1/b", True, True), ("q/f.e3999", False, True), ("top3999/z.txt", False, False),
            ("x/top1/z.txt", False, True), ("p3999q", True, False), ("p3999q", False, True), ("p3999q/z/w", False, True), ("other", False, True)]
    df = spark.createDataFrame(rows, "rel_path string, d boolean, want boolean")
    got = df.select("*", chain.matches(is_dir=F.col("d")).alias("kept"), chain.under_excluded_dir().alias("pruned")).collect()
    assert all(r.kept == r.want for r in got)
    assert {r.rel_path for r in got if r.pruned} == {"a/name1/b", "p3999q/z/w"}
