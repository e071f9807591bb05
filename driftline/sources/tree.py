"""A file tree as a Spark data source: one row per entry below the root.

`spark.read.format("tree").option("root", ...).load()` after `register(spark)`.
"""

import itertools
import os
import stat
import zlib

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftline.schemas import MANIFEST

_TYPES = ((stat.S_ISDIR, "dir"), (stat.S_ISLNK, "symlink"), (stat.S_ISREG, "regular"))


# Entries of a directory that the driver looks at; larger directories are shared out among tasks by name.
LOOK = 10_000


class Dirs(InputPartition):
    """Directories to list; `deep` ones with everything below, `flat` ones one level, and of `shared`
    ones (path, k, n) the entries whose names fall into share k of n, with everything below."""

    def __init__(self, flat, deep, shared):
        self.flat, self.deep, self.shared = flat, deep, shared


def entry(root: str, rel: str):
    """Manifest row of one path, or None if it cannot be read."""
    path = os.path.join(root, rel)
    try:
        st = os.lstat(path)
        kind = next((name for test, name in _TYPES if test(st.st_mode)), "other")
        target = os.readlink(path) if kind == "symlink" else None
    except OSError:
        return None
    xattrs = None
    if kind in ("regular", "dir"):
        try:
            xattrs = {n: os.getxattr(path, n) for n in os.listxattr(path)} or None
        except OSError:
            pass
    return (rel, kind, st.st_size, st.st_mtime_ns, st.st_atime_ns, stat.S_IMODE(st.st_mode), st.st_uid,
            st.st_gid, st.st_nlink, st.st_dev, st.st_ino, target, xattrs)


def children(root: str, rel: str):
    """(relative path, is a directory) of the entries of one directory, as they are read; none if it
    is unreadable."""
    try:
        with os.scandir(os.path.join(root, rel)) as it:
            for e in it:
                yield os.path.join(rel, e.name) if rel else e.name, e.is_dir(follow_symlinks=False)
    except OSError:
        return


def share(rel: str, n: int) -> int:
    """The share of a directory that an entry falls into, by its name."""
    return zlib.crc32(os.path.basename(rel).encode("utf-8", "surrogateescape")) % n


class TreeReader(DataSourceReader):
    def __init__(self, root, target):
        self.root, self.target = root, target

    def partitions(self):
        """Open up directories level by level until there are enough of them to share out. Of each the
        driver reads at most LOOK entries; one with more is listed by all tasks, each for its share."""
        flat, level, large, opened = [], [""], [], 0
        while level and len(level) < self.target and opened < self.target:
            below = []
            for d in level:
                opened += 1
                seen = list(itertools.islice(children(self.root, d), LOOK + 1))
                if len(seen) > LOOK:
                    large.append(d)
                else:
                    flat.append(d)
                    below += [p for p, is_dir in seen if is_dir]
            level = below
        n = self.target if large else max(1, min(self.target, len(level) + len(flat)))
        parts = [Dirs(flat[i::n], level[i::n], [(d, i, n) for d in large]) for i in range(n)]
        return [p for p in parts if p.flat or p.deep or p.shared]

    def read(self, part):
        stack = [(d, True, None) for d in part.deep] + [(d, False, None) for d in part.flat] + [(d, True, (k, n)) for d, k, n in part.shared]
        while stack:
            d, deep, own = stack.pop()
            for rel, is_dir in children(self.root, d):
                if own and share(rel, own[1]) != own[0]:
                    continue
                row = entry(self.root, rel)
                if row is not None:
                    yield row
                if is_dir and deep:
                    stack.append((rel, True, None))


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return MANIFEST

    def reader(self, schema):
        root = self.options.get("root") or self.options["path"]
        return TreeReader(os.path.abspath(root), int(self.options.get("partitions", "64")))


def register(spark) -> None:
    spark.dataSource.register(TreeSource)


def read_tree(spark, root: str, partitions: int = None) -> DataFrame:
    """Manifest of the tree below `root` (mounted on every executor), without the root itself."""
    register(spark)
    n = partitions or 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("tree").option("root", root).option("partitions", str(n)).load()
