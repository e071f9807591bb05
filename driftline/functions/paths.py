"""Path columns. Paths are `/`-separated and relative, never `.`."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def depth(path) -> Column:
    """Number of path components."""
    return F.size(F.split(_c(path), "/"))


def parent(path) -> Column:
    """Parent directory, null at the top level."""
    p = _c(path)
    cut_at = F.length(p) - F.length(basename(p)) - 1
    return F.when(cut_at > 0, p.substr(F.lit(1), cut_at))


def ancestors(path) -> Column:
    """Array of proper ancestor directories, outermost first; empty at the top level."""
    p = _c(path)
    parts = F.split(p, "/")
    n = F.size(parts) - 1
    steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def strip_root(path, root: str) -> Column:
    """Remove a root prefix; a path outside the root is returned as it is."""
    p = _c(path)
    if not root:
        return p
    prefix = root if root.endswith("/") else root + "/"
    return F.when(p.startswith(prefix), p.substr(F.lit(len(prefix) + 1), F.length(p))).otherwise(p)


def _normal(path) -> Column:
    """Collapse repeated and trailing slashes and `.` steps. Roots are expected without `..`."""
    p = F.regexp_replace(_c(path), r"/(\./)+", "/")
    p = F.regexp_replace(p, "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/\.?\z", ""))


def root_prefix(root, served_root) -> Column:
    """Prefix that leads from the served root to `root`; empty when they are equal or when
    `root` lies outside, so that a client can never climb out of the served tree."""
    r, s = _normal(root), _normal(served_root)
    base = F.when(s == "/", s).otherwise(F.concat(s, F.lit("/")))
    inside = r.startswith(base) & (F.length(r) > F.length(base))
    rel = r.substr(F.length(base) + 1, F.length(r))
    return F.when(inside & ~rel.startswith(".."), rel).otherwise(F.lit(""))


def to_served(path, prefix) -> Column:
    """Client-relative path to served-tree path."""
    p, x = _c(path), _c(prefix)
    return F.when(x == "", p).when(p.isin("", "."), x).otherwise(F.concat_ws("/", x, p))


def from_served(path, prefix) -> Column:
    """Served-tree path to client-relative path; the prefix itself is `.`."""
    p, x = _c(path), _c(prefix)
    rest = F.when(p.startswith(x), p.substr(F.length(x) + 1, F.length(p))).otherwise(p)
    rest = F.regexp_replace(rest, "^/", "")
    return F.when(x == "", p).when(rest == "", F.lit(".")).otherwise(rest)


def rebase(path, from_root, to_root) -> Column:
    """Path under `from_root` as seen below `to_root` (both roots in one name space)."""
    return to_served(path, root_prefix(from_root, to_root))


def destination_base(src_arg, dst, is_dir=True) -> Column:
    """Where a source argument lands: `dir/` copies its contents into `dst`; `dir` and single
    files land in `dst/<basename>`. The arguments are values or columns."""
    src, to, directory = (x if isinstance(x, Column) else F.lit(x) for x in (src_arg, dst, is_dir))
    below = F.concat_ws("/", F.regexp_replace(to, r"/+\z", ""), basename(F.regexp_replace(src, r"/+\z", "")))
    return F.when(directory & src.endswith("/"), to).otherwise(below)


def map_path(path, src_arg, dst, is_dir=True) -> Column:
    """Destination path of an entry (relative to its source argument)."""
    base = destination_base(src_arg, dst, is_dir)
    directory = is_dir if isinstance(is_dir, Column) else F.lit(is_dir)
    return F.when(directory, F.concat_ws("/", F.regexp_replace(base, r"/+\z", ""), _c(path))).otherwise(base)
