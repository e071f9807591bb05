"""The sync plan: one row per path over both trees, built from joins on `rel_path` only."""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.globs import FilterChain
from driftline.functions.paths import ancestors, destination_base, map_path, parent
from driftline.operators.groups import lookup_groups
from driftline.operators.ordered import BLOCK, Scan, block_scan, range_blocks
from driftline.session import cut

WRITES = ("mkdir", "symlink", "hardlink", "copy_new", "copy_changed")
DELETES = ("delete_file", "delete_dir")


@dataclass(frozen=True)
class SyncOptions:
    delete: bool = False
    hardlinks: bool = True
    prune: bool = True
    mtime_granularity_ns: int = 1
    dst_base: str = ""
    dst_rows: bool = True


def same_mtime(a: Column, b: Column, granularity_ns=1) -> Column:
    """Exact by default; a coarser granularity serves stores that keep whole seconds."""
    if granularity_ns <= 1:
        return a == b
    g = F.lit(granularity_ns)
    return (a - F.pmod(a, g)) == (b - F.pmod(b, g))


def _unchanged(s: DataFrame, d: DataFrame, granularity_ns, how) -> DataFrame:
    s, d = s.alias("s"), d.select("rel_path", "size", "mtime_ns").alias("d")
    same = ((F.col("s.rel_path") == F.col("d.rel_path")) & (F.col("s.size") == F.col("d.size"))
            & same_mtime(F.col("s.mtime_ns"), F.col("d.mtime_ns"), granularity_ns))
    return s.filter(F.col("file_type") == "regular").join(d, same, how)


def skipped(s: DataFrame, d: DataFrame, granularity_ns=1) -> DataFrame:
    """Regular source files whose destination has the same path, size and time. The type of the
    destination entry is not looked at."""
    return _unchanged(s, d, granularity_ns, "left_semi")


def not_skipped(s: DataFrame, d: DataFrame, granularity_ns=1) -> DataFrame:
    return _unchanged(s, d, granularity_ns, "left_anti")


def extraneous(s: DataFrame, d: DataFrame, chain=FilterChain()) -> DataFrame:
    """Destination entries that pass the filter and have no source entry of any type. The filter
    is put to each path on its own: excluded paths are protected, their parents are not."""
    return d.filter(chain.matches()).join(s.select("rel_path"), "rel_path", "left_anti")


def delete_order(x: DataFrame) -> DataFrame:
    """Files in path order, then directories from the last path to the first, so that children
    go before their parents."""
    is_dir = F.col("file_type") == "dir"
    return x.orderBy(is_dir, F.when(is_dir, F.col("rel_path")).desc_nulls_first(), "rel_path")


def delete_positions(x: DataFrame, parts=None) -> DataFrame:
    """`delete_order` as a column `position` from 0, for a delete list that is kept as a table.
    Counted in slices of the path order; directories are counted from the end."""
    slices = range_blocks(x.withColumn("_dir", (F.col("file_type") == "dir").cast("int")), ["_dir"], ["rel_path"], parts)
    rows = block_scan(slices, ["_dir"], ["rel_path"], {"_at": Scan("sum", F.lit(1), before=True)}).drop(BLOCK)
    # The rows were written, so counting them reads no more than their number.
    last = slices.agg(F.count("*") - 1).scalar()
    position = F.when(F.col("_dir") == 0, F.col("_at")).otherwise(last - F.col("_at"))
    return rows.withColumn("position", position).drop("_dir", "_at")


PLAN = ("rel_path", "dst_path", "action", "file_type", "size", "reason", "basis_size", "link_target")


def compare(s: DataFrame, d: DataFrame, chain=FilterChain(), opts=SyncOptions()) -> DataFrame:
    """The plan before hardlinks are settled, from one full outer join, with `dev`, `ino` and whether a
    copy has several links (`several`). Each manifest is read and shuffled once."""
    same = same_mtime(F.col("mtime_ns"), F.col("d_mtime_ns"), opts.mtime_granularity_ns) & (
        F.col("size") == F.col("d_size"))
    dst = d.select("rel_path", F.col("file_type").alias("d_type"), F.col("size").alias("d_size"),
                   F.col("mtime_ns").alias("d_mtime_ns"), chain.matches().alias("d_kept"))
    inode = ("dev", "ino", "nlink") if opts.hardlinks else ()
    src = s.select("rel_path", "file_type", "size", "mtime_ns", "link_target", *inode,
                   chain.matches().alias("matched"),
                   (chain.under_excluded_dir() if opts.prune else F.lit(False)).alias("pruned"))

    both = src.join(dst, "rel_path", "full_outer" if opts.dst_rows else "left")
    no_src, no_dst = F.col("file_type").isNull(), F.col("d_type").isNull()
    kept = F.col("matched") & ~F.col("pruned")
    regular = F.col("file_type") == "regular"
    delete = F.when(F.col("d_type") == "dir", "delete_dir").otherwise("delete_file") if opts.delete else F.lit("keep")

    action = (F.when(no_src & ~F.col("d_kept"), "excluded")
               .when(no_src, delete)
               .when(~kept, "excluded")
               .when(F.col("file_type") == "dir", "mkdir")
               .when(F.col("file_type") == "symlink", "symlink")
               .when(~regular, F.when(no_dst, "ignored").otherwise("keep"))
               .when(same, "skip")
               .when(no_dst, "copy_new")
               .otherwise("copy_changed"))
    reason = (F.when(no_src & ~F.col("d_kept"), "protected")
               .when(no_src, "extraneous")
               .when(~F.col("matched"), "rule")
               .when(F.col("pruned"), "under excluded directory")
               .when(no_dst, "new")
               .when(regular & (F.col("size") != F.col("d_size")), "size")
               .when(regular & ~same, "mtime")
               .otherwise("same"))
    where = F.concat_ws("/", F.lit(opts.dst_base.rstrip("/")), "rel_path") if opts.dst_base else F.col("rel_path")
    several = F.coalesce(F.col("action").isin("copy_new", "copy_changed") & (F.col("nlink") > 1), F.lit(False)) if inode else F.lit(False)
    return (both.select(
        "rel_path", where.alias("dst_path"), action.alias("action"),
        F.coalesce("file_type", "d_type").alias("file_type"),
        F.coalesce("size", "d_size").alias("size"), reason.alias("reason"),
        F.col("d_size").alias("basis_size"), "link_target", *inode)
        .filter("action <> 'ignored'")
        .withColumn("several", several))


def sync_plan(s: DataFrame, d: DataFrame, chain=FilterChain(), opts=SyncOptions()) -> DataFrame:
    """Action and reason per path. Directories and symlinks are always made again; for regular
    files the order of tests is filter, skip, hardlink, copy. Without `dst_rows` only source
    entries are planned, for sources that come in piece by piece.

    Only copies can become links, so hardlinks are settled behind the join, among the copies with
    several links alone. For that the compared rows are written once; without hardlinks nothing is."""
    rows = compare(s, d, chain, opts)
    if not opts.hardlinks:
        return rows.select(*PLAN)
    rows = cut(rows)
    several = rows.filter("several").select(*PLAN, "dev", "ino")
    first = several.groupBy("dev", "ino").agg(F.min("rel_path").alias("first_path"), F.count("*").alias("n")).filter("n > 1")
    placed = lookup_groups(several, first, ["dev", "ino"])
    later = F.col("first_path") < F.col("rel_path")
    linked = placed.withColumns({"action": F.when(later, "hardlink").otherwise(F.col("action")),
                                 "link_target": F.when(later, F.col("first_path")).otherwise(F.col("link_target"))})
    return rows.filter("NOT several").select(*PLAN).unionByName(linked.select(*PLAN))


def plan_summary(plan: DataFrame) -> DataFrame:
    """Entries and bytes per action."""
    return plan.groupBy("action").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def apply_plan(s: DataFrame, d: DataFrame, plan: DataFrame) -> DataFrame:
    """The destination manifest after the plan has run: untouched entries stay, written ones take
    the source's row. Removing a directory also removes protected entries below it. The plan is
    written once and read for each step."""
    acts = cut(plan.select("rel_path", "action", "reason"))
    stays = d.join(acts, "rel_path").filter(~F.col("action").isin(*WRITES, *DELETES))
    # Ancestors are expanded once per parent directory, not once per file.
    parents = (acts.filter((F.col("reason") == "protected")).select(parent("rel_path").alias("dir"))
                   .filter("dir is not null").groupBy("dir").count())
    doomed = (parents.select("dir", F.explode(F.concat(ancestors("dir"), F.array("dir"))).alias("rel_path"))
                     .join(acts.filter("action = 'delete_dir'").select("rel_path"), "rel_path", "left_semi")
                     .groupBy("dir").count().select(F.col("dir").alias("gone_dir")))
    # All other rows get a key of their own that no directory has, so they spread evenly.
    own = F.concat(F.lit("//"), F.col("rel_path"))
    stays = (stays.withColumn("_dir", F.coalesce(F.when(F.col("reason") == "protected", parent("rel_path")), own))
                  .join(doomed, F.col("_dir") == F.col("gone_dir"), "left_anti"))
    cols = [c for c in d.columns]
    written = s.join(acts.filter(F.col("action").isin(*WRITES)), "rel_path")
    return stays.select(*cols).unionByName(written.select(*cols))


def merge_sources(sources, dst: str, chain=FilterChain(), prune=True) -> DataFrame:
    """Union of several sources into one task stream. `sources` is a list of (argument, manifest,
    is_dir); directory sources are filtered, single files go in as they are."""
    out = None
    for i, (arg, m, is_dir) in enumerate(sources):
        part = m.filter(chain.keeps(prune)) if is_dir else m
        part = (part.withColumn("source_ord", F.lit(i))
                    .withColumn("dst_base", destination_base(arg, dst, is_dir))
                    .withColumn("dst_path", map_path("rel_path", arg, dst, is_dir)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dst_overlaps(sources: DataFrame, dst: str) -> DataFrame:
    """Destination bases that several directory sources share, from a table (src_arg, is_dir).
    Deletion is switched off there, because each source would remove the others' entries."""
    return (sources.filter("is_dir")
                   .groupBy(destination_base(F.col("src_arg"), dst, F.col("is_dir")).alias("dst_base"))
                   .agg(F.count("*").alias("sources")).filter("sources > 1"))


def guarded_extraneous(s: DataFrame, d: DataFrame, overlaps: DataFrame, chain=FilterChain()) -> DataFrame:
    """`extraneous` for manifests that carry `dst_base`, leaving out overlapping destinations."""
    left = d.filter(chain.matches()).join(s.select("dst_base", "rel_path"), ["dst_base", "rel_path"], "left_anti")
    return left.join(overlaps.select("dst_base"), "dst_base", "left_anti")


@dataclass(frozen=True)
class Capabilities:
    src_local: bool = True
    dst_local: bool = True
    src_delta: bool = False
    dst_delta: bool = False
    bandwidth_limited: bool = False
    delta: bool = False
    src_hardlinks: bool = True      # inodes of the source are known
    src_sparse: bool = True         # holes of the source are known
    src_xattrs: bool = True
    dst_xattrs: bool = True
    dst_batches: bool = True        # a remote destination takes several small files at once


def within(opts, caps: Capabilities):
    """Sync or metadata options without what an endpoint cannot do."""
    if isinstance(opts, SyncOptions):
        return replace(opts, hardlinks=opts.hardlinks and caps.src_hardlinks)
    return replace(opts, xattrs=opts.xattrs and caps.src_xattrs and caps.dst_xattrs)


def copy_strategy(caps=Capabilities(), delta_min=64 * 1024, size=None, basis_size=None) -> Column:
    """How a file's bytes travel: kernel copy between local trees without a rate limit, else a
    delta against an existing basis for files of at least `delta_min` bytes, else a stream."""
    size = F.col("size") if size is None else size
    basis = F.coalesce(F.col("basis_size") if basis_size is None else basis_size, F.lit(0))
    if caps.src_local and caps.dst_local and not caps.bandwidth_limited:
        return F.lit("kernel")
    if not caps.delta:
        return F.lit("stream")
    if caps.dst_delta:
        kind = "delta_push"
    elif caps.src_delta and caps.dst_local:
        kind = "delta_pull"
    else:
        kind = "delta_basis"
    return F.when((size >= delta_min) & (basis > 0), kind).otherwise("stream")


def with_strategy(plan: DataFrame, caps=Capabilities(), delta_min=64 * 1024) -> DataFrame:
    copies = F.col("action").isin("copy_new", "copy_changed")
    return plan.withColumn("strategy", F.when(copies, copy_strategy(caps, delta_min)))


@dataclass(frozen=True)
class MetadataOptions:
    mode: bool = True
    mtime: bool = True
    atime: bool = False
    owner: bool = True
    xattrs: bool = False


def metadata_drift(s: DataFrame, d: DataFrame, opts=MetadataOptions()) -> DataFrame:
    """Entries on both sides whose metadata differs, with the names of the differing groups."""
    a, b = s.alias("a"), d.alias("b")

    def differs(col):
        return ~F.col(f"a.{col}").eqNullSafe(F.col(f"b.{col}"))

    tests = []
    if opts.mode:
        perm = [F.col(f"{x}.mode").bitwiseAND(F.lit(0o7777)) for x in "ab"]
        tests.append(("mode", ~perm[0].eqNullSafe(perm[1])))
    if opts.mtime:
        tests.append(("mtime", differs("mtime_ns")))
    if opts.atime:
        tests.append(("atime", differs("atime_ns")))
    if opts.owner:
        tests += [("uid", differs("uid")), ("gid", differs("gid"))]
    if opts.xattrs:
        entries = [F.array_sort(F.map_entries(F.col(f"{x}.xattrs"))) for x in "ab"]
        tests.append(("xattrs", ~entries[0].eqNullSafe(entries[1])))
    drift = F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))
    return (a.join(b, "rel_path").select("rel_path", drift.alias("drift")).filter(F.size("drift") > 0))
