"""One query per operator over the whole given tables; names match `registry.oracles`."""

from pyspark.sql import functions as F

from driftline.functions import paths
from driftline.functions.globs import filter_chain, glob_col, size_bounds
from driftline.operators import content, delta, events, filtering, hardlinks, packing, progress
from driftline.plans import sync, verify
from driftline.plans.delta_sync import delta_sync
from driftline.plans.multi import Source, plan_sources
from driftline.plans.work import work_plan
from driftline.session import cut, scratch
from driftline.sources import chunks, tables, tree
from driftline.streaming import events as live
from driftline.streaming import planning, sinks, stateful
from registry import samples as x

CHAIN = filter_chain(x.RULES, min_size=x.MIN_SIZE)
CAPS = sync.Capabilities(src_local=True, dst_local=False, dst_delta=True, delta=True)
BATCH = packing.BatchConfig(max_bytes=65536, size_limit=4096, max_count=20)
BPS = 1_000_000
HOUR = 3600
TEMP_SUFFIX = "part"

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _plan(spark, sf, **opts):
    return sync.sync_plan(x.src(spark, sf), x.dst(spark, sf), CHAIN, sync.SyncOptions(**opts))


# Sources and sinks

@query
def src_01_read_tree(spark, sf):
    """Documents written out as a partitioned folder, then listed as a tree (its directories)."""
    out = scratch(spark, "tree")
    x.table(spark, sf, "documents").select("source", "lang", "text").write.partitionBy("source", "lang").parquet(out)
    return tree.read_tree(spark, out.removeprefix("file:")).filter("file_type = 'dir'").select("rel_path", "file_type")


@query
def src_01_tree_files(spark, sf):
    """Documents written out as files, a file each, then listed with their sizes and times."""
    out = scratch(spark, "tree").removeprefix("file:")
    x.write_tree(spark, sf, out)
    return tree.read_tree(spark, out).filter("file_type = 'regular'").select("rel_path", "size", "mtime_ns")


@query
def src_02_subtree(spark, sf):
    return filtering.subtree(x.src(spark, sf), "src1").select("rel_path", "file_type", "size")


@query
def src_02_children(spark, sf):
    return filtering.subtree(x.dst(spark, sf), "", max_depth=1).select("rel_path", "file_type")


@query
def src_03_load_manifest(spark, sf):
    out = scratch(spark, "manifest")
    m = x.dst(spark, sf).withColumn("top", F.split("rel_path", "/")[0])
    tables.write_table(m, out, partition_by=["top"])
    return tables.load_manifest(spark, out).groupBy("file_type").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("mtime_ns").alias("newest_ns"))


@query
def src_04_read_content(spark, sf):
    """Documents written as text files, read back as bytes; one line break per document."""
    out = scratch(spark, "content")
    x.table(spark, sf, "documents").select("source", "text").write.partitionBy("source").text(out)
    files = tables.read_content(spark, out).filter(F.col("rel_path").endswith(".txt"))
    return files.groupBy(F.substring_index("rel_path", "/", 1).alias("dir")).agg(
        F.sum(F.octet_length("content")).alias("bytes"))


@query
def src_04_read_chunks(spark, sf):
    """The same files read in chunks by many tasks; `complete` files have all their chunks."""
    out = scratch(spark, "content")
    x.table(spark, sf, "documents").select("source", "text").write.partitionBy("source").text(out)
    read = chunks.read_chunks(spark, out.removeprefix("file:"), 4096).filter(F.col("rel_path").endswith(".txt"))
    files = read.groupBy("rel_path").agg(F.sum(F.octet_length("bytes")).alias("bytes"), F.max(F.octet_length("bytes")).alias("largest"))
    return (files.join(content.tree_hashes(read), "rel_path").groupBy(F.substring_index("rel_path", "/", 1).alias("dir"))
            .agg(F.sum("bytes").alias("bytes"), (F.max("largest") <= 4096).alias("bounded"), F.bool_and(F.col("hash").isNotNull()).alias("complete")))


@query
def src_05_read_events(spark, sf):
    out = scratch(spark, "log")
    ev = x.transfer_events(spark, sf)
    (ev.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time"), F.lit("INFO").alias("level"),
               F.lit("event").alias("msg"), "type", "path", "size", "worker", "error", "seq").write.json(out))
    got = tables.read_events(spark, out, run_id="all")
    return got.groupBy("type", "worker").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"),
                                             F.count("error").alias("errors"),
                                             F.max(F.unix_micros("ts")).alias("last_us"), F.max("seq").alias("last_seq"))


@query
def snk_01_write_table(spark, sf):
    """A table written twice holds the second content only."""
    out = scratch(spark, "table")
    tables.write_table(x.src(spark, sf), out)
    tables.write_table(x.dst(spark, sf), out)
    return tables.read_table(spark, out).select("rel_path", "file_type", "size", "mtime_ns")


@query
def snk_02_report_header(spark, sf):
    head = events.report_header(x.transfer_events(spark, sf))
    return head.withColumns({"started": F.unix_micros("started"), "completed": F.unix_micros("completed"),
                             "bytes_per_s": F.round("bytes_per_s", 6)})


@query
def agg_11_verify_errors(spark, sf):
    """Error summary of runs in which only verification fails."""
    return events.error_summary(x.transfer_events(spark, sf).filter("type <> 'FileFailed'")).select("run_id", "message")


@query
def snk_02_file_outcomes(spark, sf):
    ev = x.transfer_events(spark, sf).withColumn("path", F.regexp_extract("path", "^/dst/[0-9]+", 0))
    return events.file_outcomes(ev)


# Filters and projections

@query
def fil_01_filter_chain(spark, sf):
    return x.src(spark, sf).select("rel_path", "file_type", "size", CHAIN.matches().alias("kept"))


@query
def fil_02_globs(spark, sf):
    globs = {"star": "*.log", "any_depth": "**/*.md", "anchored": "/src3/*/doc_?.txt", "inner": "src2/en/*.bin",
             "dir_only": "en/", "one": "doc_??.*", "cls": "doc_[1-3]*", "negated": "doc_[!1-8]*", "rest": "src[02]/**",
             "open": "doc_[1*"}
    return x.src(spark, sf).select("rel_path", *[glob_col(g).alias(n) for n, g in globs.items()])


@query
def fil_03_size_bounds(spark, sf):
    return x.src(spark, sf).filter(size_bounds(200, 2000)).select("rel_path", "size")


@query
def fil_04_prune(spark, sf):
    return filtering.apply_filter(x.src(spark, sf), CHAIN, prune=True).select("rel_path", "file_type")


@query
def fil_05_known_types(spark, sf):
    odd = F.when((F.col("file_type") == "regular") & F.col("rel_path").endswith(".log"), "other").otherwise(F.col("file_type"))
    return filtering.known_types(x.src(spark, sf).withColumn("file_type", odd)).select("rel_path", "file_type")


@query
def fil_06_orphan_temps(spark, sf):
    m = x.src(spark, sf)
    base, up = paths.basename("rel_path"), paths.parent("rel_path")
    tag = F.substring(F.md5(F.col("rel_path").cast("binary")), 1, 8)
    temp = F.concat(up, F.lit("/."), base, F.lit("."), tag, F.lit("." + TEMP_SUFFIX))
    named = F.when(F.col("rel_path").endswith(".log"), temp).when(
        F.col("rel_path").endswith(".tmp"), F.concat("rel_path", F.lit("." + TEMP_SUFFIX))).otherwise(F.col("rel_path"))
    return filtering.orphan_temps(m.withColumn("rel_path", named), TEMP_SUFFIX).select("rel_path", "size")


@query
def prj_01_map_paths(spark, sf):
    is_dir = F.col("file_type") == "dir"
    return x.src(spark, sf).select(
        "rel_path", paths.map_path("rel_path", "/data/tree/", "/backup").alias("contents"),
        paths.map_path("rel_path", "/data/tree", "/backup").alias("below"),
        paths.destination_base(F.concat(F.lit("/data/"), F.col("rel_path"), F.when(is_dir, "/").otherwise("")),
                               "/backup", is_dir).alias("as_argument"))


@query
def prj_02_strip_root(spark, sf):
    ev = x.transfer_events(spark, sf)
    return ev.select("seq", paths.strip_root("path", "/dst").alias("below_dst"),
                     paths.strip_root("path", "/dst/1/").alias("below_1"), paths.strip_root("path", "").alias("as_is"))


@query
def prj_03_rebase(spark, sf):
    ev = x.transfer_events(spark, sf).withColumn("root", F.regexp_extract("path", "^(/dst/[0-9]+)", 1))
    prefix = paths.root_prefix(F.col("root"), F.lit("/dst/"))
    return ev.select(
        "seq", prefix.alias("prefix"), paths.root_prefix(F.col("root"), F.lit("/dst/1")).alias("guarded"),
        paths.to_served(paths.basename("path"), prefix).alias("served"),
        paths.from_served(paths.to_served(paths.basename("path"), prefix), prefix).alias("client"))


@query
def prj_04_copy_strategy(spark, sf):
    plan = sync.with_strategy(_plan(spark, sf), CAPS, delta_min=2048)
    return plan.select("rel_path", "action", "size", "strategy")


@query
def prj_05_chunks(spark, sf):
    return packing.chunks(x.src(spark, sf), 4096)


# Joins

def _chunked(spark, sf, size):
    return [content.chunk_content(c, size) for c in (x.src_content(spark, sf), x.dst_content(spark, sf))]


@query
def joi_01_skipped(spark, sf):
    return sync.skipped(x.src(spark, sf), x.dst(spark, sf)).select("rel_path", "size")


@query
def joi_02_sync_plan(spark, sf):
    return _plan(spark, sf, delete=True).select("rel_path", "action", "file_type", "size", "reason", "link_target")


@query
def joi_02_plan_summary(spark, sf):
    return sync.plan_summary(_plan(spark, sf, delete=True))


@query
def joi_02_plan_capabilities(spark, sf):
    """A source that does not tell inodes: nothing is linked."""
    opts = sync.within(sync.SyncOptions(delete=True), sync.Capabilities(src_hardlinks=False))
    return sync.sync_plan(x.src(spark, sf), x.dst(spark, sf), CHAIN, opts).select("rel_path", "action", "reason", "link_target")


@query
def joi_02_work_plan(spark, sf):
    """Strategy, batch, pieces and times of everything the plan writes."""
    return work_plan(_plan(spark, sf, delete=True), CAPS, BPS, BATCH, chunk_bytes=4096, delta_min=2048, block_rows=256, run_blocks=8).drop("dst_path")


@query
def joi_03_extraneous(spark, sf):
    return sync.extraneous(x.src(spark, sf), x.dst(spark, sf), CHAIN).select("rel_path", "file_type")


@query
def joi_04_verify(spark, sf):
    return verify.verify_trees(x.src(spark, sf), x.dst(spark, sf), x.src_content(spark, sf), x.dst_content(spark, sf), CHAIN)


@query
def joi_04_verify_chunks(spark, sf):
    """The same verification by digest trees over chunks."""
    return verify.verify_trees(x.src(spark, sf), x.dst(spark, sf), *_chunked(spark, sf, 1024), CHAIN, lambda c: content.tree_hashes(c, 4))


@query
def joi_04_differing_chunks(spark, sf):
    return content.differing_chunks(*_chunked(spark, sf, 1024))


@query
def joi_05_metadata_drift(spark, sf):
    d = sync.metadata_drift(x.src(spark, sf), x.dst(spark, sf))
    return d.select("rel_path", F.array_join("drift", ",").alias("drift"))


@query
def joi_06_block_matches(spark, sf):
    a, b = (delta.signatures(c, 512) for c in (x.src_content(spark, sf), x.dst_content(spark, sf)))
    return delta.block_matches(a, b)


@query
def joi_06_changed_blocks(spark, sf):
    a, b = (delta.signatures(c, 512) for c in (x.src_content(spark, sf), x.dst_content(spark, sf)))
    return delta.changed_blocks(a, b)


@query
def joi_07_hardlink_targets(spark, sf):
    return hardlinks.hardlink_targets(x.src(spark, sf))


def _ops(spark, sf):
    return delta.match_blocks(x.src_content(spark, sf), delta.match_signatures(x.dst_content(spark, sf)))


@query
def joi_08_apply_delta(spark, sf):
    """Ops are made once, as a table, and read for copies and for literals."""
    return verify.file_hashes(delta.apply_delta(cut(_ops(spark, sf)), x.dst_content(spark, sf)))


@query
def joi_08_rebuild_chunks(spark, sf):
    """Files in chunks of 1 KiB, matched and rebuilt chunk by chunk."""
    a, b = _chunked(spark, sf, 1024)
    ops = cut(delta.match_blocks(a, delta.match_signatures(b), chunk_bytes=1024, reach=512))
    return delta.rebuild_chunks(ops, b, chunk_bytes=1024).select("rel_path", "size", "chunk_idx", "offset", F.sha2("bytes", 256).alias("hash"))


# Aggregates

@query
def agg_01_prescan(spark, sf):
    return filtering.prescan(x.src(spark, sf), CHAIN)


@query
def agg_02_snapshot(spark, sf):
    return events.snapshot(x.transfer_events(spark, sf))


@query
def agg_03_hardlink_groups(spark, sf):
    return hardlinks.hardlink_groups(x.src(spark, sf))


@query
def agg_04_signatures(spark, sf):
    return delta.signatures(x.src_content(spark, sf)).drop("weak")


@query
def agg_04_chunked_signatures(spark, sf):
    """The same blocks from chunks that cut them apart."""
    return delta.signatures(content.chunk_content(x.src_content(spark, sf), 1000)).drop("weak")


@query
def agg_05_tree_hashes(spark, sf):
    return content.tree_hashes(content.chunk_content(x.src_content(spark, sf), 1024), 4)


@query
def agg_05_file_hashes(spark, sf):
    return verify.file_hashes(x.src_content(spark, sf))


@query
def agg_06_delta_stats(spark, sf):
    """Lengths only: no literal byte leaves its task."""
    sig = delta.match_signatures(x.dst_content(spark, sf))
    return delta.delta_stats(delta.match_lengths(x.src_content(spark, sf), sig)).drop("saved_ratio")


def _sources(spark, sf):
    docs = x.table(spark, sf, "documents")
    slash = F.when(F.pmod("doc_id", F.lit(2)) == 0, "/").otherwise("")
    return docs.select(F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", slash).alias("src_arg"),
                       F.lit(True).alias("is_dir")).distinct()


@query
def agg_07_dst_overlaps(spark, sf):
    return sync.dst_overlaps(_sources(spark, sf), "/backup")


@query
def agg_07_guarded_extraneous(spark, sf):
    """Extraneous entries but for destinations that several sources share. Each top folder is a
    destination, `.bin` files are missing from the sources, and src0 comes from one source only."""
    top = F.concat(F.lit("/backup/"), F.substring_index("rel_path", "/", 1))
    s, d = (m.withColumn("dst_base", top) for m in (x.src(spark, sf).filter("NOT endswith(rel_path, '.bin')"), x.dst(spark, sf)))
    sources = (x.table(spark, sf, "documents").filter("source <> 'src0' OR lang = 'en'")
               .select(F.concat(F.lit("/data/"), "lang", F.lit("/"), "source").alias("src_arg"), F.lit(True).alias("is_dir")).distinct())
    return sync.guarded_extraneous(s, d, sync.dst_overlaps(sources, "/backup"), CHAIN).select("rel_path", "file_type")


@query
def agg_08_verify_summary(spark, sf):
    return verify.verify_summary(joi_04_verify(spark, sf))


@query
def agg_09_summary(spark, sf):
    return events.summary(x.transfer_events(spark, sf))


@query
def agg_10_batch_outcomes(spark, sf):
    """Events as batch results: 50 files per batch; started but never answered files are open,
    a batch whose first file fails verification is lost as a whole."""
    ev = x.transfer_events(spark, sf).withColumn("batch_id", F.expr("seq div 50"))
    results = ev.filter("type <> 'FileStarted'").select(
        "batch_id", F.col("path").alias("rel_path"), (F.col("type") != "FileFailed").alias("ok"))
    lost = ev.filter("seq % 50 = 0 and type = 'VerifyFailed'").select("batch_id")
    return packing.batch_outcomes(ev.select("batch_id", F.col("path").alias("rel_path"), "size"), results, lost)


@query
def agg_11_error_summary(spark, sf):
    return events.error_summary(x.transfer_events(spark, sf).withColumn("error", F.concat_ws(" ", "error", "path")))


@query
def agg_12_run_outcome(spark, sf):
    return events.run_outcome(x.transfer_events(spark, sf))


# Windows

@query
def win_01_pack_batches(spark, sf):
    return packing.pack_batches(x.src(spark, sf), BATCH, block_rows=256, run_blocks=8).select("rel_path", "file_type", "size", "batch_id")


@query
def win_01_approximate_batches(spark, sf):
    return packing.approximate_batches(x.src(spark, sf), BATCH).select("rel_path", "size", "batch_id")


def _ticks(spark, sf):
    return progress.ticks(x.transfer_events(spark, sf), HOUR)


@query
def win_02_ticks(spark, sf):
    return _ticks(spark, sf)


@query
def win_03_rolling(spark, sf):
    return progress.rolling(_ticks(spark, sf), 10).select("run_id", "tick", "avg_bytes", "avg_files")


@query
def win_04_last_samples(spark, sf):
    t = progress.last_samples(_ticks(spark, sf), 8)
    return t.select("run_id", "tick", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


def _with_totals(spark, sf):
    ev = x.transfer_events(spark, sf)
    totals = ev.groupBy("run_id").agg(F.sum("size").alias("bytes_total"))
    return progress.with_totals(progress.ticks(ev, HOUR), totals)


@query
def win_05_eta(spark, sf):
    return progress.eta(_with_totals(spark, sf), F.col("run_total"), every_s=HOUR).select("run_id", "tick", "eta_s")


@query
def win_06_progress(spark, sf):
    return progress.progress(_with_totals(spark, sf), F.col("run_total")).select(
        "run_id", "tick", "bytes_copied", "files_copied", "bytes_total", "fraction")


@query
def win_07_rate_mode(spark, sf):
    return progress.rate_mode(_ticks(spark, sf), on=1.0, off=0.5).select("run_id", "tick", "high")


@query
def win_08_busy_workers(spark, sf):
    return events.busy_workers(x.transfer_events(spark, sf)).select("run_id", "seq", "worker", "type", "busy")


@query
def win_09_in_flight(spark, sf):
    return events.in_flight(x.transfer_events(spark, sf), F.expr("timestamp'2024-01-20 12:00:00'"))


def _sparse(spark, sf):
    return x.table(spark, sf, "documents").selectExpr(
        "concat('doc_', doc_id) AS rel_path",
        "concat(encode(text, 'utf-8'), unhex(repeat('00', 512 * CAST(doc_id % 17 AS INT))), encode(text, 'utf-8')) AS content")


@query
def win_10_segments(spark, sf):
    return packing.segments(_sparse(spark, sf), 512)


@query
def win_10_data_bytes(spark, sf):
    return packing.data_bytes(packing.segments(_sparse(spark, sf), 512))


@query
def win_11_schedule(spark, sf):
    return packing.schedule(x.src_files(spark, sf).drop("content"), BPS).select("rel_path", "est_start_s", "est_end_s")


@query
def win_11_schedule_arrivals(spark, sf):
    """Files in order of an arrival time taken from their modification time."""
    rows = x.src_files(spark, sf).drop("content")
    arrival = (F.col("mtime_ns") - 1704067200000000000) / F.lit(1e9) / 512
    return packing.schedule(rows, BPS, ["mtime_ns", "rel_path"], arrival).select("rel_path", "est_start_s", "est_end_s")


@query
def win_12_file_durations(spark, sf):
    return events.file_durations(x.transfer_events(spark, sf))


# Order, sets

@query
def srt_01_delete_order(spark, sf):
    """Files in path order, then directories from the last path, with their position."""
    gone = sync.delete_positions(sync.extraneous(x.src(spark, sf), x.dst(spark, sf), CHAIN))
    return gone.select("rel_path", "file_type", "position")


@query
def srt_01_delete_sorted(spark, sf):
    return sync.delete_order(sync.extraneous(x.src(spark, sf), x.dst(spark, sf), CHAIN)).select("rel_path", "size")


@query
def srt_02_recent_errors(spark, sf):
    return events.recent_errors(x.transfer_events(spark, sf), 5).withColumn("ts", F.unix_micros("ts"))


@query
def srt_03_lowest_block(spark, sf):
    """Files with every block twice: each block matches its first copy."""
    twice = x.table(spark, sf, "documents").selectExpr(
        "concat('doc_', doc_id) AS rel_path", "concat(text, repeat('.', pmod(-octet_length(text), 512))) AS t").selectExpr(
        "rel_path", "encode(repeat(t, 3), 'utf-8') AS content")
    sig = delta.signatures(twice, 512)
    return delta.block_matches(sig, sig)


@query
def set_01_merge_sources(spark, sf):
    files, extra = x.src(spark, sf), x.dst(spark, sf).filter("file_type = 'regular'")
    got = sync.merge_sources([("/data/a/", files, True), ("/data/b", files, True), ("/data/one.txt", extra, False)],
                             "/backup", CHAIN)
    return got.select("source_ord", "rel_path", "dst_base", "dst_path", "size")


@query
def set_01_plan_sources(spark, sf):
    """The same tree as contents of the destination and as a folder below it."""
    s = x.src(spark, sf)
    plan = plan_sources([Source("/data/tree/", s), Source("/data/tree", s)], x.dst(spark, sf), CHAIN,
                        sync.SyncOptions(delete=True, dst_base="/backup"))
    return plan.select("source_ord", "dst_path", "action", "link_target")


@query
def set_02_apply_plan(spark, sf):
    s, d = x.src(spark, sf), x.dst(spark, sf)
    after = sync.apply_plan(s, d, sync.sync_plan(s, d, CHAIN, sync.SyncOptions(delete=True)))
    return after.select("rel_path", "file_type", "size", "mtime_ns", "mode", "uid")


@query
def set_02_replan(spark, sf):
    """Planning again over the applied plan leaves nothing to copy or delete."""
    s, d = x.src(spark, sf), x.dst(spark, sf)
    opts = sync.SyncOptions(delete=True)
    after = sync.apply_plan(s, d, sync.sync_plan(s, d, CHAIN, opts))
    return sync.plan_summary(sync.sync_plan(s, after, CHAIN, opts)).select("action", "n")


# Streams

@query
def stm_01_stream_events(spark, sf):
    """Events written as JSON logs and streamed back from the log folder."""
    out = scratch(spark, "log")
    (x.transfer_events(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time"), F.lit("event").alias("msg"),
        "type", "path", "size", "worker", "error").write.json(out))
    got = sinks.drain(live.stream_events(spark, out, run_id="all"), name="events")
    return got.select(F.unix_micros("ts").alias("ts"), "type", "path", "size", "worker", "error")


@query
def stm_02_stream_snapshot(spark, sf):
    return sinks.drain(live.stream_snapshot(x.event_stream(spark, sf)), "update", ["run_id"], "snapshot")


@query
def stm_03_stream_ticks(spark, sf):
    t = live.stream_ticks(x.event_stream(spark, sf), "1 hour", "1 day")
    return sinks.drain(t, "update", ["run_id", "start"], "ticks").withColumn("start", F.unix_micros("start"))


@query
def stm_04_stream_rolling(spark, sf):
    t = live.stream_rolling(x.event_stream(spark, sf), "10 hours", "1 hour", "1 day")
    return sinks.drain(t, "update", ["run_id", "end"], "rolling").withColumn("end", F.unix_micros("end"))


@query
def stm_05_worker_state(spark, sf):
    """State of each worker after the last event."""
    got = sinks.drain(stateful.worker_state(x.event_stream(spark, sf), stall_after_s=HOUR, delay="1 day"), name="workers")
    last = got.filter(F.col("kind").isin("in_flight", "idle")).groupBy("run_id", "worker").agg(
        F.max_by(F.struct("kind", "path", "size"), "at_us").alias("v"), F.max("at_us").alias("at_us"))
    return last.select("run_id", "worker", "v.kind", "v.path", "v.size", "at_us")


@query
def stm_05_finished(spark, sf):
    """Files that end right after their worker started one, with their durations."""
    got = sinks.drain(stateful.worker_state(x.event_stream(spark, sf), stall_after_s=HOUR, delay="1 day"), name="workers")
    return got.filter("kind = 'finished'").select("run_id", "worker", "path", "size", "at_us", "duration_us")


@query
def stm_06_session_batches(spark, sf):
    got = live.session_batches(x.event_stream(spark, sf), "20 minutes", ["run_id"])
    return (sinks.drain(got, "complete", name="sessions")
            .withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end")))


@query
def stm_06_stream_batches(spark, sf):
    """Batches of eight lanes over tasks that arrive newest first, in several micro-batches of whole
    lanes: files and bytes per batch, and of the files that travel alone. Batches close by count, by
    bytes and by a pause of six hours."""
    out = scratch(spark, "tasks")
    tasks = x.transfer_events(spark, sf).selectExpr("ts", "path AS rel_path", "'regular' AS file_type", "size", "worker")
    tasks.repartition(8, "worker").sortWithinPartitions(F.desc("ts")).write.parquet(out)
    stream = spark.readStream.schema(tasks.schema).option("maxFilesPerTrigger", 3).parquet(out)
    cfg = packing.BatchConfig(max_bytes=60_000, size_limit=15_000, max_count=12)
    got = sinks.drain(stateful.stream_batches(stream, cfg, 6 * HOUR * 1000, lane=F.col("worker")), name="batches")
    return got.filter("kind = 'file'").groupBy("lane", "batch_no").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query
def stm_07_incremental_plan(spark, sf):
    out = scratch(spark, "plan")
    planning.incremental_plan(x.src_stream(spark, sf), x.dst(spark, sf), out, CHAIN).awaitTermination()
    return planning.read_plan(spark, out).select("rel_path", "action", "reason")


@query
def stm_07_folded_plan(spark, sf):
    """The same plan against a destination stored by path hash, in several micro-batches that are
    folded into one table."""
    out, where = scratch(spark, "plan"), scratch(spark, "dst")
    tables.write_hashed(x.dst(spark, sf), where, 16)
    listed = scratch(spark, "listing")
    x.src_files(spark, sf).drop("content").repartition(3, "rel_path").write.parquet(listed)
    stream = x.listed_stream(spark, listed)
    planning.incremental_plan(stream, tables.read_hashed(spark, where), out, CHAIN, buckets=16).awaitTermination()
    planning.compact_plan(spark, out)
    return planning.read_plan(spark, out).select("rel_path", "action", "reason")


@query
def stm_08_live_failures(spark, sf):
    return sinks.drain(live.live_failures(x.event_stream(spark, sf)), name="failures").withColumn("ts", F.unix_micros("ts"))


@query
def stm_09_fan_out(spark, sf):
    base = scratch(spark, "fan")
    ev = x.event_stream(spark, sf).withColumn("level", F.when(events.is_type("FileFailed", "VerifyFailed"), "ERROR")
                                              .when(events.is_type("FileCompleted"), "INFO").otherwise("DEBUG"))
    conditions = {"all": None, "info": sinks.at_least("INFO"), "errors": sinks.at_least("ERROR")}
    sinks.fan_out(ev, {f"{base}/{n}": c for n, c in conditions.items()}, f"{base}/checkpoint").awaitTermination()
    out = None
    for n in conditions:
        part = spark.read.schema(ev.schema).parquet(f"{base}/{n}").select(F.lit(n).alias("sink"), "level", "size")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("sink", "level").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


# Kernels

@query
def udf_01_match_blocks(spark, sf):
    return delta.numbered(_ops(spark, sf)).select("rel_path", "seq", "block_idx", "offset", "length",
                                  F.sha2("literal", 256).alias("literal_sha"))


@query
def udf_01_match_chunks(spark, sf):
    """The same match with files cut into chunks of 1 KiB."""
    sig = delta.match_signatures(x.dst_content(spark, sf))
    return delta.delta_stats(delta.match_lengths(x.src_content(spark, sf), sig, chunk_bytes=1024, reach=512)).drop("saved_ratio")


@query
def udf_01_match_chunked(spark, sf):
    """The same match between contents that come in chunks."""
    a, b = _chunked(spark, sf, 1024)
    return delta.delta_stats(delta.match_lengths(a, delta.match_signatures(b), chunk_bytes=1024, reach=512)).drop("saved_ratio")


@query
def udf_02_delta_sync(spark, sf):
    return delta_sync(x.src_content(spark, sf), x.dst_content(spark, sf), delta_min=2048)
