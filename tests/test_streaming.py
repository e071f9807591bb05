import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.functions.globs import filter_chain
from driftline.operators import events
from driftline.operators.packing import BatchConfig
from driftline.schemas import TRANSFER_EVENTS
from driftline.streaming import events as live
from driftline.streaming import planning, sinks, stateful
from registry import samples
from registry.queries import QUERIES

from tests_util import SF

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


@pytest.fixture
def feed(spark, tmp_path):
    """Write rows as one more file of a folder and return the stream over it, one file per batch."""
    def make(schema):
        count = iter(range(1000))

        def add(*rows):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{next(count):03d}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return add, stream
    return make


def event(sec, kind, worker=1, path="a", size=1, seq=0):
    row = {"run_id": "r", "ts": at(sec), "seq": seq, "type": kind, "path": path, "size": size, "worker": worker}
    return tuple(row.get(f.name) for f in TRANSFER_EVENTS)


def test_counters_equal_the_batch(spark):
    got = sinks.drain(live.stream_snapshot(samples.event_stream(spark, SF)), "update", ["run_id"])
    want = events.snapshot(samples.transfer_events(spark, SF), ["run_id"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_tables_stream_from_a_file_or_a_folder(spark, tmp_path):
    for name in ("documents", "events", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        # Another table whose name begins alike stays out.
        spark.range(5).write.parquet(f"{tmp_path}/{name}.parquet2")
    for stream, batch in ((samples.src_stream, samples.src_files), (samples.event_stream, samples.transfer_events)):
        want = None
        for sf in (SF, str(tmp_path)):
            seen = stream(spark, sf)
            got = sinks.drain(seen).select(*[c for c in batch(spark, sf).columns if c in seen.columns])
            rows = sorted(map(str, got.collect()))
            want = want or sorted(map(str, batch(spark, SF).select(*got.columns).collect()))
            assert rows == want and rows
    plan = [sorted(map(tuple, QUERIES["stm_07_incremental_plan"](spark, sf).collect())) for sf in (SF, str(tmp_path))]
    assert plan[0] == plan[1] and plan[0]


def test_worker_state(spark, feed, tmp_path):
    add, stream = feed(TRANSFER_EVENTS)
    add(event(0, "FileStarted", path="a"), event(0, "FileStarted", worker=2, path="x"))
    add(event(3, "FileCompleted", path="a", size=9), event(4, "FileStarted", path="b"))
    add(event(100, "FileFailed", path="b"), event(200, "FileStarted", worker=3, path="y"))
    out = sinks.drain(stateful.worker_state(stream, stall_after_s=60, delay="1 second"))
    rows = {(r.kind, r.worker, r.path, r.duration_us) for r in out.collect()}
    assert ("finished", 1, "a", 3_000_000) in rows and ("finished", 1, "b", 96_000_000) in rows
    assert ("in_flight", 1, "b", None) in rows and ("idle", 1, "b", None) in rows and ("in_flight", 3, "y", None) in rows
    assert ("stalled", 2, "x", 60_000_000) in rows
    assert not [r for r in rows if r[0] == "stalled" and r[1] == 3]


def test_batches_by_idle_count_and_size(spark, feed):
    schema = "ts timestamp, rel_path string, file_type string, size bigint"
    add, stream = feed(schema)
    add(*[(at(0.001 * i), f"a{i}", "regular", 10) for i in range(3)])                       # idle closes this one
    add(*[(at(1 + 0.001 * i), f"b{i}", "regular", 10) for i in range(5)])                   # 4 by count, 1 left
    add((at(2), "big", "regular", 1000), (at(2.001), "c0", "regular", 60), (at(2.002), "c1", "regular", 60))
    add((at(60), "z", "dir", 0))
    out = sinks.drain(stateful.stream_batches(stream, BatchConfig(max_bytes=100, size_limit=100, max_count=4), lanes=1)).collect()
    batches = {}
    for r in out:
        if r.kind == "file" and r.batch_no is not None:
            batches.setdefault(r.batch_no, []).append(r.rel_path)
    assert batches == {0: ["a0", "a1", "a2"], 1: ["b0", "b1", "b2", "b3"], 2: ["b4"], 3: ["c0"]}
    assert {r.rel_path for r in out if r.kind == "file" and r.batch_no is None} == {"big", "c1", "z"}
    assert {(r.batch_no, r.files) for r in out if r.kind == "batch"} == {(0, 3), (1, 4), (2, 1), (3, 1)}


TASKS = "ts timestamp, rel_path string, file_type string, size bigint"


def test_late_tasks_are_batched_too(spark, feed):
    add, stream = feed(TASKS)
    for k, s in enumerate((0, 10, 11, 3, 12)):
        add((at(s), f"f{k}", "regular", 10))
    out = sinks.drain(stateful.stream_batches(stream, lanes=1)).collect()
    assert sorted(r.rel_path for r in out if r.kind == "file") == [f"f{k}" for k in range(5)]
    sessions = sinks.drain(live.session_batches(stream.withColumn("run_id", stream.file_type), "2 seconds"), "complete", name="sessions").collect()
    assert sum(r.files for r in sessions) == 5


def test_order_holds_over_arrow_batches(spark, feed):
    add, stream = feed(TASKS)
    add(*[(at(i), f"f{i:03d}", "regular", 1) for i in reversed(range(200))])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = sinks.drain(stateful.stream_batches(stream, BatchConfig(max_count=50), idle_ms=5000, lanes=1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.rel_path: r.batch_no for r in out if r.kind == "file"} == {f"f{i:03d}": i // 50 for i in range(200)}


def test_pieces_hold_little_of_a_large_key():
    """A key with far more rows than a piece is merged from runs that lie in the state store."""
    import pickle
    import random

    import pandas as pd

    class Store(dict):
        most = 0

        def updateValue(self, k, v):
            self[k] = v
            assert len(pickle.loads(v[0])) <= stateful.PIECE

        def getValue(self, k):
            return self[k]

        def removeKey(self, k):
            del self[k]

    rows = [(k // 3, f"p{k:06d}", None if k % 5 else "x") for k in range(20_000)]
    mixed = random.Random(1).sample(rows, len(rows))
    frames = [pd.DataFrame(mixed[k:k + 3000], columns=["us", "path", "type"]) for k in range(0, len(mixed), 3000)]
    store, got, largest = Store(), [], 0
    for piece in stateful._pieces(store, iter(frames), ["us", "path", "type"], ["us", "path"]):
        largest = max(largest, len(piece))
        got += [tuple(r)[:2] for r in piece.itertuples(index=False)]
    assert got == [r[:2] for r in rows] and largest <= stateful.PIECE and not store
    # One frame needs no store; none gives nothing.
    alone = pd.concat(stateful._pieces(None, iter(frames[:1]), ["us", "path", "type"], ["us", "path"]))
    assert alone["path"].tolist() == sorted(frames[0]["path"])
    assert not list(stateful._pieces(None, iter([]), ["us"], ["us"]))


def test_worker_state_over_many_pieces(spark, feed, monkeypatch):
    monkeypatch.setattr(stateful, "PIECE", 5)
    add, stream = feed(TRANSFER_EVENTS)
    events_ = [event(2 * k, "FileStarted", path=f"f{k}") for k in range(60)] + [event(2 * k + 1, "FileCompleted", path=f"f{k}") for k in range(60)]
    add(*events_[::-1])
    add(event(200, "FileStarted", path="z"), event(119, "FileStarted", path="late"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = sinks.drain(stateful.worker_state(stream, delay="1 hour")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.path, r.duration_us) for r in out if r.kind == "finished") == sorted((f"f{k}", 1_000_000) for k in range(60))
    assert {(r.kind, r.path) for r in out if r.kind in ("idle", "in_flight")} == {("idle", "f59"), ("in_flight", "z")}


def test_incremental_plan_keeps_the_newest_row(spark, feed, manifest, tmp_path):
    from driftline.schemas import MANIFEST
    add, stream = feed(MANIFEST)
    dst = manifest("same", {"rel_path": "old", "size": 99}, "dst_only")

    def rows(*entries):
        return [tuple(r) for r in manifest(*entries).collect()]
    add(*rows("same", "new", "x.log"))
    add(*rows({"rel_path": "old", "size": 5}, {"rel_path": "new", "size": 77}))
    out = str(tmp_path / "plan")
    planning.incremental_plan(stream, dst, out, filter_chain(["- *.log"])).awaitTermination()
    got = {r.rel_path: (r.action, r.size) for r in planning.read_plan(spark, out).collect()}
    assert got == {"same": ("skip", 10), "new": ("copy_new", 77), "x.log": ("excluded", 10), "old": ("copy_changed", 5)}


def test_incremental_plan_reads_touched_buckets_only(spark, feed, manifest, tmp_path):
    import glob

    from driftline.schemas import MANIFEST
    from driftline.sources.tables import HASH_BUCKET, hash_bucket, read_hashed, write_hashed

    add, stream = feed(MANIFEST)
    where, n = str(tmp_path / "dst"), 16
    assert read_hashed(spark, where).count() == 0
    write_hashed(manifest(*[f"f{k}" for k in range(200)]), where, n)
    d = read_hashed(spark, where)
    assert d.count() == 200 and d.groupBy("rel_path").count().filter("count > 1").count() == 0
    paths = ["f3", "f77", "new"]
    add(*[tuple(r) for r in manifest(*paths).collect()])
    wanted = {r[0] for r in manifest(*paths).select(hash_bucket(F.col("rel_path"), n)).collect()}
    others = [p for p in glob.glob(f"{where}/version-*/{HASH_BUCKET}=*/*.parquet") if int(p.split(f"{HASH_BUCKET}=")[1].split("/")[0]) not in wanted]
    assert len(others) >= n - len(wanted) - 1
    for p in others:                       # whoever opens one of these fails
        with open(p, "wb") as out:
            out.write(b"no parquet")
    out = str(tmp_path / "plan")
    planning.incremental_plan(stream, d, out, buckets=n).awaitTermination()
    assert {r.rel_path: r.action for r in planning.read_plan(spark, out).collect()} == {"f3": "skip", "f77": "skip", "new": "copy_new"}


def test_folding_micro_batches(spark, feed, manifest, tmp_path):
    import os

    from driftline.schemas import MANIFEST

    add, stream = feed(MANIFEST)
    out = str(tmp_path / "plan")

    def arrive(*entries):
        add(*[tuple(r) for r in manifest(*entries).collect()])
        planning.incremental_plan(stream, manifest("same"), out).awaitTermination()

    def plan():
        return {r.rel_path: (r.action, r.size) for r in planning.read_plan(spark, out).collect()}

    arrive("same", {"rel_path": "a", "size": 1})
    arrive({"rel_path": "a", "size": 2}, "b")
    want = plan()
    assert want == {"same": ("skip", 10), "a": ("copy_new", 2), "b": ("copy_new", 10)}
    planning.compact_plan(spark, out)
    assert plan() == want
    # What comes later wins, whether folded or not; folding again changes nothing.
    arrive({"rel_path": "b", "size": 3})
    assert plan() == {**want, "b": ("copy_new", 3)}
    # A folder that is not finished is left for the next time.
    os.makedirs(f"{out}/rows/batch=99")
    assert sinks.finished_batches(spark, out) == [0, 1, 2]
    for _ in range(2):
        planning.compact_plan(spark, out)
        assert plan() == {**want, "b": ("copy_new", 3)}
    assert sinks.finished_batches(spark, out) == [2]              # the others are folded and gone
    arrive("c")
    assert plan()["c"] == ("copy_new", 10) and len(plan()) == 4


def test_fan_out(spark, feed, tmp_path):
    add, stream = feed("level string, n int")
    add(("DEBUG", 1), ("INFO", 2))
    add(("ERROR", 3))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.fan_out(stream, {a: None, b: sinks.at_least("INFO")}, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(a).collect()) == [1, 2, 3]
    assert sorted(r.n for r in spark.read.parquet(b).collect()) == [2, 3]


def test_late_events_are_dropped_and_windows_close(spark, feed):
    add, stream = feed(TRANSFER_EVENTS)
    add(event(0, "FileCompleted", size=5), event(0.5, "FileCompleted", size=6))
    add(event(30, "FileCompleted", size=7))
    add(event(30.5, "FileCompleted", size=1))          # late rows are judged by the watermark of one batch before
    add(event(1, "FileCompleted", size=100))
    add(event(60, "FileCompleted", size=8))
    out = sinks.drain(live.stream_ticks(stream, "1 second", "5 seconds"))
    assert {r.start.replace(tzinfo=None).second: (r.bytes, r.files) for r in out.collect()} == {0: (11, 2), 30: (8, 2)}
    fails = sinks.drain(live.live_failures(stream))
    assert fails.count() == 0
