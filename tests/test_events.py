import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import events, progress
from driftline.schemas import TRANSFER_EVENTS

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def make(spark):
    def build(*rows):
        """(second, type, worker, path, size) with optional dict of further fields."""
        out = []
        for i, (sec, kind, worker, path, size, *more) in enumerate(rows):
            row = {"run_id": "r", "ts": T0 + dt.timedelta(seconds=sec), "seq": i, "type": kind, "path": path, "size": size,
                   "worker": worker, **(more[0] if more else {})}
            out.append(tuple(row.get(f.name) for f in TRANSFER_EVENTS))
        return spark.createDataFrame(out, TRANSFER_EVENTS)
    return build


@pytest.fixture(scope="module")
def run(make):
    return make(
        (0, "ScanStarted", None, None, None), (0, "ScanComplete", None, None, None, {"total": 4, "total_size": 1000}),
        (1, "FileStarted", 1, "a", 100), (1, "FileStarted", 2, "b", 200), (2, "FileProgress", 2, "b", 50),
        (3, "FileCompleted", 1, "a", 100), (3, "FileSkipped", 1, "s", 300), (4, "FileStarted", 1, "c", 400),
        (5, "FileFailed", 1, "c", 400, {"error": "disk"}), (6, "DirCreated", 3, "d", None), (7, "HardlinkCreated", 2, "h", None),
        (8, "FileFailed", 3, "e", 1), (9, "VerifyOK", None, "a", None), (9, "VerifyFailed", None, "b", None))


def test_snapshot(run):
    s = events.snapshot(run).first().asDict()
    assert s == {"files_scanned": 3, "files_copied": 1, "files_failed": 2, "files_skipped": 1, "bytes_copied": 400, "dirs_created": 1,
                 "hardlinks_created": 1, "bytes_total": 1000, "files_total": 4, "files_verified": 1, "files_verify_failed": 1,
                 "elapsed_us": 9_000_000}
    r = events.summary(run).first()
    assert (r.files, r.bytes, r.verified, r.errors, r.clean) == (1, 400, 1, 3, False) and r.avg_bytes_per_s == pytest.approx(400 / 9)


def test_errors(run, make):
    e = events.error_summary(run).first()
    assert (e.first_error, e.more, e.message) == ("disk", 1, "disk (and 1 more errors)")
    last = events.recent_errors(run, 2).collect()
    assert [(r.path, r.error) for r in last] == [("b", "CHECKSUM MISMATCH"), ("e", "error")]
    assert events.run_outcome(run).first().code == 1
    assert events.run_outcome(make((0, "FileFailed", 1, "x", 1))).first().code == 2
    assert events.run_outcome(make((0, "FileCompleted", 1, "x", 1))).first().code == 0


def test_only_verification_fails(make):
    ev = make((0, "FileCompleted", 1, "x", 1), (1, "VerifyFailed", 1, "x", 1), (2, "VerifyFailed", 1, "y", 1))
    e = events.error_summary(ev).first()
    assert (e.message, e.more) == ("2 files failed verification", 0)
    h = events.report_header(ev).first()
    assert (h.files, h.bytes, h.errors, h.duration_s, h.bytes_per_s) == (1, 1, 2, 2.0, 0.5)


def test_outcomes(make):
    ev = make((0, "FileStarted", 1, "a", 5), (1, "FileFailed", 1, "a", 5), (2, "FileStarted", 1, "a", 5), (3, "FileCompleted", 1, "a", 5),
              (3, "FileSkipped", 1, "b", 7), (4, "FileFailed", 1, "c", 9, {"error": "no space"}), (5, "VerifyFailed", 1, "a", None))
    got = {r.path: (r.outcome, r.size, r.error) for r in events.file_outcomes(ev).collect()}
    assert got == {"a": ("done", 5, None), "b": ("skipped", 7, None), "c": ("failed", 9, "no space")}


def test_in_flight(run):
    def at(sec):
        rows = events.in_flight(run, F.lit(T0 + dt.timedelta(seconds=sec))).collect()
        return {r.worker: (r.path, r.progress, r.so_far_us) for r in rows}
    assert at(0) == {}
    assert at(1.5) == {1: ("a", None, 500_000), 2: ("b", None, 500_000)}
    assert at(2.5) == {1: ("a", None, 1_500_000), 2: ("b", 50, 1_500_000)}
    assert at(4) == {1: ("c", None, 0), 2: ("b", 50, 3_000_000)}
    assert at(7) == {}          # a hardlink made by worker 2 ends what it did


def test_durations_and_busy(run):
    d = {r.path: (r.duration_us, r.bytes_per_s) for r in events.file_durations(run).collect()}
    assert d == {"a": (2_000_000, 50.0), "c": (1_000_000, 400.0)}
    busy = [r.busy for r in events.busy_workers(run).orderBy("ts", "seq").collect()]
    assert busy == [1, 2, 1, 2, 1, 1, 0, 0]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_busy_workers_against_a_set(make, parts):
    rng = random.Random(parts)
    kinds = ["FileStarted", "FileCompleted", "FileFailed", "FileSkipped", "DirCreated", "HardlinkCreated", "VerifyOK"]
    rows = [(rng.randint(0, 300), rng.choice(kinds), rng.choice([0, 0, 0, 1, 2]), f"p{i}", 1) for i in range(500)]
    busy, want = set(), []
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        if r[1] == "FileStarted":
            busy.add(r[2])
        elif r[1] in events.CLEARS:
            busy.discard(r[2])
        else:
            continue
        want.append((i, len(busy)))
    got = [(r.seq, r.busy) for r in events.busy_workers(make(*rows), parts).orderBy("ts", "seq").collect()]
    assert got == want


def done(*sizes):
    return [(i, "FileCompleted", 0, f"f{i}", n) for i, n in enumerate(sizes)]


def series(df, col):
    return [r[col] for r in df.orderBy("idx").collect()]


def test_rolling(make):
    t = progress.ticks(make(*done(*[1000] * 5)))
    assert series(progress.rolling(t, 5), "avg_bytes")[-1] == 1000 and series(progress.rolling(t, 5), "avg_files")[-1] == 1
    two = progress.ticks(make(*done(500, 500)))
    assert series(progress.rolling(two, 10), "avg_bytes") == [500, 500]
    t = progress.ticks(make(*done(100, 200, 300, 400, 500)))
    assert series(progress.last_samples(t, 5), "samples")[-1] == [100, 200, 300, 400, 500]
    long = progress.last_samples(progress.ticks(make(*done(*range(1, 71)))), 60)
    assert series(long, "samples")[-1] == list(range(11, 71))
    # More samples than a run has, or than a dashboard shows, are no error.
    more = progress.last_samples(progress.ticks(make(*done(*range(1, 71)))), 500)
    assert series(more, "samples")[-1] == list(range(1, 71))


def test_idle_intervals_are_zero(make):
    t = progress.ticks(make((0, "FileCompleted", 0, "a", 10), (3, "FileSkipped", 0, "b", 20), (3, "FileStarted", 0, "c", 1)))
    assert series(t, "bytes") == [10, 0, 0, 20] and series(t, "files") == [1, 0, 0, 0]


def test_eta(make):
    t = progress.ticks(make(*done(*[1000] * 5)))
    assert series(progress.eta(t, 10000), "eta_s")[-1] == 5
    assert series(progress.eta(t, 5000), "eta_s")[-1] == 0
    idle = progress.ticks(make((0, "ScanStarted", None, None, None)))
    assert series(progress.eta(idle, 10000), "eta_s") == [0]
    p = progress.progress(t, 10000)
    assert series(p, "fraction") == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.5])
    assert series(progress.progress(t, 0), "fraction") == [0.0] * 5


def test_rate_mode(make):
    per_second = [50, 300, 250, 150, 120, 60, 60, 150, 260, 260]
    ev = make(*[(s, "FileCompleted", 0, f"{s}-{i}", 1) for s, n in enumerate(per_second) for i in range(n)])
    mode, on, prev = [], False, None
    for n in per_second:
        fps = n if prev is None else (n + prev) / 2
        on = True if fps > 200 else False if fps < 100 else on
        mode.append(on)
        prev = n
    assert series(progress.rate_mode(progress.ticks(ev)), "high") == mode


def test_blocks_of_ticks_do_not_show(make, monkeypatch):
    """Small blocks give the same windows and sums as one large block."""
    rng = random.Random(1)
    ev = make(*[(rng.randint(0, 400), "FileCompleted", 0, f"{i}", rng.randint(1, 99)) for i in range(300)])

    def all_series():
        t = progress.ticks(ev)
        p = progress.eta(t, 10**6)
        return [series(t, "bytes"), series(p, "bytes_copied"), series(p, "avg_bytes"), series(progress.rate_mode(t, 1.0, 0.5), "high")]
    want = all_series()
    monkeypatch.setattr(progress, "BLOCK_TICKS", 16)
    assert all_series() == want
    t = progress.ticks(ev)
    from driftline.operators.ordered import trailing_frames
    small = trailing_frames(t, ["run_id"], "idx", 10, {"a": lambda w: F.avg("bytes").over(w)}, block_rows=12)
    assert series(small, "a") == want[2]
