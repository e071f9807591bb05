"""Arbitrary state per key: workers and small-file batches."""

import heapq
import pickle
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from driftline.operators.events import CLEARS
from driftline.operators.packing import BatchConfig

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State beyond executor memory, and what `transformWithState` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# Rows of a key that are held and folded at once.
PIECE = 1024


def _run_state(handle):
    """Sorted runs of the rows of a key, while a micro-batch is folded: (run, piece) to its rows."""
    return handle.getMapState("runs", "run int, piece int", "rows binary")


def _pieces(runs, frames, columns, order):
    """The rows of a key in a micro-batch, in order, as frames of at most PIECE rows.

    They come in several frames, in any order. Each frame is sorted and, unless it is the only one,
    put aside in the state store in pieces; the runs are then merged with one piece of each in memory."""
    order = [columns.index(c) for c in order]

    def key(row):
        # Missing values last, as pandas sorts them.
        return [(v is None or v != v, 0 if v is None or v != v else v) for v in (row[k] for k in order)]

    def cut_up(rows):
        for k in range(0, len(rows), PIECE):
            yield rows[k:k + PIECE]

    def put_aside(run, rows):
        for k, part in enumerate(cut_up(rows)):
            runs.updateValue((run, k), (pickle.dumps(part),))
        return -(-len(rows) // PIECE)

    def read(run, n):
        for k in range(n):
            yield from pickle.loads(runs.getValue((run, k))[0])
            runs.removeKey((run, k))

    def tuples(pdf):
        return sorted(pdf[columns].itertuples(index=False, name=None), key=key)

    frames = iter(frames)
    first, second = next(frames, None), next(frames, None)
    if second is None:
        merged = iter(()) if first is None else iter(tuples(first))
    else:
        sizes = [put_aside(k, tuples(pdf)) for k, pdf in enumerate(chain([first, second], frames))]
        merged = heapq.merge(*[read(k, n) for k, n in enumerate(sizes)], key=key)
    part = []
    for row in merged:
        part.append(row)
        if len(part) == PIECE:
            yield pd.DataFrame(part, columns=columns)
            part = []
    if part:
        yield pd.DataFrame(part, columns=columns)


class _Worker(StatefulProcessor):
    """What one worker does now: its latest event is all the state there is.

    The events of a micro-batch are folded in order, piece by piece, on top of the latest event, so memory
    grows neither with the worker's history nor with its share of a micro-batch. An event older than
    the latest one never replaces it."""

    columns = ("run_id", "worker", "kind", "path", "size", "at_us", "duration_us")
    schema = "run_id string, worker int, kind string, path string, size bigint, at_us bigint, duration_us bigint"

    def __init__(self, stall_us):
        self.stall_us = stall_us

    def init(self, handle):
        self.handle = handle
        self.latest = handle.getValueState("latest", "us bigint, seq bigint, type string, path string, size bigint")
        self.runs = _run_state(handle)

    def handleInputRows(self, key, rows, timerValues):
        cols = ["us", "seq", "type", "path", "size"]
        known, before = self.latest.get(), None
        frames = chain([pd.DataFrame([known], columns=cols)], rows) if known is not None else rows
        for ev in _pieces(self.runs, frames, cols, ["us", "seq"]):
            prev = ev.shift(1)
            if before is not None:
                prev.iloc[0] = before
            done = ev["type"].isin(["FileCompleted", "FileFailed"]) & (prev["type"] == "FileStarted")
            if known is not None:
                done &= ~((ev["us"] == known[0]) & (ev["seq"] == known[1]))
            end = ev[done]
            yield self._frame(key, "finished", end["path"], end["size"], end["us"], end["us"] - prev["us"][done].astype("int64"))
            before = ev.iloc[-1].tolist()
        last = tuple(v.item() if hasattr(v, "item") else v for v in before)
        self.latest.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        busy = last[2] == "FileStarted"
        if busy:
            self.handle.registerTimer((last[0] + self.stall_us) // 1000 + 1)
        yield self._frame(key, "in_flight" if busy else "idle", [last[3]], [last[4]], [last[0]], [None])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        us, _, kind, path, _ = self.latest.get()
        stalled = kind == "FileStarted" and us + self.stall_us < expiredTimerInfo.getExpiryTimeInMs() * 1000
        yield self._frame(key, "stalled", *(([path], [None], [us], [self.stall_us]) if stalled else ([], [], [], [])))

    def _frame(self, key, kind, path, size, at, took):
        pdf = pd.DataFrame({"path": list(path), "size": list(size), "at_us": list(at), "duration_us": list(took)})
        pdf = pdf.assign(run_id=key[0], worker=key[1], kind=kind)[list(self.columns)]
        return pdf.astype({"path": "object", "size": "Int64", "at_us": "Int64", "duration_us": "Int64", "worker": "int32"})

    def close(self):
        pass


def worker_state(ev: DataFrame, stall_after_s=60, delay="10 seconds") -> DataFrame:
    """What each worker does (`in_flight`, `idle`), the files it `finished` with their duration,
    and files that `stalled`: no end seen `stall_after_s` of event time after the start. A stall
    shows when the watermark passes it."""
    use_rocksdb(ev.sparkSession)
    rows = (ev.filter(F.col("type").isin("FileStarted", *CLEARS)).withWatermark("ts", delay)
            .select("run_id", "worker", "ts", F.unix_micros("ts").alias("us"),
                    F.coalesce("seq", F.lit(0)).alias("seq"), "type", "path", F.coalesce("size", F.lit(0)).alias("size")))
    return rows.groupBy("run_id", "worker").transformWithStateInPandas(
        statefulProcessor=_Worker(int(stall_after_s * 1_000_000)), outputStructType=_Worker.schema,
        outputMode="Append", timeMode="EventTime")


class _Batcher(StatefulProcessor):
    """Greedy batching of what arrives, closed by count, by bytes, by a file that may not join,
    by a pause between tasks, or by an idle timer. Only counters are kept; each file gets its batch
    number at once. All tasks of a lane in a micro-batch are put in order first, in pieces, and a task
    that comes later than others of its time joins the open batch: none is left out."""

    schema = "lane int, kind string, batch_no bigint, rel_path string, files int, size bigint"

    def __init__(self, cfg, idle_us, timer):
        self.cfg, self.idle_us, self.timer = cfg, idle_us, timer

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "batch_no bigint, files int, size bigint, last_us bigint")
        self.runs = _run_state(handle)

    def _close(self, lane, out, state):
        no, n, size, last = state
        if n:
            out.append((lane, "batch", no, None, n, size))
            no += 1
        return [no, 0, 0, last]

    def _fold(self, lane, state, piece):
        """The rows that a piece of a lane's tasks gives, and the state behind it."""
        cfg, out = self.cfg, []
        for us, path, kind, size in piece.itertuples(index=False, name=None):
            us, size = int(us), int(size)
            if state[1] and us - state[3] > self.idle_us:
                state = self._close(lane, out, state)
            state[3] = max(state[3], us)
            fits = state[1] == 0 or state[2] + size <= cfg.max_bytes
            if kind == "regular" and 0 <= size <= cfg.size_limit and fits:
                out.append((lane, "file", state[0], path, 1, size))
                state[1], state[2] = state[1] + 1, state[2] + size
                if state[1] >= cfg.max_count or state[2] >= cfg.max_bytes:
                    state = self._close(lane, out, state)
            else:
                state = self._close(lane, out, state)
                out.append((lane, "file", None, path, 1, size))
        return self._frame(out), state

    def handleInputRows(self, key, rows, timerValues):
        state = list(self.open.get() or (0, 0, 0, 0))
        for piece in _pieces(self.runs, rows, ["us", "rel_path", "file_type", "size"], ["us", "rel_path"]):
            out, state = self._fold(int(key[0]), state, piece)
            yield out
        self.open.update(tuple(state))
        for t in list(self.handle.listTimers()) if self.timer else ():
            self.handle.deleteTimer(t)
        if self.timer and state[1]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        state = self._close(int(key[0]), out, list(self.open.get()))
        self.open.update(tuple(state))
        yield self._frame(out)

    def _frame(self, rows):
        pdf = pd.DataFrame(rows, columns=["lane", "kind", "batch_no", "rel_path", "files", "size"])
        return pdf.astype({"batch_no": "Int64", "size": "Int64"})

    def close(self):
        pass


def stream_batches(tasks: DataFrame, cfg=BatchConfig(), idle_ms=50, lanes=8, lane: Column = None, timer=False) -> DataFrame:
    """Batches over a task stream (ts, rel_path, file_type, size): a `file` row per file with its
    batch number (null when it travels alone) and a `batch` row when a batch is closed. Tasks are
    spread over `lanes` by path, or by the integer column `lane`, each with its own open batch.

    There is no watermark: every task comes out once, late or not. A batch is closed by a pause of
    `idle_ms` between the times of its tasks and, with `timer`, when nothing came for that long by
    the clock. Set it for a stream that goes on; a run over what is available would not end."""
    use_rocksdb(tasks.sparkSession)
    lane = F.pmod(F.xxhash64("rel_path"), F.lit(lanes)) if lane is None else lane
    rows = tasks.select(lane.cast("int").alias("lane"), F.unix_micros("ts").alias("us"), "rel_path", "file_type", "size")
    return rows.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=_Batcher(cfg, idle_ms * 1000, timer), outputStructType=_Batcher.schema,
        outputMode="Append", timeMode="ProcessingTime" if timer else "None")
