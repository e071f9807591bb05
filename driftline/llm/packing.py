"""Order-preserving packing of token streams by dynamic programming.

Documents are read in order as one stream of ids per task. A sequence is a window of the stream of
at most `length` ids. The cuts between windows are chosen to minimise padding plus a penalty per cut
by where it falls: none at a document's end, little at a sentence's end, more inside a sentence.
With v[j] = cost[j] + j the best way to end a window at position j is

    cost[j] = penalty[j] + length - j + min(v[i] for j - length <= i < j),

a sliding minimum kept in a monotone queue. A window whose length is a power of two needs no
padding, so the rest of a task's stream is cut into such lengths.

Defined cases: a null or empty text is a document of the end id alone; a document may be longer
than any window and is then continued in the next one; repeated rows are packed once each; rows
with a null id come first in their task; an empty table gives an empty result. Only `doc_id` and
`text` are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches, texts_of
from driftline.llm.word_ids import WordIds, bare_words, open_tokenizer

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, padding bigint")


@dataclass(frozen=True)
class PackConfig:
    """`stride` is how often a cut inside a sentence is considered, in ids; `block` is how many ids
    are planned at a time (the last windows of a plan are planned again with what follows)."""

    length: int = 2048
    end_id: int = 1
    sentence_penalty: int = 4
    inner_penalty: int = 24
    stride: int = 32
    block: int = 1 << 18


def padding(size: int, length: int) -> int:
    """Ids added to a sequence: none where its size is a power of two."""
    return 0 if size & (size - 1) == 0 else length - size


def plan_cuts(positions, penalties, length: int, size: int, tail_penalty=None) -> list[int]:
    """The positions of the cheapest cuts of a stream of `size` ids. `positions` rise and leave no
    gap above `length`. With `tail_penalty` the rest after the last cut is cut into power-of-two
    lengths, each of which costs that much; else the last position is a cut."""
    at, queue = [0, *positions], deque([0])
    value, back = [0] * len(at), [-1] * len(at)
    push, pop = queue.append, queue.pop
    # The best window begins at the front of the queue, which changes seldom.
    i, begin, least = 0, 0, 0
    for j, (p, extra) in enumerate(zip(positions, penalties), start=1):
        if begin < p - length:
            while at[queue[0]] < p - length:
                queue.popleft()
            i = queue[0]
            begin, least = at[i], value[i]
        value[j] = v = least + length + extra
        back[j] = i
        while queue and value[queue[-1]] >= v:
            pop()
        if not queue:
            i, begin, least = j, p, v
        push(j)
    j = len(at) - 1
    if tail_penalty is not None:
        near = [i for i in range(len(at)) if size - at[i] < length]
        j = min(near, key=lambda i: value[i] - at[i] + tail_penalty * bin(size - at[i]).count("1"))
    cuts = []
    while j > 0:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def power_lengths(size: int, length: int) -> list[int]:
    """The rest of a stream as power-of-two lengths, the longest first."""
    out, step = [], length
    while size:
        while step > size:
            step //= 2
        out.append(step)
        size -= step
    return out


class _Stream:
    """The ids of a task's documents that are not yet cut, and where documents begin."""

    def __init__(self, cfg: PackConfig, ends_sentence, first_id: int):
        self.cfg, self.ends_sentence = cfg, ends_sentence
        self.ids = np.zeros(0, "<u4")
        self.docs = deque()  # [doc_id, document's ids, ids of it already cut], in order
        self.pending, self.size = [], 0
        self.sequence = first_id

    def add(self, doc_id, ids):
        self.pending.append(ids)
        self.size += len(ids)
        self.docs.append([doc_id, len(ids), 0])

    def windows(self, last: bool):
        """Lengths to cut from the front; without `last`, a few windows stay for later."""
        cfg = self.cfg
        self.ids = np.concatenate([self.ids, *self.pending]) if self.pending else self.ids
        self.pending = []
        n = len(self.ids)
        if not n:
            return []
        cost = np.full(n + 1, -1, "<i4")
        cost[cfg.stride::cfg.stride] = cfg.inner_penalty
        cost[np.flatnonzero(self.ends_sentence[self.ids]) + 1] = cfg.sentence_penalty
        cost[np.cumsum([size - cut for _, size, cut in self.docs])] = 0
        where = np.flatnonzero(cost >= 0)
        cuts = plan_cuts(where.tolist(), cost[where].tolist(), cfg.length, n, cfg.inner_penalty if last else None)
        sizes = np.diff([0, *cuts]).tolist()
        return sizes + power_lengths(n - sum(sizes), cfg.length) if last else sizes[:-8]

    def cut(self, last: bool):
        rows = []
        at = 0
        for size in self.windows(last):
            offset, left = 0, size
            pad = padding(size, self.cfg.length)
            while left:
                doc = self.docs[0]
                take = min(left, doc[1] - doc[2])
                crc = zlib.crc32(self.ids[at:at + take].tobytes())
                rows.append((doc[0], doc[2], take, crc, doc[1], self.sequence, offset, pad))
                doc[2] += take
                if doc[2] == doc[1]:
                    self.docs.popleft()
                at += take
                offset += take
                left -= take
            self.sequence += 1
        self.ids = self.ids[at:]
        self.size -= at
        return rows


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """For every id, whether its piece ends a sentence."""
    vocab = open_tokenizer(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        out[i] = piece.removesuffix("</w>").endswith((".", "!", "?", ";", ":"))
    return out


def pack(docs: DataFrame, tokenizer_path: str, cfg=PackConfig()) -> DataFrame:
    """One row per piece of a document in a sequence.

    Every task packs its own rows in the order of their ids, so texts are not moved, and an
    executor that takes over a task makes the same sequences. `sequence_id` counts from the task's
    number times 2^33. A task holds about `block` ids and one batch of texts at a time.
    """
    bounded_batches(docs.sparkSession, rows=500)
    ids_of = WordIds(tokenizer_path, bare_words, spaced=False)
    names = SCHEMA.split(", ")
    types = pa.schema([(n.split()[0], pa.int64()) for n in names])

    def table(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=types)

    def run(batches):
        from pyspark import TaskContext

        stream = _Stream(cfg, sentence_ends(tokenizer_path), TaskContext.get().partitionId() << 33)
        end = np.array([cfg.end_id], "<u4").tobytes()
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), ids_of.of_texts(texts_of(b))):
                stream.add(doc_id, np.frombuffer(ids + end, "<u4"))
                if stream.size >= cfg.block:
                    rows = stream.cut(last=False)
                    if rows:
                        yield table(rows)
        rows = stream.cut(last=True)
        if rows:
            yield table(rows)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SCHEMA)
