"""Byte-level BPE by ranks through a global shuffle of distinct words.

Texts are split at white space into words, which are runs of whole matches of the tokenizer's
pattern. A chunk of documents gives each of its distinct words once, and the word numbers of all
positions. Words are dealt over the corpus by their hash; a bucket of words reads those of all chunks
one after another and encodes every distinct word once, each match of the pattern separately. Their
ids, one after another with their places, meet the token-byte table, sorted by id, which gives what
they decode to. Ids and decoded bytes go back to the chunks that hold the word, where positions put
documents together again.

Words and positions travel packed: a row per word of a chunk took twice the disk (README). A chunk
sends a word once however often it has it, so no word is hot. A task holds one chunk, or the distinct
words of one bucket; there are four buckets to a shuffle partition, so more partitions make them smaller.

Defined cases: null and empty texts have no ids and decode to nothing; strings of special tokens
are plain text; repeated rows and ids are encoded row by row; a null doc_id stays null; a document is
never split, so a very long text is a chunk of its own; an empty table gives an empty result. Only
`doc_id` and `text` are read, other columns do not matter.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.bpe import read_varints, varints
from driftline.llm.common import bounded_batches, texts_of
from driftline.llm.word_ids import SPACED
from driftline.session import cut

# Characters of text after which a chunk ends with the document at hand.
CHUNK = 24_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a rank file: base64 and number per line."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of words by the library, and the bytes of ids by the token-byte table; opened once per task."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.tok = path, pattern, None

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "tok": None}

    def open(self):
        import tiktoken

        ranks = read_ranks(self.path)
        self.tok = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        table = sorted((i, piece) for piece, i in ranks.items())
        self.ids = np.array([i for i, _ in table], np.int64)
        self.pieces = pa.array([piece for _, piece in table], pa.binary())

    def encode(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Per word its ids as little-endian unsigned 32-bit numbers, and the bytes they decode to."""
        if self.tok is None:
            self.open()
        one = self.tok.encode_ordinary
        ids = [one(w) for w in words]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        met = self.pieces.take(pa.array(np.searchsorted(self.ids, flat)))
        ends = np.append(0, np.cumsum(np.asarray(pc.binary_length(met)), dtype=np.int64))
        places = np.cumsum(sizes)
        decoded = _cut_up(np.diff(ends[places], prepend=0), b"".join(met.to_pylist()), 1)
        return list(zip(_cut_up(sizes, flat.astype("<u4").tobytes(), 4), decoded))


def _cut_up(sizes: np.ndarray, data, width: int) -> list[bytes]:
    """The pieces of `data` that have these sizes, one after another."""
    ends = (np.cumsum(sizes, dtype=np.int64) * width).tolist()
    raw = bytes(data)
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _flat(parts) -> bytes:
    """Arrays in one buffer: how many, the size of each in bytes, then all of them."""
    raw = [p.tobytes() for p in parts]
    return np.array([len(raw), *map(len, raw)], "<i8").tobytes() + b"".join(raw)


def _packed(*lists) -> bytes:
    """Lists of byte strings: the sizes and the bytes of each list."""
    return _flat([x for own in lists for x in (np.array([len(w) for w in own], "<u4"), np.frombuffer(b"".join(own), np.uint8))])


def _unpacked(sizes, data) -> list[bytes]:
    return _cut_up(np.frombuffer(sizes, "<u4"), data, 1)


def _parts(data: bytes) -> list[memoryview]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    cuts = np.cumsum([8 * (n + 1), *np.frombuffer(data, "<i8", n, 8).tolist()]).tolist()
    return [memoryview(data)[a:b] for a, b in zip(cuts, cuts[1:])]


PARTS = "chunk bigint, bucket int, data binary, docs binary"


def _rows(rows):
    chunk, bucket, data, docs = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip((chunk, bucket, data, docs), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
        names=["chunk", "bucket", "data", "docs"])


def _chunks(buckets: int, positions: bool):
    """Per chunk a row per bucket with its distinct words; or, with `positions`, one row with the
    word numbers of all positions and, in `docs`, the bucket of each word and the id, null flag and
    number of words of each document. Words are numbered by falling frequency, ties by first
    appearance, and keep this order in their buckets. A chunk is named by its place in the input and
    a hash of its rows, so both readings give it the same name or fail to meet."""
    def finish(name, number, codes, docs):
        import xxhash
        import zstandard

        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        words = list(number)
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        words = [words[k].encode("utf-8", "surrogatepass") for k in order.tolist()]
        place = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], np.int64)
        chunk, pack = name.intdigest() - (1 << 63), zstandard.ZstdCompressor(level=3).compress
        if positions:
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            about = _flat([place.astype("<u4"), np.array(docs, "<i8").reshape(-1, 3)])
            return _rows([(chunk, -1, pack(varints(rank[flat])), pack(about))])
        by = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[by], np.arange(buckets + 1)).tolist()
        by, rows = by.tolist(), []
        for k in range(buckets):
            if bounds[k] < bounds[k + 1]:
                own = [words[i] for i in by[bounds[k]:bounds[k + 1]]]
                rows.append((chunk, k, pack(_packed(own)), None))
        return _rows(rows)

    def run(batches):
        import xxhash

        parts = 0

        def fresh():
            return defaultdict(itertools.count().__next__), [], [], xxhash.xxh3_64(f"{parts} ".encode())

        number, codes, docs, name = fresh()
        size = 0
        for b in batches:
            for at, i, text in zip(b.column("at").to_pylist(), b.column("doc_id").to_pylist(), texts_of(b)):
                own = SPACED.findall(text)
                codes.append(np.array([number[w] for w in own], np.int64))
                docs.append((0 if i is None else i, i is None, len(own)))
                name.update(f"{at} {i} {len(text)} ".encode() + text.encode("utf-8", "surrogatepass"))
                size += len(text)
                if size >= CHUNK:
                    yield finish(name, number, codes, docs)
                    parts, size = parts + 1, 0
                    number, codes, docs, name = fresh()
        if docs:
            yield finish(name, number, codes, docs)

    return run


def _encode_buckets(encoder: Encoder):
    """Rows sorted by bucket: words to their ids and decoded bytes. Chunks of a bucket come one after
    another; what is known from earlier ones is not encoded again."""
    def run(batches):
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        at, known = None, {}
        for b in batches:
            out = []
            for chunk, bucket, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "bucket", "data"))):
                if bucket != at:
                    at, known = bucket, {}
                words = _unpacked(*_parts(unpack(data)))
                new = [w for w in words if w not in known]
                known.update(zip(new, encoder.encode([w.decode("utf-8", "surrogatepass") for w in new])))
                ids, pieces = zip(*[known[w] for w in words])
                out.append((chunk, bucket, pack(_packed(ids, pieces)), None))
            yield _rows(out)

    return run


OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _assemble(rows: pa.Table) -> pa.Table:
    """All rows of a chunk to a row per document."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    rows = rows.sort_by("bucket")
    bucket, data = rows.column("bucket").to_pylist(), rows.column("data").to_pylist()
    if bucket.count(-1) != 1:
        raise ValueError("documents were read differently the second time; write them first (repeatable=False)")
    codes = read_varints(np.frombuffer(unpack(data[0]), np.uint8))
    place, docs = _parts(unpack(rows.column("docs")[0].as_py()))
    place, docs = np.frombuffer(place, "<u4"), np.frombuffer(docs, "<i8").reshape(-1, 3)
    ids, pieces, count = [], [], []
    for part in data[1:]:
        n_ids, flat, n_bytes, raw = _parts(unpack(part))
        ids += _unpacked(n_ids, flat)
        pieces += _unpacked(n_bytes, raw)
        count.append(np.frombuffer(n_ids, "<u4") // 4)
    if len(ids) != len(place):
        raise ValueError(f"{len(place) - len(ids)} words of a chunk are missing")
    at = np.empty(len(place), np.int64)
    at[np.argsort(place, kind="stable")] = np.arange(len(place))
    spots = at[codes] if len(codes) else codes
    tokens = np.concatenate(count).astype(np.int64)[spots] if len(codes) else spots
    out, start = [], 0
    for doc_id, null, n in docs.tolist():
        own = spots[start:start + n].tolist()
        out.append((None if null else doc_id, int(tokens[start:start + n].sum()),
                    hashlib.sha256(b"".join(map(ids.__getitem__, own))).hexdigest(),
                    hashlib.sha256(b"".join(map(pieces.__getitem__, own))).hexdigest()))
        start += n
    cols = list(zip(*out))
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), cols,
                                                          (pa.int64(), pa.int64(), pa.string(), pa.string()))})


def encode_and_decode(docs: DataFrame, path: str, pattern: str, repeatable=True) -> DataFrame:
    """Per row: doc_id, number of ids, SHA-256 of the ids as little-endian unsigned 32-bit integers,
    and of the bytes they decode to.

    `docs` is read twice, for words and for positions, and must give the same rows in the same
    partitions both times, as a scan does; if it does not, the job fails. With `repeatable=False` its
    texts are written first."""
    spark = docs.sparkSession
    bounded_batches(spark, rows=2000)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The partition's number tells equal chunks apart.
    source = (source if repeatable else cut(source)).withColumn("at", F.spark_partition_id())
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = source.mapInArrow(_chunks(buckets, False), PARTS).repartition("bucket").sortWithinPartitions("bucket")
    back = words.mapInArrow(_encode_buckets(Encoder(path, pattern)), PARTS)
    positions = source.mapInArrow(_chunks(buckets, True), PARTS)
    return back.unionAll(positions).groupBy("chunk").applyInArrow(_assemble, OUT)
