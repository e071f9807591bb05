"""Byte-level BPE through a table of distinct words.

Texts are split into words, stretches the tokenizer never looks across. A chunk of documents gives
its distinct words, dealt into buckets by their hash, and the word number of every position. A
bucket gets the words of all chunks that hash to it and encodes each distinct word once. The ids go
back to their chunk, where every position takes the ids of its word. Decoding joins the ids with the
id-to-piece table of the vocabulary, which has a fixed size.

Texts are never moved, only words and positions. A chunk sends each word once, however frequent it
is, so no bucket is hot.

Defined cases: null and empty texts have no ids and decode to the empty text; names of special
tokens in a text are what the library makes of them; repeated rows and ids are encoded row by row;
a document is never split, so a very long text is a chunk of its own; an empty table gives an empty
result. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches, texts_of
from driftline.llm.word_ids import SPACED, WordIds, open_tokenizer
from driftline.session import cut

# Characters of text after which a chunk ends with the document at hand.
CHUNK = 24_000_000


def special_names(path: str) -> list[str]:
    """Names of added tokens; the library cuts them out of a text before anything else."""
    import json

    with open(path, encoding="utf-8") as f:
        return sorted((t["content"] for t in json.load(f).get("added_tokens", [])), key=len, reverse=True)


def spaced_words(special: list[str]):
    """A splitter into words for a byte-level tokenizer with these special names."""
    import re

    cut_out = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def split(text: str) -> list[str]:
        if cut_out is None or not any(s in text for s in special):
            return SPACED.findall(text)
        out = []
        for part in cut_out.split(text):
            if part in special:
                out.append(part)
            else:
                out += SPACED.findall(part)
        return out

    return split


def varints(values: np.ndarray) -> bytes:
    """Non-negative numbers in groups of 7 bits, the lowest first."""
    parts, v = [], values.astype(np.uint64)
    more = np.ones(len(v), bool)
    cols = []
    while more.any():
        rest = v >> np.uint64(7)
        byte = (v & np.uint64(127)).astype(np.uint8) | np.where(rest > 0, 128, 0).astype(np.uint8)
        cols.append((byte, more.copy()))
        more &= rest > 0
        v = rest
    if not cols:
        return b""
    parts = np.stack([c for c, _ in cols], 1)
    return parts[np.stack([m for _, m in cols], 1)].tobytes()


def read_varints(data: np.ndarray) -> np.ndarray:
    """The numbers in a buffer of `varints`, of any number of calls one after another."""
    last = data < 128
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(data) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    out = np.zeros(len(starts), np.int64)
    for k in range(int(lengths.max(initial=0))):
        has = lengths > k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _packer():
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress


def _unpacker():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _lengths_first(parts: list[bytes]) -> bytes:
    """Byte strings in one: how many, their lengths, then all of them."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _read_parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)
    cuts = [4 * (n + 1), *ends.tolist()]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


ROWS = "chunk bigint, bucket int, data binary, docs binary"


def _chunks(split, buckets: int, words_too: bool, positions_too: bool):
    """Per chunk, with all data compressed, a row per bucket with its distinct words, and a row
    (bucket -1) with the word numbers of all positions and, in `docs`, the bucket of every word and
    id, null flag and number of words per document. Words are numbered by first appearance, so that
    frequent ones have short numbers, and stand in this order in their buckets. A chunk is named by
    a hash of its rows, so it has the same name whichever task makes it."""
    def rows_of(chunk, number, codes, docs):
        import xxhash

        pack = _packer()
        words = [w.encode("utf-8", "surrogatepass") for w in number]
        place = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], np.int64)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(buckets + 1))
        rows = []
        if positions_too:
            about = pack(_lengths_first([place.astype("<u4").tobytes(), np.array(docs, "<i8").tobytes()]))
            rows.append((-1, varints(np.concatenate(codes)), about))
        for k in np.flatnonzero(np.diff(bounds)).tolist() if words_too else ():
            rows.append((k, _lengths_first([words[i] for i in order[bounds[k]:bounds[k + 1]].tolist()]), None))
        k, data, info = zip(*rows) if rows else ((), (), ())
        data = [pack(x) for x in data]
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk] * len(rows), pa.int64()), pa.array(k, pa.int32()), pa.array(data, pa.binary()), pa.array(info, pa.binary())],
            names=["chunk", "bucket", "data", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number, codes, docs, size, name = {}, [], [], 0, xxhash.xxh3_64()
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                own = split(text)
                for w in own:
                    if w not in number:
                        number[w] = len(number)
                codes.append(np.fromiter([number[w] for w in own], np.int32, len(own)))
                docs.append((0 if i is None else i, i is None, len(own)))
                name.update(f"{i} {len(text)} ".encode() + text.encode("utf-8", "surrogatepass"))
                size += len(text)
                if size >= CHUNK:
                    yield rows_of(name.intdigest() - (1 << 63), number, codes, docs)
                    number, codes, docs, size, name = {}, [], [], 0, xxhash.xxh3_64()
        if docs:
            yield rows_of(name.intdigest() - (1 << 63), number, codes, docs)

    return run


def _encode_buckets(words: WordIds):
    """Words of a bucket to their ids. Chunks come one after another; known words are not encoded
    again."""
    def run(batches):
        pack, unpack = _packer(), _unpacker()
        for b in batches:
            out = []
            for data in b.column("data").to_pylist():
                own = [w.decode("utf-8", "surrogatepass") for w in _read_parts(unpack(data))]
                out.append(pack(_lengths_first(words.of_words(own))))
            yield pa.RecordBatch.from_arrays(
                [b.column("chunk"), b.column("bucket"), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())],
                names=["chunk", "bucket", "data", "docs"])

    return run


OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _assemble(pieces):
    """All rows of a chunk to a row per document: ids at their positions, and the way back."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Chunks of one name have equal rows: their words count once, their documents each time.
        times = int((rows["bucket"] < 0).sum())
        rows = rows.drop_duplicates("bucket").sort_values("bucket")
        at, unpack = rows.iloc[0], _unpacker()
        numbers = read_varints(np.frombuffer(unpack(at["data"]), np.uint8))
        place, docs = _read_parts(unpack(at["docs"]))
        order = np.argsort(np.frombuffer(place, "<u4"), kind="stable").tolist()
        docs = np.frombuffer(docs, "<i8").reshape(-1, 3)
        ids = [[]] * len(order)
        by_bucket = (x for data in rows["data"].iloc[1:] for x in _read_parts(unpack(data)))
        for k, x in zip(order, by_bucket, strict=True):
            ids[k] = np.frombuffer(x, "<u4").tolist()
        count = np.array([len(x) for x in ids], np.int64)
        written = [",".join(map(str, x)) for x in ids]
        read = [b"".join([pieces[i] for i in x]) for x in ids]
        out, start = [], 0
        for doc_id, null, n in docs.tolist():
            own = numbers[start:start + n]
            start += n
            own_list = own.tolist()
            text = b"".join([read[k] for k in own_list])
            out.append((None if null else doc_id, int(count[own].sum()) if n else 0,
                        hashlib.sha256(",".join([written[k] for k in own_list]).encode()).hexdigest(),
                        hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest()))
        frame = pd.DataFrame(out * times, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return frame.astype({"doc_id": "Int64"})

    return run


def piece_table(path: str) -> list[bytes]:
    """The bytes of every id; the printable stand-ins of a byte-level vocabulary are undone."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    vocab = open_tokenizer(path).get_vocab()
    special = set(special_names(path))
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece.encode() if piece in special else bytes(byte_of[c] for c in piece)
    return out


def encode_chunks(docs: DataFrame, path: str, repeatable=True) -> DataFrame:
    """Rows by chunk: word numbers of positions (bucket -1) and the ids of its words by bucket.

    `docs` is read twice, for words and for positions, and must give the same rows in the same order
    both times, as a scan does; if it does not, the job fails. With `repeatable=False` it is read
    once, and positions are written beside the words, which takes more disk."""
    spark = docs.sparkSession
    bounded_batches(spark, rows=500)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = spaced_words(special_names(path))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(source.mapInArrow(_chunks(split, buckets, True, not repeatable), ROWS))
    positions = source.mapInArrow(_chunks(split, buckets, False, True), ROWS) if repeatable else rows.filter("bucket < 0")
    encoded = (rows.filter("bucket >= 0").repartition("bucket")
               .mapInArrow(_encode_buckets(WordIds(path, split, spaced=True)), ROWS))
    return encoded.unionAll(positions)


def encode_and_decode(docs: DataFrame, path: str, repeatable=True) -> DataFrame:
    """Per row: doc_id, number of ids, SHA-256 of the decimal ids joined by commas, and of the text
    that they decode to."""
    return encode_chunks(docs, path, repeatable).groupBy("chunk").applyInPandas(_assemble(piece_table(path)), OUT)
