"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers read a space and the text. A token ends at a byte offset; where tokens of both end,
a group ends. The two arrays of ends are compared along a diagonal: at a current index shift, slices
of doubling length are tested for equality, and the longest equal stretch is jumped, in which every
token of the one stands beside one of the other. At the first difference the side that lags behind
moves on until ends agree again; this is an irregular group, and the shift changes by the difference
of its two counts.

Encoding works on the distinct units of a chunk of documents. A unit ends before a space that follows
a character other than white space and the piece tokenizer's space mark; neither tokenizer looks across
such a place, since no piece of the one has a space mark behind another character, and the pattern of the
other starts anew there. Units are encoded many at a time and cut by their byte lengths.

Each group links the two tokens that end it. A chunk counts its distinct linked pairs, the corpus sums
them, and each pair's count, and whether its second id has no pair counted higher, goes back to the
chunks that hold it. First results are written before that, so no text is encoded twice.

Defined cases: a null, empty or not representable text (its tokens' bytes differ from space and text,
as where it holds the space mark itself) has no tokens, zeros and the empty string; names of special
tokens in a text are plain text; repeated rows and ids count row by row; a null doc_id stays null; a
document is never split; ties for the highest count all count as best; an empty table gives an empty
result. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.bpe import piece_table, read_varints, varints
from driftline.llm.common import bounded_batches, texts_of
from driftline.llm.word_ids import _WHITE, open_tokenizer
from driftline.session import cut

# Characters of text after which a chunk ends with the document at hand.
CHUNK = 16_000_000
MARK = "▁"
UNIT = re.compile(f"[{_WHITE}{MARK}]+[^{_WHITE}{MARK}]*(?:(?! )[{_WHITE}{MARK}]+[^{_WHITE}{MARK}]*)*")
_ENDS_WHITE = re.compile(f"[{_WHITE}{MARK}]\\Z")


def diagonal_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Irregular groups (first a, behind a, first b, behind b) of two rising arrays of ends that agree
    at their last; all other tokens stand one to one."""
    a, b = (np.ascontiguousarray(x, "<u4").tobytes() for x in (ends_a, ends_b))
    la, lb = ends_a.tolist(), ends_b.tolist()
    n, i, j, out = len(a), 0, 0, []
    while True:
        # Offsets in bytes. Probe with doubling steps, then narrow the last one down.
        step = 4
        while i < n and a[i:i + step] == b[j:j + step]:
            i, j, step = i + step, j + step, 2 * step
        if i >= n:
            return out
        while step > 4:
            step >>= 1
            if a[i:i + step] == b[j:j + step]:
                i, j = i + step, j + step
        x, y = i >> 2, j >> 2
        p, q, at_a, at_b = x, y, la[x], lb[y]
        while at_a != at_b:
            if at_a < at_b:
                p += 1
                at_a = la[p]
            else:
                q += 1
                at_b = lb[q]
        out.append((x, p + 1, y, q + 1))
        i, j = 4 * p + 4, 4 * q + 4
        if i >= n:
            return out


class PairEncoder:
    """Tokens of units by both tokenizers. A reads the unit as it is, B adds the unit's first space."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.paths, self.a = (bytes_path, pieces_path), None

    def __getstate__(self):
        return {"paths": self.paths, "a": None}

    def open(self):
        if self.a is not None:
            return
        import sentencepiece

        self.a = open_tokenizer(self.paths[0])
        # Names of special tokens in a text are plain text.
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.paths[1])
        self.bytes_a = piece_table(self.paths[0])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on behind a space, so texts cannot be cut into units")
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names = [f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"] + [
            f"{i}{c}" for i in range(len(self.bytes_b)) for c in ",;"]
        # A space alone: the library adds none to the empty text.
        self.space = self.b.piece_to_id(MARK)

    def _one(self, unit: str):
        ids_a = self.a.encode(unit, add_special_tokens=False).ids
        ids_b = self.b.encode(unit[1:], num_threads=1) if len(unit) > 1 else [self.space]
        want = unit.encode()
        if b"".join([self.bytes_a[k] for k in ids_a]) != want or b"".join([self.bytes_b[k] for k in ids_b]) != want:
            return None
        return ids_a, ids_b

    def _many(self, units: list[str]):
        """Ids of both and their number per unit; None if a border fell inside a token."""
        text = "".join(units)
        want, out = text.encode(), []
        ends = np.cumsum([len(u) for u in units] if len(want) == len(text) else [len(u.encode()) for u in units])
        for ids, sizes, table in ((self.a.encode(text, add_special_tokens=False).ids, self.size_a, self.bytes_a),
                                  (self.b.encode(text[1:], num_threads=1), self.size_b, self.bytes_b)):
            if b"".join([table[k] for k in ids]) != want:
                return None
            ids = np.array(ids, np.int64)
            at = np.cumsum(sizes[ids])
            cuts = np.searchsorted(at, ends)
            if (at[cuts] != ends).any():
                return None
            out += [ids, np.diff(cuts + 1, prepend=0)]
        return out

    def encode(self, units: list[str], many=500):
        """(ids, number per unit) of both tokenizers, flat, and whether each unit is representable."""
        self.open()
        parts, order, good = [], [], np.ones(len(units), bool)
        plain = [k for k, u in enumerate(units) if MARK not in u and not _ENDS_WHITE.search(u)]
        apart = set(range(len(units))).difference(plain)
        for s in range(0, len(plain), many):
            own = plain[s:s + many]
            got = self._many([units[k] for k in own])
            if got is None:
                apart.update(own)
            else:
                parts.append(got)
                order += own
        for k in sorted(apart):
            got = self._one(units[k])
            good[k] = got is not None
            a, b = got or ([], [])
            parts.append([np.array(a, np.int64), np.array([len(a)]), np.array(b, np.int64), np.array([len(b)])])
            order.append(k)
        place = np.empty(len(units), np.int64)
        place[order] = np.arange(len(units))
        flat = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(4)]
        return [(*_reorder(flat[c], flat[c + 1], place), ) for c in (0, 2)], good


def _reorder(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
    """The runs of `flat` named by `rows`, one after another, and their sizes."""
    starts, own = (np.cumsum(sizes) - sizes)[rows], sizes[rows]
    at = np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    return flat[at], own


def group_text(ids_a, ids_b, end_a, end_b, names, n_a) -> str:
    """`a1,a2|b1;a3|b2,b3`: every token's decimal id with the mark behind it, in order of groups."""
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    stops_a, stops_b = np.flatnonzero(end_a) + 1, np.flatnonzero(end_b) + 1
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    code[np.arange(len(ids_a)) + np.append(0, stops_b)[group_a]] = 2 * ids_a + end_a
    code[np.arange(len(ids_b)) + stops_a[group_b]] = 2 * (n_a + ids_b) + end_b
    return "".join(map(names.__getitem__, code.tolist()))[:-1]


FIRST = ("chunk bigint, kind int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, "
         "code int, a int, b int, n bigint")
DOC, PAIR = 0, 1


def _first(encoder: PairEncoder):
    """Rows of documents, with their linked pairs as (code, times) in `links`, and rows of the distinct
    pairs of the chunk with their code and number of links."""
    def finish(chunk, number, codes, docs):
        ((a, n_a), (b, n_b)), good = encoder.encode(list(number))
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        wide = np.int64(len(encoder.size_b))
        rows, keys, at = [], [], []
        for doc_id, units in zip(docs, codes):
            if not len(units) or not good[units].all():
                rows.append((doc_id, 0, 0, 0, ""))
                keys.append(np.zeros(0, np.int64))
                continue
            own_a, own_b = (_take(flat, starts, sizes, units) for flat, starts, sizes in ((a, start_a, n_a), (b, start_b, n_b)))
            end_a, end_b = np.ones(len(own_a), np.int64), np.ones(len(own_b), np.int64)
            odd = diagonal_groups(np.cumsum(encoder.size_a[own_a]), np.cumsum(encoder.size_b[own_b]))
            if odd:
                x0, x1, y0, y1 = np.array(odd).T
                _clear(end_a, x0, x1 - 1)
                _clear(end_b, y0, y1 - 1)
            text = group_text(own_a, own_b, end_a, end_b, encoder.names, len(encoder.bytes_a))
            pairs = own_a[end_a > 0] * wide + own_b[end_b > 0]
            rows.append((doc_id, len(own_a), len(own_b), len(pairs), hashlib.sha256(text.encode()).hexdigest()))
            keys.append(pairs)
        every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        distinct, code, times = np.unique(every, return_inverse=True, return_counts=True)
        # Frequent pairs get short codes.
        by = np.argsort(-times, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        code, distinct, times = rank[code.reshape(-1)], distinct[by], times[by]
        links, start = [], 0
        for k in keys:
            own, n = np.unique(code[start:start + len(k)], return_counts=True)
            start += len(k)
            links.append(varints(np.concatenate([np.diff(own, prepend=0), n])))
        doc_id, n_a, n_b, groups, digest = zip(*rows)
        yield _batch(chunk, len(rows), doc_id=doc_id, n_a=n_a, n_b=n_b, n_groups=groups, groups_sha256=digest, links=links, kind=DOC)
        for s in range(0, len(distinct), 100_000):
            part = slice(s, s + 100_000)
            yield _batch(chunk, len(distinct[part]), code=np.arange(s, s + len(distinct[part])), a=distinct[part] // wide,
                         b=distinct[part] % wide, n=times[part], kind=PAIR)

    def run(batches):
        def fresh():
            return defaultdict(itertools.count().__next__), [], []

        encoder.open()
        number, codes, docs = fresh()
        size = parts = 0
        chunk = 0
        for t in batches:
            for at, i, text in zip(t.column("at").to_pylist(), t.column("doc_id").to_pylist(), texts_of(t)):
                chunk = (at << 32) + parts
                own = UNIT.findall(" " + text) if text else ()
                codes.append(np.array([number[u] for u in own], np.int64))
                docs.append(i)
                size += len(text)
                if size >= CHUNK:
                    yield from finish(chunk, number, codes, docs)
                    parts, size = parts + 1, 0
                    number, codes, docs = fresh()
        if docs:
            yield from finish(chunk, number, codes, docs)

    return run


def _take(flat, starts, sizes, rows):
    own = sizes[rows]
    at = np.repeat(starts[rows] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    return flat[at]


def _clear(flags: np.ndarray, first: np.ndarray, behind: np.ndarray) -> None:
    """Zero in all ranges [first, behind)."""
    sizes = behind - first
    flags[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = 0


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(chunk, rows, kind, **columns):
    names, cols = [], []
    for field in FIRST.split(", "):
        name, arrow = field.split()[0], _KINDS[field.split()[1]]
        names.append(name)
        if name in ("chunk", "kind"):
            cols.append(pa.array(np.full(rows, chunk if name == "chunk" else kind), arrow))
        else:
            cols.append(pa.array(columns[name], arrow) if name in columns else pa.nulls(rows, arrow))
    return pa.RecordBatch.from_arrays(cols, names=names)


OUT = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
       "groups_sha256 string")


def _last(rows: pa.Table) -> pa.Table:
    """All rows of a chunk: pairs with corpus counts meet the documents that hold them."""
    kind = rows.column("kind").to_numpy()
    pairs, docs = (rows.filter(pa.array(kind == k)) for k in (PAIR, DOC))
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, bool)
    code = pairs.column("code").to_numpy()
    count[code] = pairs.column("n").to_numpy()
    best[code] = pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, total = [], []
    for links in docs.column("links").to_pylist():
        numbers = read_varints(np.frombuffer(links, np.uint8))
        own, n = np.cumsum(numbers[:len(numbers) // 2]), numbers[len(numbers) // 2:]
        n_best.append(int(n[best[own]].sum()))
        total.append(int((n * count[own]).sum()))
    same = {n: docs.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
    same |= {"n_links": docs.column("n_groups"), "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
    return pa.table({n.split()[0]: same[n.split()[0]] for n in OUT.split(", ")})


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n, best) of pairs (a, b, n): the corpus count, and whether no pair of b has a higher one."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    # As many rows as the second vocabulary has ids at most.
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Per row: numbers of tokens, groups and links, links whose pair is its second id's most frequent,
    the sum of the links' counts, and SHA-256 of the groups."""
    spark = docs.sparkSession
    bounded_batches(spark, rows=2000)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("at"))
    first = cut(source.mapInArrow(_first(PairEncoder(bytes_path, pieces_path)), FIRST))
    pairs = first.filter(F.col("kind") == PAIR)
    counted = pairs.select("chunk", "code", "a", "b").join(pair_counts(pairs.select("a", "b", "n")), ["a", "b"])
    cols = ["chunk", "kind", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "code", "n", "best"]
    known = {"kind": F.lit(PAIR)}
    found = counted.select(*[F.col(c) if c in counted.columns else known.get(c, F.lit(None).cast(first.schema[c].dataType)).alias(c) for c in cols])
    rows = first.filter(F.col("kind") == DOC).withColumn("best", F.lit(None).cast("boolean")).select(*cols)
    return rows.unionAll(found).groupBy("chunk").applyInArrow(_last, OUT)
