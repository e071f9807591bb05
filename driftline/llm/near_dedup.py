"""Near duplicates by an LSH forest, confirmed on full shingle sets.

Every text becomes the set of its word shingles (64-bit hashes) and a MinHash signature. Equal sets
are one node, whatever their number. Each of TREES sorted orders starts at another place of the
signature; nodes with the same first DEPTH values form a region. Candidates are

 1. of the neighbours of a node in all orders, the few with the longest common prefixes, so that the
    depth of comparison follows how crowded each region is;
 2. nodes of other components against the best linked nodes of a region's largest component;
 3. every pair of a region that is still in different components; in crowded regions these are
    compared block by block, signatures first, so that sets meet without a row per pair, and a block
    gives only links that join components.

Each step is confirmed on the full sets and followed by connected components; the next only looks
at pairs that could still join two of them. So dense groups cost a few links per node, while no
pair of a region with a link that matters is left out. A pair at the least similarity 0.8 misses
every region with probability (1 - 0.8^3)^20 < 1e-6, and less where it is more alike.

Defined cases: texts without words are linked with nothing; fewer words than a shingle has are one
shingle; rows with a null id keep a null component and are kept; repeated ids are one document, with
the sets of all their texts linked; a very long text is one set in a task; ties among neighbours go to
the smaller ids and change no result; an empty table gives an empty result. Only `doc_id` and `text`
are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches, texts_of
from driftline.llm.components import components, merged, small
from driftline.operators.groups import lookup_groups
from driftline.session import cut

HASHES = 64
TREES = 20
DEPTH = 3
DEEPEST = 9
# A region above this many rows is compared in blocks.
CROWD = 64
# Rows before a row that it is a neighbour of, and neighbours over all orders that a node is compared with first.
NEIGHBOURS = 2
NEAREST = 3
# Signatures that agree in fewer places (5 standard deviations below 0.8) are not confirmed.
AGREE = 35
HUBS = 8
# Ids that are broadcast to find their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Near:
    words: int = 5
    percent: int = 80


# Words of more bytes are hashed one by one.
LONG_WORD = 64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in place; every bit depends on all."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words `[^\\x20\\x09-\\x0D]+` of `data` begin, and their 64-bit hashes. All words go
    through the rounds together, eight bytes a round, as long as they last."""
    import xxhash

    chars = np.frombuffer(b" " + data + b" " * 8, np.uint8)
    # Places where white space ends or begins, in turn; offsets are those of `chars`.
    edges = np.flatnonzero(np.diff(_WHITE[chars])) + 1
    at, ends = edges[0::2], edges[1::2]
    size = ends - at
    eight = np.ndarray(len(chars) - 7, "<u8", chars, strides=(1,))
    out = _mixed_bits(size.astype(np.uint64))
    some = np.flatnonzero(size <= LONG_WORD)
    k = 0
    while len(some):
        left = size[some] - k
        block = eight[at[some] + k]
        short = left < 8
        block[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[some] = _mixed_bits((out[some] + np.uint64(0x9E3779B97F4A7C15)) ^ block)
        some = some[left > 8]
        k += 8
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(chars[at[i]:ends[i]])
    return at - 1, out


class Shingler:
    """Sorted distinct shingle hashes of texts, A-Z lower-cased."""

    def __init__(self, words: int):
        self.words = words

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        begin = np.cumsum([0, *[len(t) + 1 for t in data]])
        # Bytes are lower-cased in ASCII alone.
        at, h = word_hashes(b"\n".join(data).lower())
        first = np.searchsorted(at, begin).tolist()
        full = self._hashes(h, self.words)
        out = []
        for i, j in zip(first, first[1:]):
            s = full[i:j - self.words + 1].copy() if j - i >= self.words else self._hashes(h[i:j], j - i)
            s.sort()
            out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
        return out

    @staticmethod
    def _hashes(h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all `k` words in a row."""
        n = len(h) - k + 1
        if not k or n <= 0:
            return np.zeros(0, np.uint64)
        s = np.full(n, k, np.uint64)
        for i in range(k):
            s *= np.uint64(0x9E3779B97F4A7C15)
            s += h[i:i + n]
            s ^= s >> np.uint64(31)
        return _mixed_bits(s)


_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64)[:, None] | np.uint64(1)


def signature(shingles: np.ndarray) -> bytes:
    """HASHES minima as big-endian unsigned 32-bit numbers, so that bytes sort as values do. The upper
    half of the least product is the least upper half."""
    out = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[None, k:k + 4096] * _FACTORS).min(axis=1))
    return (out >> np.uint64(32)).astype(">u4").tobytes()


def shingle_table(docs: DataFrame, near: Near) -> DataFrame:
    """(doc_id, n_shingles, digest, sig); digest and sig are null for an empty set."""
    bounded_batches(docs.sparkSession)
    shingler = Shingler(near.words)

    def run(batches):
        for b in batches:
            n, digests, sigs = [], [], []
            for s in shingler.sets(texts_of(b)):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary, sig binary")


# The forest

def _tree_rows(batches):
    """(key, rest, id): hash of tree and first values, the next values, the node."""
    import xxhash

    for b in batches:
        ids, keys, rests = [], [], []
        for i, sig in zip(b.column("id").to_pylist(), b.column("sig").to_pylist()):
            twice = sig + sig
            for t in range(TREES):
                at = 4 * DEPTH * t
                keys.append(xxhash.xxh3_64_intdigest(twice[at:at + 4 * DEPTH], seed=t) - (1 << 63))
                rests.append(twice[at + 4 * DEPTH:at + 4 * DEEPEST])
                ids.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rests, pa.binary()), pa.array(ids, pa.int64())],
                                         names=["key", "rest", "id"])


FOUND = "kind int, key bigint, a bigint, b bigint, depth int"
PAIR, MEMBER = 0, 1


def _neighbours(batches):
    """Over rows sorted by key, rest and id: pairs of near rows of a region with the length of their
    common prefix, and the members of regions with several rows. A region may go on in the tasks beside
    this one, so the first and the last row are members in any case."""
    def table(kind, key, a, b=None, depth=None):
        n = len(key)
        cols = [np.full(n, kind, np.int32), key, a, b, depth]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["kind", "key", "a", "b", "depth"])

    key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rest = np.zeros((0, DEEPEST - DEPTH), ">u4")
    for batch in batches:
        if not batch.num_rows:
            continue
        if not len(key):
            yield table(MEMBER, batch.column("key").to_numpy()[:1], batch.column("id").to_numpy()[:1])
        old = len(key)
        key = np.append(key, batch.column("key").to_numpy())
        node = np.append(node, batch.column("id").to_numpy())
        rest = np.concatenate([rest, np.frombuffer(b"".join(batch.column("rest").to_pylist()), ">u4").reshape(-1, DEEPEST - DEPTH)])
        for d in range(1, NEIGHBOURS + 1):
            at = np.arange(max(old, d), len(key))
            at = at[(key[at] == key[at - d]) & (node[at] != node[at - d])]
            x, y = node[at - d], node[at]
            depth = DEPTH + np.cumprod(rest[at] == rest[at - d], axis=1).sum(axis=1)
            yield table(PAIR, key[at], np.minimum(x, y), np.maximum(x, y), depth)
        at = np.arange(max(old, 1), len(key))
        at = at[key[at] == key[at - 1]]
        # The first row of a region is a member once a second one is there.
        first = at[(at < 2) | (key[at - 1] != key[at - 2])] - 1
        both = np.append(first, at)
        yield table(MEMBER, key[both], node[both])
        key, node, rest = (x[-NEIGHBOURS:] for x in (key, node, rest))
    if len(key):
        yield table(MEMBER, key[-1:], node[-1:])


def forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbour pairs (a < b) and region members (key, id) of nodes (id, sig). Each node has its
    NEAREST neighbours by common prefix over all orders; members stand for all other pairs."""
    spark = nodes.sparkSession
    bounded_batches(spark, rows=20_000)
    rows = nodes.select("id", "sig").mapInArrow(_tree_rows, "key bigint, rest binary, id bigint")
    ordered = rows.repartitionByRange("key", "rest", "id").sortWithinPartitions("key", "rest", "id")
    found = cut(ordered.mapInArrow(_neighbours, FOUND))
    met = found.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.max("depth").alias("depth"))
    ends = met.select(F.explode(F.array("a", "b")).alias("x"), "a", "b", "depth")
    nearest = W.partitionBy("x").orderBy(F.desc("depth"), "a", "b")
    pairs = ends.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= NEAREST).select("a", "b").distinct()
    members = found.filter(F.col("kind") == MEMBER).select("key", F.col("a").alias("id")).distinct()
    return pairs, members


# Confirming

def _agreement(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree in AGREE places."""
    def side(x):
        return nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}"))

    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        100 * F.least("na", "nb") >= near.percent * F.greatest("na", "nb"))

    def run(batches):
        for t in batches:
            a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), ">u4").reshape(-1, HASHES) for c in ("siga", "sigb"))
            same = (a == b).sum(axis=1)
            keep = same >= AGREE
            yield pa.RecordBatch.from_arrays(
                [t.column("a").filter(pa.array(keep)), t.column("b").filter(pa.array(keep)), pa.array(same[keep].astype(np.int32))],
                names=["a", "b", "same"])

    return met.select("a", "b", "siga", "sigb").mapInArrow(run, "a bigint, b bigint, same int")


def with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of `docs` to (doc_id). A counted few ids are broadcast, so that texts stay
    where they are; more are joined by shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", how)


def full_sets(docs: DataFrame, ids: DataFrame, near: Near) -> DataFrame:
    """(id, full): the sets of the documents named in (doc_id), as written."""
    shingler = Shingler(near.words)

    def full(batches):
        for b in batches:
            sets = [s.tobytes() for s in shingler.sets(texts_of(b))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "full"])

    bounded_batches(docs.sparkSession, rows=500)
    return cut(with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut(ids), "left_semi")
               .mapInArrow(full, "id bigint, full binary"))


def confirm(pairs: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough. `docs` has one text per node."""
    pairs = cut(pairs.select("a", "b"))
    sets = full_sets(docs, pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), near)
    met = (pairs.join(sets.withColumnsRenamed({"id": "a", "full": "fa"}), "a")
           .join(sets.withColumnsRenamed({"id": "b", "full": "fb"}), "b"))

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column("fa").to_pylist(), t.column("fb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= near.percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(mask), t.column("b").filter(mask)], names=["a", "b"])

    return cut(met.select("a", "b", "fa", "fb").mapInArrow(run, "a bigint, b bigint").distinct())


def _other_component(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component; an id without a label is its own."""
    named, labels = pairs, small(labels)
    for x in ("a", "b"):
        named = named.join(labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    return named.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of regions with several components: key, id, component, the region's largest
    component `main`, and how many rows the region (`total`) and the rest of it (`rest`) has."""
    named = members.join(small(labels), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = (sizes.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("top"))
            .filter("k > 1").select("key", F.col("top")["component"].alias("main"), "total", (F.col("total") - F.col("top")["n"]).alias("rest")))
    return named.join(main, "key")


def _cross_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of a region that are in different components: every node outside the region's largest
    component against every other node. For regions of at most CROWD rows."""
    mixed = mixed.filter(F.col("total") <= CROWD)
    outside = mixed.filter("component <> main").select("key", F.col("id").alias("x"), F.col("component").alias("cx"))
    against = mixed.select("key", F.col("id").alias("y"), F.col("component").alias("cy"))
    return (outside.join(against, "key").filter("cx <> cy")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


# Pairs of a block with like signatures above which all sizes of intersections are found as products.
PAIRWISE = 4096


def _compare_blocks(near: Near):
    """Links that join components, between the outsiders and the members in one block each. Pairs whose
    signatures agree are confirmed on full sets, as long as their components are still apart."""
    def occurrences(flat, owner, n, shingles):
        at = np.minimum(np.searchsorted(shingles, flat), len(shingles) - 1)
        hit = shingles[at] == flat
        out = np.zeros((n, len(shingles)), np.float32)
        out[owner[hit], at[hit]] = 1
        return out

    def products(x, y):
        """Sizes of all intersections, by occurrence matrices over the shingles both sides have."""
        (fx, ox), (fy, oy) = ((np.concatenate(own), np.repeat(np.arange(len(own)), [len(s) for s in own])) for own in (x, y))
        common = np.intersect1d(fx, fy)
        both = np.zeros((len(x), len(y)), np.float32)
        for k in range(0, len(common), 4096):
            part = common[k:k + 4096]
            both += occurrences(fx, ox, len(x), part) @ occurrences(fy, oy, len(y), part).T
        return both.astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        role = np.array(table.column("role").to_pylist())
        ids, comps = (np.array(table.column(c).to_pylist(), np.int64) for c in ("id", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("full").to_pylist()]
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), ">u4").reshape(-1, HASHES)
        x, y = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        same = np.zeros((len(x), len(y)), np.int16)
        for k in range(HASHES):
            same += sigs[x, k][:, None] == sigs[y, k][None, :]
        like = (same >= AGREE) & (comps[x][:, None] != comps[y][None, :])
        dense = products([sets[k] for k in x], [sets[k] for k in y]) if like.sum() > PAIRWISE else None
        top: dict[int, int] = {}

        def find(c):
            while (up := top.get(c, c)) != c:
                c = up
            return c

        out = []
        for i, j in zip(*np.nonzero(like)):
            a, b = x[i], y[j]
            ca, cb = find(int(comps[a])), find(int(comps[b]))
            if ca == cb:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True)) if dense is None else dense[i, j]
            if 100 * both >= near.percent * (len(sets[a]) + len(sets[b]) - both):
                top[max(ca, cb)] = min(ca, cb)
                out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _crowded_links(mixed: DataFrame, nodes: DataFrame, docs: DataFrame, near: Near, block=512) -> DataFrame:
    """Links that join components of regions above CROWD rows. Outsiders and members are dealt into
    blocks; every block of the one meets every block of the other."""
    crowded = cut(mixed.filter(F.col("total") > CROWD)
                  .withColumns({"s": F.ceil(F.col("total") / block).cast("int"), "r": F.ceil(F.col("rest") / block).cast("int")}))
    place = F.xxhash64("id")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = crowded.filter("component <> main").select(
        "key", everywhere("s").alias("s"), F.pmod(place, F.col("r")).cast("int").alias("r"), F.lit(0).alias("role"), "id", "component")
    against = crowded.select(
        "key", F.pmod(place, F.col("s")).cast("int").alias("s"), everywhere("r").alias("r"), F.lit(1).alias("role"), "id", "component")
    sets = full_sets(docs, crowded.select(F.col("id").alias("doc_id")).distinct(), near).join(nodes.select("id", "sig"), "id")
    return cut(outside.unionAll(against).join(sets, "id").groupBy("key", "s", "r")
               .applyInArrow(_compare_blocks(near), "a bigint, b bigint").distinct())


def _hub_pairs(members: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes against the best linked nodes of the largest other component of their region."""
    degree = (links.select(F.col("a").alias("id")).unionAll(links.select("b")).groupBy("id").agg(F.count("*").alias("d"))
              .join(labels, "id"))
    top = W.partitionBy("component").orderBy(F.desc("d"), "id")
    hubs = degree.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= HUBS).select("component", F.col("id").alias("hub"))
    named = members.join(small(labels), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = (sizes.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("n", "component")).alias("top"))
            .filter("k > 1").select("key", F.col("top")["component"].alias("main")))
    outside = named.join(main, "key").filter("component <> main").select("id", "main").distinct()
    return (outside.join(hubs.withColumnRenamed("component", "main"), "main").filter("id <> hub")
            .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())


def link_nodes(nodes: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """(id, component) of the nodes (id, n, sig) that are linked with another."""
    pairs, members = forest(nodes)
    members = cut(members)
    likely = cut(_agreement(pairs, nodes, near))
    ends = likely.select(F.col("a").alias("x"), "a", "b", "same").unionAll(likely.select(F.col("b").alias("x"), "a", "b", "same"))
    best = W.partitionBy("x").orderBy(F.desc("same"), "a", "b")
    links = confirm(ends.withColumn("r", F.row_number().over(best)).filter("r <= 2").select("a", "b").distinct(), docs, near)
    labels = cut(components(links))

    def also(candidates):
        more = cut(candidates.join(links, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            link(confirm(more, docs, near))

    def link(found):
        nonlocal links, labels
        if found.isEmpty():
            return
        links = links.unionAll(found)
        labels = cut(merged(labels, found))

    also(_other_component(likely, labels).select("a", "b"))
    also(_agreement(_hub_pairs(members, labels, links), nodes, near).select("a", "b"))
    also(_agreement(_cross_pairs(_mixed(members, labels)), nodes, near).select("a", "b"))
    link(_crowded_links(_mixed(members, labels), nodes, docs, near))
    return labels


def near_duplicates(docs: DataFrame, near=Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: component_id is the smallest id
    reachable over links, kept marks the rows that carry it."""
    table = cut(shingle_table(docs, near))
    named = table.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    groups = cut(named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"),
                                             F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    nodes = groups.select("id", "n", "sig")
    labels = link_nodes(nodes, docs, near)
    final = cut(groups.select("digest", "id", "rows").join(labels, "id", "left")
                .select("digest", "rows", F.coalesce("component", "id").alias("component")))
    rows = table.select("doc_id", "n_shingles", "digest")
    placed = lookup_groups(rows, final, ["digest"], n="rows")
    found = placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, near=Near()) -> DataFrame:
    """The rows of `docs` with all columns, one document of each component. Rows that repeat an id
    are one document and are reduced to one row."""
    found = cut(near_duplicates(docs, near))
    dropped = cut(found.filter("NOT kept").select("doc_id").distinct())
    repeated = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    left = with_ids(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return left
    ids = cut(repeated)
    once = with_ids(docs, ids, "left_semi")
    return with_ids(left, ids, "left_anti").unionByName(once.dropDuplicates(["doc_id"]).select(*docs.columns))
