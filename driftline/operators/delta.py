"""Block signatures, block matching and delta application over content tables.

Contents come as whole values (rel_path, content) or in chunks (`operators.content`), for files of any
size. The unit of work is a chunk and not a file: the greedy match of a large file is found chunk by
chunk, the chunks' outcomes are chained exactly, and a file is rebuilt chunk by chunk.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import rolling
from driftline.operators.chains import chain_entries
from driftline.operators.content import CHUNK, as_chunks, chunk_content, file_sizes, is_chunked, whole_content
from driftline.session import cut

MIN_BLOCK, MAX_BLOCK = 512, 131072


def block_size(size) -> Column:
    """trunc(sqrt(size)) within [512, 131072]."""
    size = F.col(size) if isinstance(size, str) else size
    return F.greatest(F.lit(MIN_BLOCK), F.least(F.lit(MAX_BLOCK), F.sqrt(size.cast("double")).cast("int")))


def _blocks(content: DataFrame, width=None) -> DataFrame:
    """One row per block with its bytes; the short last block is kept, empty files have none."""
    size = F.octet_length("content").cast("bigint")
    width = block_size(size) if width is None else F.lit(width)
    count = F.col("size") / F.col("block_size")
    return (content.select("rel_path", "content", size.alias("size"), width.alias("block_size"))
            .filter("size > 0")
            .select("rel_path", "content", "size", "block_size",
                    F.explode(F.sequence(F.lit(0), F.ceil(count).cast("int") - 1)).alias("block_idx"))
            .select("rel_path", "size", "block_size", "block_idx",
                    (F.col("block_idx").cast("bigint") * F.col("block_size")).alias("offset"),
                    F.substring("content", F.col("block_idx") * F.col("block_size") + 1, F.col("block_size"))
                    .alias("bytes")))


def _parts(chunks: DataFrame, width=None) -> DataFrame:
    """The part of every block that lies in a chunk. `whole` marks parts that are their block; the
    others, one or two at a chunk's borders, meet their other half in another chunk."""
    w = block_size("size") if width is None else F.lit(width)
    first, last = F.expr("CAST(offset div block_size AS INT)"), F.expr("CAST((offset + octet_length(bytes) - 1) div block_size AS INT)")
    at = F.greatest(F.col("block_idx").cast("bigint") * F.col("block_size"), "offset")
    end = F.least((F.col("block_idx") + 1).cast("bigint") * F.col("block_size"), F.col("offset") + F.octet_length("bytes"))
    length = F.least(F.col("block_size").cast("bigint"), F.col("size") - F.col("block_idx").cast("bigint") * F.col("block_size"))
    return (chunks.filter(F.octet_length("bytes") > 0).withColumn("block_size", w.cast("int"))
            .withColumn("block_idx", F.explode(F.sequence(first, last)))
            .select("rel_path", "size", "block_size", "block_idx", at.alias("at"), (end - at).alias("n"), length.alias("length"),
                    F.substring("bytes", (at - F.col("offset") + 1).cast("int"), (end - at).cast("int")).alias("part"))
            .withColumn("whole", F.col("n") == F.col("length")))


def _joined(parts: DataFrame, **hashes) -> DataFrame:
    """One row per block. Whole blocks are hashed where they are; only the parts of the others travel."""
    key = ["rel_path", "size", "block_size", "block_idx"]
    done = [F.when(F.col("whole"), h(F.col("part"))).alias(n) for n, h in hashes.items()]
    rest = F.when(~F.col("whole"), F.col("part")).alias("part")
    met = (parts.select(*key, "at", "length", rest, *done).groupBy(*key)
           .agg(F.first("length").cast("int").alias("length"), F.expr("listagg(part, X'') WITHIN GROUP (ORDER BY at)").alias("bytes"),
                *[F.first(n, ignorenulls=True).alias(n) for n in hashes]))
    return met.select(*key, "length", *[F.coalesce(n, h(F.col("bytes"))).alias(n) for n, h in hashes.items()])


def signatures(content: DataFrame, width=None) -> DataFrame:
    """Weak and strong hash per block of every file. Equality is all that is used of either."""
    def strong(b):
        return F.sha2(b, 256)

    if is_chunked(content):
        blocks = _joined(_parts(content, width), weak=F.xxhash64, strong=strong)
        offset = (F.col("block_idx").cast("bigint") * F.col("block_size")).alias("offset")
        return blocks.select("rel_path", "block_idx", offset, "length", "block_size", "weak", "strong")
    return _blocks(content, width).select(
        "rel_path", "block_idx", "offset", F.octet_length("bytes").alias("length"), "block_size",
        F.xxhash64("bytes").alias("weak"), strong("bytes").alias("strong"))


def block_matches(src_sig: DataFrame, dst_sig: DataFrame) -> DataFrame:
    """Source blocks at fixed offsets that exist anywhere in the basis of the same file, with the
    lowest basis block. Sign both sides with the same block size."""
    key = ["rel_path", "weak", "strong", "length"]
    basis = dst_sig.groupBy(*key).agg(F.min_by("block_idx", "block_idx").alias("basis_idx"))
    return (src_sig.join(basis, key)
            .select("rel_path", "block_idx", "offset", "length", "basis_idx"))


def changed_blocks(src_sig: DataFrame, dst_sig: DataFrame) -> DataFrame:
    """Source blocks that the basis lacks."""
    return src_sig.join(dst_sig, ["rel_path", "weak", "strong", "length"], "left_anti").select(
        "rel_path", "block_idx", "offset", "length")


@F.pandas_udf(T.LongType())
def _roll(blocks: pd.Series) -> pd.Series:
    return pd.Series(rolling.block_hashes([b or b"" for b in blocks]))


def match_signatures(basis: DataFrame) -> DataFrame:
    """One row per basis file with its block hashes in order. A file has about sqrt(size) blocks,
    so the row stays small (2 MB for a file of 2 GiB)."""
    def strong(b):
        return F.unhex(F.sha2(b, 256))

    if is_chunked(basis):
        rows = _joined(_parts(basis), roll=_roll, strong=strong)
    else:
        rows = _blocks(basis).select(
            "rel_path", "size", "block_size", "block_idx", _roll("bytes").alias("roll"), strong("bytes").alias("strong"))
    packed = rows.groupBy("rel_path").agg(
        F.first("size").alias("basis_size"), F.first("block_size").alias("block_size"),
        F.array_sort(F.collect_list(F.struct("block_idx", "roll", "strong"))).alias("sig"))
    return packed.select("rel_path", "basis_size", "block_size",
                         F.col("sig.roll").alias("rolls"), F.col("sig.strong").alias("strongs"))


# Chunks of a file that share a task, and so one copy of the signature of its basis.
TOGETHER = 16


def _source_chunks(src: DataFrame, chunk_bytes: int, reach: int) -> DataFrame:
    """Chunks of the source files, each with the bytes a window can reach past its end, dealt by
    (rel_path, part), where a part is TOGETHER chunks. Bytes move once."""
    shape = [F.col("size").alias("src_size"), F.expr(f"(size - 1) div {chunk_bytes}L + 1").alias("n_chunks"), "chunk_idx",
             F.col("offset").alias("start")]
    part = F.expr(f"chunk_idx div {TOGETHER}L").alias("part")
    if not is_chunked(src):
        cut_up = chunk_content(src, chunk_bytes, reach - 1).filter("size > 0")
        length = F.least(F.lit(chunk_bytes), F.col("size") - F.col("offset")).cast("int").alias("length")
        return cut_up.select("rel_path", *shape, part, length, F.col("bytes").alias("buf"))
    # The first bytes of a chunk also go to the chunk before it.
    own = F.struct(F.col("chunk_idx"), F.lit(0).alias("role"), F.col("offset"), F.col("bytes"))
    ahead = F.struct((F.col("chunk_idx") - 1).alias("chunk_idx"), F.lit(1).alias("role"), F.lit(None).cast("bigint").alias("offset"),
                     F.substring("bytes", 1, reach - 1).alias("bytes"))
    dealt = (as_chunks(src, chunk_bytes).filter("size > 0").select("rel_path", "size", F.explode(F.when(F.col("chunk_idx") > 0, F.array(own, ahead)).otherwise(F.array(own))).alias("c"))
             .select("rel_path", "size", "c.*").withColumn("part", F.expr(f"chunk_idx div {TOGETHER}L")).repartition("rel_path", "part"))
    met = dealt.groupBy("rel_path", "part", "size", "chunk_idx").agg(
        F.max("offset").alias("offset"), F.max(F.when(F.col("role") == 0, F.octet_length("bytes"))).alias("length"),
        F.expr("listagg(bytes, X'') WITHIN GROUP (ORDER BY role)").alias("buf"))
    return met.select("rel_path", *shape, "part", "length", "buf")


def _parts_of(src: DataFrame, chunk_bytes: int) -> DataFrame:
    """(rel_path, part) of the source files."""
    last = F.expr(f"sequence(0L, (size - 1) div {chunk_bytes * TOGETHER}L)")
    return file_sizes(src).filter("size > 0").select("rel_path", F.explode(last).alias("part"))


def _matches_of(row, reach, bases):
    """Match positions of one chunk row. `bases` keeps the basis of the file at hand for its next chunk."""
    if row.rolls is None or len(row.rolls) == 0:
        none = np.empty(0, dtype="int64")
        return none, none, MIN_BLOCK, -1, 0, -1
    width = int(row.block_size)
    if width > reach:
        raise ValueError(f"block size {width} of {row.rel_path} is above the reach of {reach} bytes")
    n = len(row.rolls)
    basis = int(row.basis_size)
    tail_len = basis % width
    tail_idx = n - 1 if tail_len else -1
    full = n - 1 if tail_len else n
    tail_at = int(row.src_size) - tail_len - int(row.start)
    if row.rel_path not in bases:
        bases.clear()
        bases[row.rel_path] = rolling.Basis(np.asarray(row.rolls[:full], dtype="int64"), list(row.strongs[:full]))
    pos, idx = rolling.chunk_matches(
        row.buf, int(row.length), width, bases[row.rel_path], tail_len, row.strongs[-1] if tail_len else b"", tail_idx, tail_at)
    return pos, idx, width, tail_idx, tail_len, tail_at


FOUND = ("rel_path string, src_size bigint, n_chunks bigint, chunk_idx bigint, start bigint, length int, width int, tail_idx int, "
         "tail_len int, pos array<int>, idx array<int>, starts array<int>, exits array<int>")


def _find(reach):
    """Matches of every chunk, and where a walk leaves it for every place it may enter at. The bytes
    stay behind."""
    def find(batches):
        bases = {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                pos, idx, width, tail_idx, tail_len, tail_at = _matches_of(row, reach, bases)
                starts = to = None
                if 0 < len(pos) and row.chunk_idx < row.n_chunks - 1:
                    starts, to = rolling.exits(pos, width, int(row.length), tail_at, tail_len)
                out.append((row.rel_path, row.src_size, row.n_chunks, row.chunk_idx, row.start, row.length, width, tail_idx, tail_len,
                            pos.astype("int32"), idx.astype("int32"), starts, to))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])
    return find


def _walk(batches):
    cols = ["rel_path", "src_offset", "block_idx", "offset", "length"]
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            start, length, width, at = int(row.start), int(row.length), int(row.width), int(row.entry)
            for p, b, n in rolling.walk(row.pos, row.idx, width, row.tail_idx, int(row.tail_len), at, length):
                if p > at:
                    out.append((row.rel_path, start + at, -1, 0, p - at))
                out.append((row.rel_path, start + p, b, b * width, n))
                at = p + n
            if at < length:
                out.append((row.rel_path, start + at, -1, 0, length - at))
        yield pd.DataFrame(out, columns=cols)


def match_lengths(src: DataFrame, sig: DataFrame, chunk_bytes=CHUNK, reach=MAX_BLOCK, unsigned=True) -> DataFrame:
    """`match_blocks` without the literal bytes: what is copied from where, and how much is not.

    The bytes of the source move once, dealt by file and part, so that a large file is matched by many
    tasks; the signature of its basis goes to each of its parts. Positions of matches are written as a
    table. A chunk does not know where the walk enters it: its exits for all entries are chained over
    the file in runs of chunks, and the walk then goes over positions alone. With `unsigned=False` files
    without a signature have no ops.
    """
    if chunk_bytes < reach:
        raise ValueError("chunks must not be shorter than the reach of a block")
    guide = sig.join(_parts_of(src, chunk_bytes), "rel_path")
    # The hash join holds the signatures of a task and lets the bytes stream by unsorted.
    met = _source_chunks(src, chunk_bytes, reach).join(guide.hint("shuffle_hash"), ["rel_path", "part"], "left" if unsigned else "inner")
    found = cut(met.mapInPandas(_find(reach), FOUND))
    several = found.filter("n_chunks > 1").select("rel_path", F.col("chunk_idx").alias("idx"), F.col("n_chunks").alias("n"), "starts", "exits")
    entries = chain_entries(several).select("rel_path", F.col("idx").alias("chunk_idx"), "entry")
    walked = found.drop("starts", "exits").join(entries, ["rel_path", "chunk_idx"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    return walked.mapInPandas(_walk, "rel_path string, src_offset bigint, block_idx int, offset bigint, length int")


def with_literals(ops: DataFrame, src: DataFrame, chunk_bytes=CHUNK) -> DataFrame:
    """Ops with their literal bytes, cut out of the source by JVM functions. Literals end at chunk
    borders, so those of a chunk are gathered, and its bytes are opened once for all of them."""
    wanted = (ops.filter("block_idx < 0").groupBy("rel_path", F.expr(f"src_offset div {chunk_bytes}L").alias("chunk_idx"))
              .agg(F.collect_list(F.struct("src_offset", "length")).alias("ranges")))
    chunks = as_chunks(src, chunk_bytes).select("rel_path", "chunk_idx", F.col("offset").alias("start"), "bytes")
    literals = (chunks.join(wanted.hint("shuffle_hash"), ["rel_path", "chunk_idx"])
                .select("rel_path", "start", "bytes", F.explode("ranges").alias("r"))
                .select("rel_path", "r.src_offset", F.lit(-1).alias("block_idx"), F.lit(0).cast("bigint").alias("offset"), "r.length",
                        F.substring("bytes", (F.col("r.src_offset") - F.col("start") + 1).cast("int"), F.col("r.length")).alias("literal")))
    return ops.filter("block_idx >= 0").withColumn("literal", F.lit(None).cast("binary")).unionByName(literals)


def match_blocks(src: DataFrame, sig: DataFrame, chunk_bytes=CHUNK, reach=MAX_BLOCK) -> DataFrame:
    """Exact greedy delta of every source file against the signature of its basis.

    At each position the window is looked up among the basis blocks; a hit becomes a copy op
    (lowest block) and the walk jumps behind it, otherwise one byte goes to the literal. Ops are
    ordered by `src_offset`. Literals end at chunk borders, so no op is larger than a chunk.
    Files without basis are all literal.
    """
    return with_literals(cut(match_lengths(src, sig, chunk_bytes, reach)), src, chunk_bytes)


def numbered(ops: DataFrame) -> DataFrame:
    """Ops with their number within the file in `seq`."""
    order = W.partitionBy("rel_path").orderBy("src_offset")
    return ops.withColumn("seq", F.row_number().over(order) - 1)


def delta_stats(ops: DataFrame) -> DataFrame:
    """Matched blocks, literal bytes and the share of bytes that need not travel, per file."""
    literal = F.coalesce(F.sum(F.when(F.col("block_idx") < 0, F.col("length"))), F.lit(0)).cast("bigint")
    return (ops.groupBy("rel_path")
            .agg(F.count_if(F.col("block_idx") >= 0).alias("matched_blocks"), literal.alias("literal_bytes"),
                 F.sum("length").cast("bigint").alias("bytes"))
            .withColumn("saved_ratio", 1 - F.col("literal_bytes") / F.col("bytes")))


# Rebuilt chunks whose copies from one basis chunk are gathered in one row.
SPREAD = 64


def rebuild_chunks(ops: DataFrame, basis: DataFrame, chunk_bytes=CHUNK) -> DataFrame:
    """The chunks of the rebuilt files (rel_path, size, chunk_idx, offset, bytes) from ops and basis.

    Ops are cut where chunks end, those of the result and, for copies, those of the basis. A copy then
    meets one basis chunk in an equi-join on (rel_path, chunk), and all pieces of a rebuilt chunk meet
    in one group. So no row and no group holds a file. The copies out of a basis chunk are gathered in
    rows of at most SPREAD result chunks, so that a chunk is opened few times, however often it is used.
    """
    at, end = F.col("src_offset"), F.col("src_offset") + F.col("length")
    lo = F.greatest(at, F.col("chunk_idx") * chunk_bytes)
    hi = F.least(end, (F.col("chunk_idx") + 1) * chunk_bytes)
    cut_up = (ops.withColumn("chunk_idx", F.explode(F.expr(f"sequence(src_offset div {chunk_bytes}L, (src_offset + length - 1) div {chunk_bytes}L)")))
              .withColumns({"lo": lo, "n": hi - lo}).withColumn("skip", F.col("lo") - at))
    literals = cut_up.filter("block_idx < 0").select(
        "rel_path", "chunk_idx", F.col("lo").alias("at"), F.substring("literal", (F.col("skip") + 1).cast("int"), F.col("n").cast("int")).alias("piece"))
    # Where a copy begins and ends in the basis; it is cut again at the borders of basis chunks.
    first, behind = F.col("offset") + F.col("skip"), F.col("offset") + F.col("skip") + F.col("n")
    copies = (cut_up.filter("block_idx >= 0").withColumns({"first": first, "behind": behind})
              .withColumn("basis_idx", F.explode(F.expr(f"sequence(first div {chunk_bytes}L, (behind - 1) div {chunk_bytes}L)")))
              .withColumn("b", F.greatest("first", F.col("basis_idx") * chunk_bytes))
              .withColumn("m", F.least("behind", (F.col("basis_idx") + 1) * chunk_bytes) - F.col("b"))
              .select("rel_path", "basis_idx", F.expr(f"chunk_idx div {SPREAD}L").alias("spread"), "chunk_idx",
                      (F.col("lo") + F.col("b") - F.col("first")).alias("at"), (F.col("b") - F.col("basis_idx") * chunk_bytes).alias("skip"), "m"))
    gathered = copies.groupBy("rel_path", "basis_idx", "spread").agg(F.collect_list(F.struct("chunk_idx", "at", "skip", "m")).alias("copies"))
    read = (as_chunks(basis, chunk_bytes).select("rel_path", F.col("chunk_idx").alias("basis_idx"), "bytes")
            .join(gathered.hint("shuffle_hash"), ["rel_path", "basis_idx"])
            .select("rel_path", "bytes", F.explode("copies").alias("c"))
            .select("rel_path", "c.chunk_idx", "c.at", F.substring("bytes", (F.col("c.skip") + 1).cast("int"), F.col("c.m").cast("int")).alias("piece")))
    rebuilt = (read.unionByName(literals).groupBy("rel_path", "chunk_idx")
               .agg(F.expr("listagg(piece, X'') WITHIN GROUP (ORDER BY at)").alias("bytes")))
    # Sizes go to the chunks, not chunks to their file's size.
    sizes = (ops.groupBy("rel_path").agg(F.max(F.col("src_offset") + F.col("length")).alias("size"))
             .withColumn("chunk_idx", F.explode(F.expr(f"sequence(0L, (size - 1) div {chunk_bytes}L)"))))
    return rebuilt.join(sizes, ["rel_path", "chunk_idx"]).select("rel_path", "size", "chunk_idx", (F.col("chunk_idx") * chunk_bytes).alias("offset"), "bytes")


def apply_delta(ops: DataFrame, basis: DataFrame, chunk_bytes=CHUNK) -> DataFrame:
    """(rel_path, content) of rebuilt files that fit into one value; see `rebuild_chunks` for others."""
    return whole_content(rebuild_chunks(ops, basis, chunk_bytes))
