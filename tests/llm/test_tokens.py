"""Tokens of distinct words, alignment of two tokenizers and hard negatives against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from brute import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import alignment, byte_words, hard_negatives, word_ids
from driftline.llm.bpe import piece_table
from driftline.llm.queries import BYTE_BPE, BYTE_RANKS, ORACLES, PIECE_BPE, QUERIES, WORD_BPE

PATTERN = public_tokenizers.PATTERN
NASTY = ["a<|endoftext|>b <|endoftext|>", "tab\tand\x0bvertical\x1fcontrol\xa0nbsp  two", "12 345,67 x1y2", " lead and trail ", "''s 's 't we'll",
         "a  b\n\n c \n ", " \n ", "日本語 テスト 😀", "a b 　 c", "x" * 5000 + " " + "é" * 3000, "\x00a b\x00",
         "▁x y", "x▁ y", "<s> </s> <unk> <0x0A>", "naïve café\r\n x", " ", "  x", "  z"]


def test_byte_words_equal_the_library(make, odd_rows, monkeypatch):
    monkeypatch.setattr(byte_words, "CHUNK", 20_000)
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(NASTY)] + [(200 + k, prose(k % 3, 400)) for k in range(12)]
    got = byte_words.encode_and_decode(make(rows).repartition(3), BYTE_RANKS, PATTERN, repeatable=False).collect()
    tok = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_words.read_ranks(BYTE_RANKS), special_tokens={})
    want = []
    for i, text in rows:
        ids = tok.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_byte_words_of_equal_partitions_and_empty_tables(make, spark, tmp_path):
    path = str(tmp_path / "docs")
    for _ in range(3):
        make([(1, "same words here"), (2, "same again")]).coalesce(1).write.mode("append").parquet(path)
    docs = spark.read.option("maxPartitionBytes", 1).parquet(path)
    got = Counter(r.doc_id for r in byte_words.encode_and_decode(docs, BYTE_RANKS, PATTERN).collect())
    assert got == {1: 3, 2: 3}
    assert byte_words.encode_and_decode(docs.filter("doc_id > 5"), BYTE_RANKS, PATTERN).count() == 0


def test_byte_words_fail_where_rows_change(make):
    other = F.udf(lambda t: f"{t} {random.SystemRandom().random()}").asNondeterministic()
    docs = make([(k, prose(k, 20)) for k in range(50)]).withColumn("text", other("text"))
    with pytest.raises(Exception, match="read differently|missing"):
        byte_words.encode_and_decode(docs, BYTE_RANKS, PATTERN).collect()


def aligned(rows):
    """The result of every row by plain merging of ends over whole texts."""
    a_tok = Tokenizer.from_file(BYTE_BPE)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a_bytes = piece_table(BYTE_BPE)
    pieces = [b_tok.id_to_piece(i) for i in range(b_tok.get_piece_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    found, count = [], Counter()
    for i, text in rows:
        text = text or ""
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(a_bytes[k] for k in a) != whole or b"".join(b_bytes[k] for k in b) != whole:
            found.append((i, None))
            continue
        ends = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            at = 0
            ends.append({(at := at + len(table[k])): n for n, k in enumerate(ids)})
        groups, links, x, y = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][e] + 1, ends[1][e] + 1
            links.append((a[p - 1], b[q - 1]))
            groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            x, y = p, q
        count.update(links)
        found.append((i, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if r is None else
            (i, *r[:3], len(r[3]), sum(count[x] == top[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) for i, r in found]


def test_alignment_equals_plain_merging(make, odd_rows, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 20_000)
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(NASTY)] + [(200 + k, prose(k % 3, 300)) for k in range(12)]
    rows += [(300 + k, "The quick brown fox isn't jumping; größer, más rápido, déjà vu? " * 20) for k in range(4)]
    docs = make(rows).withColumns({"a": F.lit(1), "chunk": F.lit("x"), "n": F.lit(None)}).repartition(3)
    got = alignment.align(docs, BYTE_BPE, PIECE_BPE)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.select(names).collect()), key=key) == sorted(aligned(rows), key=key)
    assert alignment.align(docs.filter("doc_id > 9999"), BYTE_BPE, PIECE_BPE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_diagonal_runs(seed):
    r = random.Random(seed)
    common = sorted(r.sample(range(1, 3000), 200))
    own = [np.array(sorted({*common, *r.sample(range(1, common[-1]), r.choice([0, 20, 600]))})) for _ in "ab"]
    odd, (x, y), want = alignment.diagonal_groups(*own), (0, 0), []
    for e in sorted(set(own[0].tolist()) & set(own[1].tolist())):
        p, q = (int(np.searchsorted(o, e)) + 1 for o in own)
        if (p - x, q - y) != (1, 1):
            want.append((x, p, y, q))
        x, y = p, q
    assert odd == want


def mined(rows, cfg, is_anchor):
    """(anchor, positive, rank, negative, scores) by scoring every pair of distinct rows."""
    rows = sorted({(i, label, tuple(q)) for i, label, q in rows if None not in (i, label, q)})
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        best = sorted(((-score(a, b), b[0]) for b in rows if b[0] != a[0] and b[1] == a[1]))[:cfg.positives]
        for p, positive in best:
            p = -p
            fit = sorted((-s, b[0]) for b in rows if b[1] != a[1] and b[0] != a[0]
                         and cfg.low * p <= 100 * (s := score(a, b)) <= cfg.high * p)[:cfg.negatives]
            out += [(a[0], positive, n + 1, negative, p, -s) for n, (s, negative) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives(spark, make, monkeypatch, seed):
    make([])
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    r = random.Random(seed)
    # Small components make many ties; a label with a third of the rows; repeated rows; short and empty vectors.
    rows = [(k, r.choice([0, 0, 1, 2, 3]), [r.randint(-4, 4) for _ in range(6)]) for k in range(240)]
    rows += [(k, *rows[k][1:]) for k in (0, 10, 11)] + [(500, 1, []), (510, 2, [3]), (520, None, [1]), (None, 1, [1] * 6), (530, 1, None), (540, 9, [2] * 6)]
    table = spark.createDataFrame(rows, "id bigint, label int, q array<int>").withColumn("key", F.lit("x")).repartition(4)
    got = hard_negatives.hard_negatives(table, F.col("id") % 10 == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, hard_negatives.Mining(), lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.select(names).collect())) == want and len(want) > 100
    assert hard_negatives.hard_negatives(table.filter("id < 0"), F.col("id") % 10 == 0).count() == 0


def test_threshold_stops_early():
    r = np.random.default_rng(1)
    q = r.integers(-100, 101, (4000, 2))
    q[17] = [1000, -1000]
    lists, met = hard_negatives.Lists(np.arange(4000), q), []
    plain = lists.score
    lists.score = lambda rows, a: met.append(len(rows)) or plain(rows, a)
    (found,), _ = hard_negatives.threshold_search(lists, np.array([3, -2]), np.ones(4000, bool), [(None, 1 << 60, 1)])
    assert found.tolist() == [17] and sum(met) < 100


def test_components_become_whole(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.5, -0.001],), ([nan, 1.0],), ([inf],), ([None, 1.0],), (None,), ([],), ([1e30, -1e30],)]
    got = [r.q for r in spark.createDataFrame(rows, "v array<float>").select(hard_negatives.whole_components(F.col("v")).alias("q")).collect()]
    assert got == [[128, -1], None, None, None, None, [], [1 << 25, -(1 << 25)]]


def test_hard_negatives_query_equals_its_sql(spark, make, tmp_path):
    make([])
    r = np.random.default_rng(3)
    rows = [(k, None if k % 31 == 0 else int(k % 10), [float("nan")] * 8 if k % 37 == 1 else None if k % 41 == 1 else r.normal(0, 0.3, 8).tolist()) for k in range(400)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLES["op12_hard_negatives"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_a_worker_opens_a_tokenizer_once():
    """Tasks of a worker share the open file and its tables; what a task has learned is its own."""
    import pickle

    import public_tokenizers

    from driftline.llm import packing, word_ids

    path = public_tokenizers.path("word_bpe_49k.json")
    first = word_ids.WordIds(path, word_ids.bare_words, spaced=False)
    want = first.of_texts(["One word, two words.", "", "l\u00f6we 12x"])
    second = pickle.loads(pickle.dumps(first))
    assert not second.known and second.of_texts(["One word, two words.", "", "l\u00f6we 12x"]) == want
    assert first.tok is second.tok and first.border is second.border
    assert packing.sentence_ends(path) is packing.sentence_ends(path)


@pytest.mark.parametrize("path, split, spaced", [(WORD_BPE, word_ids.bare_words, False), (BYTE_BPE, word_ids.SPACED.findall, True)])
def test_words_are_encoded_without_their_places(path, split, spaced):
    """Ids of words come from the calls that keep no offsets, joined and one by one, and are those of the plain call."""
    tok = word_ids.open_tokenizer(path)

    class FastOnly:
        encode_batch_fast = tok.encode_batch_fast

    ids = word_ids.WordIds(path, split, spaced)
    ids._open()
    ids.tok = FastOnly()
    texts = [prose(3, 800), "x1 y_2 émigré, naïve! Straße 東京 \U0001f600 áb", " two  spaces\n\nend. ", ""]
    for t, got in zip(texts, ids.of_texts(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
