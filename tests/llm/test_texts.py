"""Packing, BPE, fingerprints, rules, personal data and secrets against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import pii_spans, prose, secret_spans, sha, words, written
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import bpe, fingerprint, packing, pii, quality_rules, secret_scan
from driftline.llm.queries import BYTE_BPE, WORD_BPE

NASTY = ["it's THE end; isn't it?  Yes!\n\nNo...", "a<|endoftext|>b <|endoftext|>", "tab\tand\x0bvertical\x1fcontrol\xa0nbsp  two",
         "12 345,67 x1y2", " lead and trail ", "İstanbul ΣΑΣ ﬁ é", "　wide line", "don't we'll I'M", "''s 's", "!?.,;: a, b. c!"]


def library(path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_packing_covers_every_id_once(make, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None] + [(100 + k, t) for k, t in enumerate(NASTY)]
    docs = make(rows).coalesce(2)
    got = packing.pack(docs, WORD_BPE, packing.PackConfig(length=256, stride=16, block=4096)).collect()
    tok = library(WORD_BPE)
    want = {}
    for i, t in rows:
        want.setdefault(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    pieces, sequences = {}, {}
    for r in got:
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.length == len(ids) > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    copies = {i: sum(1 for j, _ in rows if j == i) for i in want}
    for i, ids in want.items():
        assert sum(n for _, n in pieces[i]) == copies[i] * len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(len(want[i]) for i, _ in rows)
    padded = sum(packing.padding(sum(n for _, n in p), 256) for p in sequences.values())
    assert padded < 0.05 * total


def test_packing_plan_is_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, length = 60, 16
        cost = np.where(rng.random(n + 1) < 0.3, rng.integers(0, 3, n + 1), 9)
        best = [0.0] + [1e9] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + length - (j - i) for i in range(max(0, j - length), j)) + cost[j]
        cuts = packing.plan_cuts(list(range(1, n + 1)), cost[1:].tolist(), length, n)
        sizes = np.diff([0, *cuts])
        assert cuts[-1] == n and sizes.max() <= length
        assert sum(length - s for s in sizes) + sum(cost[c] for c in cuts) == best[n]


def test_packing_tail_needs_no_padding(make):
    got = packing.pack(make([(1, prose(3, 700))]).coalesce(1), WORD_BPE).collect()
    sizes = {}
    for r in got:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    last = sizes[max(sizes)]
    assert last & (last - 1) == 0


def test_bpe_round_trip(make, odd_rows):
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(NASTY)]
    tok = library(BYTE_BPE)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.encode_and_decode(make(rows), BYTE_BPE).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_chunks_meet(make, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 200)
    rows = [(k, prose(k, 30)) for k in range(40)]
    tok = library(BYTE_BPE)
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in bpe.encode_and_decode(make(rows), BYTE_BPE).collect()} == want


def test_bpe_of_unrepeatable_and_repeated_rows(make):
    rows = [(1, "same text"), (1, "same text"), (2, "other text")]
    want = sorted((i, len(library(BYTE_BPE).encode(t, add_special_tokens=False).ids)) for i, t in rows)
    for docs in (make(rows).repartition(3, "text"), make([(1, "same text")]).unionAll(make([(1, "same text")])).unionAll(make([(2, "other text")]))):
        for repeatable in (True, False):
            got = bpe.encode_and_decode(docs, BYTE_BPE, repeatable).collect()
            assert sorted((r.doc_id, r.n_tokens) for r in got) == want
    assert bpe.encode_and_decode(make([]), BYTE_BPE).count() == 0


def test_varints_round_trip():
    v = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 31) - 1])
    assert bpe.read_varints(np.frombuffer(bpe.varints(v), np.uint8)).tolist() == v.tolist()
    assert bpe.varints(np.zeros(0, int)) == b"" and len(bpe.read_varints(np.zeros(0, np.uint8))) == 0


def edited(rows):
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i))
    text = {i: t or "" for i, t in rows}
    after = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    for i, t in rows:
        t = t or ""
        yield i, t, t[:len(t) - len(t) // 2] + text[after[i]][:len(t) // 2]


def test_fingerprints(make, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None] + [(20, "A first clause, a second one. A third.\nNext line."), (21, "Other, words. Here.")]
    got = fingerprint.compare_edits(make(rows)).collect()
    assert len(got) == len(rows)
    want = {(i, len(t), sha(e)) for i, t, e in edited(rows)}
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == want
    by_text = {}
    text = {i: t or "" for i, t in rows}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (sha(text[r.doc_id]) == r.edited_sha256)
    assert len(set(by_text.values())) == len(by_text)


def plain_likeness(a, b):
    """Two fingerprints compared from the top down with bags of branches, and the clauses left of the first."""
    def bags(branches):
        keys = [re.split("[{(]", x)[0] for x in branches]
        return Counter(branches), Counter(zip(["", *keys], keys))

    def characters(found):
        return sum(n * int(re.split("[{(]", x if isinstance(x, str) else x[1])[0].split(":")[1]) for x, n in found.items())

    sides, shared, total = [[x.split("|")[1]] for x in (a, b)], 0, None
    for kind in (r"[0-9a-f]+:\d+\{[^}]*\}", r"[0-9a-f]+:\d+\([^)]*\)", r"[0-9a-f]+:[0-9]+(?![0-9({])"):
        sides = [[y for x in side for y in re.findall(kind, x)] for side in sides]
        (x, xo), (y, yo) = map(bags, sides)
        total = characters(x) + characters(y) if total is None else total
        shared += characters(x & y) + characters(xo & yo)
        sides = [left(p, q) for p, q in ((sides[0], y), (sides[1], x))]
    like = 1.0 if a.split("|")[0] == b.split("|")[0] else min(1.0, shared / total) if total else 0.0
    return like, sides[0]


def left(branches, others):
    """Branches that the others have less often: in their order if all are different, else sorted."""
    if len(set(branches)) < len(branches):
        branches = sorted(branches)
    seen, out = Counter(), []
    for x in branches:
        seen[x] += 1
        if seen[x] > others[x]:
            out.append(x)
    return out


def prints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return {r.k: r.f for r in rows.select("k", fingerprint.fingerprint(F.col("t")).alias("f")).collect()}


def test_likeness_goes_down_the_tree(spark):
    r = random.Random(2)
    line = lambda: ". ".join(prose(r.randrange(40), r.randrange(1, 6)) for _ in range(r.randrange(1, 5)))
    long = [line() for _ in range(60)]
    texts = ["A\n" * 1000, "A\n" * 500, "\n".join(long), "\n".join(long[::-1]), "\n".join(long[:30] + [line()] + long[31:]), "\n".join(long[:30]),
             "", "x", "One here. Two here.\nThree here. Four here.", "One here. Two here.\nThree HERE. Four here.", "b, a, c", "a, b, c", "\n\n"]
    f = prints(spark, texts)
    pairs = spark.createDataFrame([(i, j, f[i], f[j]) for i in f for j in f], "i int, j int, a string, b string")
    got = {(x.i, x.j): (x.near, x.near_left) for x in fingerprint.compare(pairs.withColumn("near_left", F.lit("clash")).drop("near_left"), "a", "b", "near").collect()}
    for (i, j), (near, left) in got.items():
        like, rest = plain_likeness(f[i], f[j])
        assert near == pytest.approx(like) and sorted(left) == sorted(rest), (i, j)
        assert (near == 1.0) == (texts[i] == texts[j]) and near == pytest.approx(got[j, i][0])
    # Repeated lines and order count; an edited line costs little and is found.
    assert got[0, 1][0] == pytest.approx(2 / 3, abs=0.01) and len(got[0, 1][1]) == 500
    assert got[2, 3][0] < 0.8 and 0.8 < got[2, 4][0] < 1 and [x.split(":")[1] for x in got[8, 9][1]] == ["12"]


def test_fingerprint_is_a_tree_of_full_hashes(spark):
    """Every node is the hash of its children's full hashes, computed here bottom-up."""
    text = "One here. Two here.\nThree, four.\n\n" + "\n".join(prose(k, 8) for k in range(30))
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = [[]]
    for p in text.split("\n"):
        clauses = [(h(c), len(c)) for c in re.split(r"(?<=[.!?;:,]\s)|(?<=[。！？，])", p)]
        full = h("".join(x for x, _ in clauses))
        sections[-1].append((full, f":{len(p)}(" + ",".join(f"{x[:fingerprint.LEAF]}:{n}" for x, n in clauses) + ")", len(p)))
        if int(full[0], 16) % fingerprint.SECTION == 0:
            sections.append([])
    n = fingerprint.NODE
    tops = [(h("".join(x[:n] + below + x[n:] + "~" for x, below, _ in s)), s) for s in sections if s]
    written = "".join(f"{x[:n]}:{sum(c for *_, c in s)}{{" + "".join(y[:n] + below for y, below, _ in s) + "}" for x, s in tops)
    assert prints(spark, [text])[0] == h("".join(x for x, _ in tops)) + "|" + written


def test_edits_of_empty_and_clashing_tables(spark, make):
    docs = make([(1, "a b"), (2, None), (2, "c"), (None, "d")]).withColumns({"key": F.lit(1), "n": F.lit(2), "begin": F.lit("x")})
    assert fingerprint.compare_edits(docs).count() == 4
    assert fingerprint.compare_edits(docs.filter("doc_id > 9")).count() == 0


def plain_rules(text):
    w = words(text)
    spans = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    covered = {p for i, s in enumerate(spans) if spans.count(s) > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup = sum(1 for k, x in enumerate(lines) if x in lines[:k])
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


def test_rules(make, odd_rows):
    repeated = " ".join(["a b c d e f g h i"] * 5)
    rows = [r for r in odd_rows if r[0] != 5] + [(30, repeated), (31, "x y\nx y\n\nz\nx y"), (32, "# * $ a|b <c>"), (33, prose(1, 50) + " " + prose(1, 12))]
    got = quality_rules.apply_rules(make(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for i, t in rows:
        m = plain_rules(t)
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want.append((i, *m, failed))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    assert all(not r.kept for r in got if r.base_failed)


def test_rules_of_bad_hosts(make, spark):
    noisy = prose(2, 30) + " ### $$$ %%% &&& ### $$$ %%% &&& ### $$$ %%% &&&"
    rows = [(3 * k, noisy) for k in range(40)] + [(3 * k + 1, prose(k, 40)) for k in range(40)] + [(3, prose(9, 40)), (4, noisy)]
    docs = make(rows)
    kept = {(r.doc_id, r.n_symbols > 0): r.kept for r in quality_rules.apply_rules(docs).collect()}
    assert not kept[6, True] and kept[3, False] and kept[4, True] and kept[7, False]
    left = quality_rules.reject_by_rules(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([3, 4] + [3 * k + 1 for k in range(40)])


PERSONAL = ["mail a.b@c-d.example.com, x@y and @z.w", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112",
            "+1 (222) 333-4444 or +44 20 7946 0958 ext +1", "a@b.cc@d.ee", "1" * 40, "9" * 4000 + ".1.1.1", "a" * 20000 + "@", "++49 30 123456 "]


def test_personal_data(make, odd_rows):
    rows = odd_rows + [(200 + k, t) for k, t in enumerate(PERSONAL)]
    got = pii.find_personal_data(make(rows), {}).collect()
    want = []
    for i, t in rows:
        s = pii_spans(t)
        n = [sum(1 for k, _, _ in s if k == kind) for kind in ("email", "ip", "card", "phone")]
        want.append((i, *n, sha(written(s)), written(s)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_personal_data_is_bootstrapped(make):
    rows = [(k, f"{prose(k, 6)} passenger contact: person{k}@mail.example.com {prose(k + 500, 6)}") for k in range(40)]
    rows += [(100, f"{prose(1, 5)} passenger contact: ZX81-99Q {prose(2, 5)}"), (101, f"{prose(3, 5)} flight number: ZX81-99R {prose(4, 5)}")]
    docs = make(rows)
    patterns = pii.learn_patterns(docs)
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs, patterns).collect()}
    assert "found:" in found[100] and "found:" not in found[101] and found[5].startswith("email:")


def test_all_context_patterns_are_kept(make):
    def name(k):
        return "".join(chr(97 + k // 26 ** j % 26) for j in range(4))
    rows = [(j, " ".join(f"{name(k)} p{k}x{j}@m.cc" for k in range(20_100))) for j in range(6)]
    long = "w" * 200
    rows += [(10 + j, f"rare: q{j}@m.cc {long} r{j}@m.cc") for j in range(5)]
    got = pii.learn_patterns(make(rows))
    assert "L rare:" in got and f"L {long}" in got and f"L {name(20_099)}" in got


SECRETS = ["password = hunter22 passwd:abc", "Api_Key: \"abcdef.ghi-jk\" TOKEN=12345", "AKIA" + "A1" * 8 + " AKIA123", "deadbeef" * 4, "a" * 23,
           "secret=ſecret token == x"]


def test_secrets(make, odd_rows):
    rows = odd_rows + [(300 + k, t) for k, t in enumerate(SECRETS)]
    docs = make(rows)
    got = secret_scan.scan_secrets(docs, secret_scan.Scanner(secret_scan.build_dictionary(docs))).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: str(tuple(r))), sorted(rows, key=str), strict=True):
        pass
    base = {(r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got}
    want = set()
    for i, t in rows:
        s = secret_spans(t)
        want.add((i, sha(written(s)), *[sum(1 for k, _, _ in s if k == kind) for kind in ("assign", "access", "hex")]))
    assert base == want


def test_secrets_by_novelty(make):
    key = "Zk9/Qw7xT2pLm4VbN8cRd5YhJ3"
    rows = [(1, f"{prose(1, 30)} the private key is {key} {prose(2, 30)}"), (2, f"{prose(3, 30)} the number is {key} {prose(4, 30)}"),
            (3, f"credential abc123abc123abc123 {'abc123abc123abc123 ' * 20}")]
    docs = make(rows)
    scanner = secret_scan.Scanner(secret_scan.build_dictionary(docs))
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(docs, scanner).collect()}
    at = rows[0][1].index(key)
    assert got[1] == f"novel:{at}:{at + len(key)}" and got[2] == "" and got[3] == ""
    masked = {r.doc_id: r for r in secret_scan.mask_secrets(docs, scanner).collect()}
    assert key not in masked[1].text and "[SECRET]" in masked[1].text and masked[1].n_chars == len(masked[1].text)
    assert masked[2].text == rows[1][1] and masked[3].text == rows[2][1]


def test_repeated_secrets_stay_novel(make):
    one, two = "Zk9/Qw7xT2pLm4VbN8cRd5YhJ3", "t7Gh2KsPq9Xw4Lb8Nz6Vc1Jd5Ry"
    twice = f"the private key is {one} {prose(1, 30)} private key {one} {prose(2, 9)} then {one}"
    pair = f"the bearer is {one} {prose(3, 30)} the credential is {two} {prose(4, 30)}"
    docs = make([(1, twice)] + [(10 + k, pair) for k in range(30)] + [(50 + k, f"{pair} {prose(60 + k, 9)}") for k in range(30)])
    dictionary = secret_scan.build_dictionary(docs)
    assert one.encode() not in dictionary and two.encode() not in dictionary
    scanner = secret_scan.Scanner(dictionary)
    got = {r.doc_id: r.spans.split(",") for r in secret_scan.scan_secrets(docs, scanner).collect()}
    at, again = twice.index(one), twice.index(one, twice.index(one) + 1)
    assert got[1] == [f"novel:{x}:{x + len(one)}" for x in (at, again)]
    assert all(got[i] == [f"novel:{pair.index(x)}:{pair.index(x) + len(x)}" for x in (one, two)] for i in (10, 50))


def test_secrets_need_no_digits(make):
    keys = ["QwZkxTpLmRvBnHcYdJsG", "kXwQzRtYpLmVbNcHdJ7f"]
    rows = [(k, f"{prose(k, 200)} the bearer is {key} {prose(k + 50, 200)}") for k, key in enumerate(keys)]
    plain = "The responsibilities of the team and its communication were described in the documentation of this organisation. "
    rows.append((9, plain * 2 + "A private key is administration and documentation-communication of responsibilities. " + plain))
    docs = make(rows)
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(docs, secret_scan.Scanner(secret_scan.build_dictionary(docs))).collect()}
    for (k, text), key in zip(rows, keys):
        assert got[k] == f"novel:{text.index(key)}:{text.index(key) + len(key)}"
    digitless = make([(k, f"the bearer is {keys[0]} ordinary {prose(k, 4)}") for k in range(3)])
    assert got[9] == "" and b"ordinary" in secret_scan.build_dictionary(digitless)


def test_ordinary_words_near_sensitive_ones():
    """Borders of words, and copies left out in linear time."""
    scanner = secret_scan.Scanner(b"")

    def novel(text):
        return [s for s in scanner.spans(text)[1] if s[0] == 3]

    assert not novel("the authors uncharacteristically wrote") and not novel("private repository github/enterprise/settings/permissions")
    key = "q8Zr2LkV9xTn4BwYc7Hs1Dfg"
    for before in ("Bearer ", "client_secret ", "private key ", "auth: ", "the pwd is "):
        assert novel(f"{before}{key} and more"), before
    words = {f"w{k}" for k in range(50_000)} | {"has" + key, key, key[:-1]}
    left = secret_scan.without_copies(words, {key, *[f"x{k}y" for k in range(50_000)]})
    assert len(left) == 50_001 and key not in left and key[:-1] in left


def test_long_identifiers_in_a_good_context(make):
    cfg = pii.Bootstrap()
    rows = [(k, f"{prose(k, 5)} write to member account user{k}@mail{k}.example.org please") for k in range(4 * cfg.seeds)]
    long = "acct-" + "0123456789abcdef" * 8
    docs = make([*rows, (999, f"write to member account {long} please")])
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs, pii.learn_patterns(docs)).collect()}
    assert f"found:24:{24 + len(long)}" in found[999] or f":24:{24 + len(long)}" in found[999]


def test_copies_count_once_for_the_dictionary(make):
    text = f"the private key is Zk9/Qw7xT2pLm4VbN8cRd5YhJ3 onlyhere {prose(1, 5)}"
    assert secret_scan.build_dictionary(make([(k, text) for k in range(9)])) == b""


@pytest.mark.parametrize("spans,want", [([(0, 1, 3)], "a[SECRET]d"), ([(0, 0, 2), (1, 1, 4)], "[SECRET]"), ([(0, 0, 1), (0, 3, 4)], "[SECRET]bc[SECRET]")])
def test_mask(spans, want):
    assert secret_scan.mask("abcd", spans) == want


def test_vocabularies_are_read_in_place():
    assert WORD_BPE == public_tokenizers.path("word_bpe_49k.json")
