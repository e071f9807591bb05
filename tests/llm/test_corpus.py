"""Near duplicates, learned scores, page text and the pipeline."""

import random
import time
import zlib

import numpy as np
import pytest
from brute import article, near_components, prose, shingles

import corpus_pipeline
from driftline.llm import components, html_text, near_dedup, quality_model, toxicity


def changed(text, n, seed):
    r, w = random.Random(seed), text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


def cluster(seed, size, first, words=120, most=5):
    base = prose(seed, words)
    return [(first, base)] + [(first + k, changed(base, 1 + k % most, 1000 * seed + k)) for k in range(1, size)]


def compare(make, rows, k=4):
    docs = make(rows).repartition(3)
    got = near_dedup.near_duplicates(docs, near_dedup.Near(words=k)).collect()
    comp, sizes = near_components([(i, t) for i, t in rows if i is not None], k)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], comp[r.doc_id], comp[r.doc_id] == r.doc_id), r


def test_shingles_of_odd_words():
    """Words of all lengths around a round of eight bytes and the longest that rounds take, NUL, other white space."""
    words = [c * n for n in (1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for c in ("a", "B", "b", "\0", "\u00c9", "\u00e9", "\U0001f600")]
    words += ["a\x1cb", "a\x85b", "a\xa0b", "a\u3000b", "a\0", "\0a", "abcdefghabcdefgx", "abcdefgxabcdefgh"]
    rng = np.random.default_rng(3)
    texts = [" \t\n\x0b\x0c\r"[k % 6].join(rng.choice(words, k)) + " \n" * (k % 2) for k in range(60)] + ["", " ", "x", "\n\r y"]
    texts += [texts[40].upper(), texts[40].replace(" ", "\n"), *words]
    want = [shingles(t, 3) for t in texts]
    for got in (near_dedup.Shingler(3).sets(texts), [near_dedup.Shingler(3).sets([t])[0] for t in texts]):
        assert [len(s) for s in got] == [len(s) for s in want]
        for i, x in enumerate(got):
            assert (np.diff(x.astype(object)) > 0).all()
            for j in range(i):
                assert len(np.intersect1d(x, got[j])) == len(want[i] & want[j]), (texts[i], texts[j])


def test_shingles_cost_little_more_than_words():
    """CPU time of sets and signatures against that of lower-casing and splitting (26 times before words were
    hashed together, 2.4 after)."""
    texts = [f"\u00e9 {prose(k, 500)} {' '.join(f'w{k}x{i}' for i in range(200))}" for k in range(400)]

    def seconds(f):
        best = []
        for _ in range(3):
            start = time.process_time()
            f()
            best.append(time.process_time() - start)
        return min(best)

    words = seconds(lambda: [t.lower().split() for t in texts])
    assert seconds(lambda: [near_dedup.signature(s) for s in near_dedup.Shingler(4).sets(texts)]) < 10 * words


def test_near_duplicates(make, odd_rows):
    rows = odd_rows + cluster(1, 20, 100) + cluster(2, 6, 200, 30, 1) + [(300 + k, prose(900 + k, 60)) for k in range(30)]
    # A chain: neighbours are alike, its ends are not.
    text = prose(77, 100)
    for k in range(8):
        rows.append((400 + k, text))
        text = changed(text, 2, 5000 + k)
    rows += [(500 + k, "ONE Two three FOUR five six" if k % 2 else "tiny text") for k in range(6)]
    compare(make, rows)


def test_crowded_regions(make, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    monkeypatch.setattr(near_dedup, "HUBS", 1)
    shared = prose(50, 60)
    rows = cluster(3, 60, 1000, 120, 8) + [(2000 + k, shared + " " + prose(3000 + k, 25 + k)) for k in range(30)]
    compare(make, rows)


def test_crowded_regions_keep_all_members(make, spark):
    # The nodes share the first values of one order and part at the next.
    rng = np.random.default_rng(5)
    first = rng.bytes(4 * near_dedup.DEPTH)
    n = 3 * near_dedup.CROWD
    rest = 4 * (near_dedup.HASHES - near_dedup.DEPTH)
    make([])
    nodes = spark.createDataFrame([(k, first + rng.bytes(rest)) for k in range(n)], "id bigint, sig binary")
    regions = {}
    for m in near_dedup.forest(nodes)[1].collect():
        regions.setdefault(m.key, set()).add(m.id)
    assert set(range(n)) in regions.values()


@pytest.mark.parametrize("pairwise", [0, 4096])
def test_blocks_join_components(make, spark, monkeypatch, pairwise):
    """Links of blocks are true, join what was apart, and leave nothing apart that is linked."""
    monkeypatch.setattr(near_dedup, "PAIRWISE", pairwise)
    rows = cluster(4, 30, 1, 100, 2) + [(100, prose(8, 100))]
    docs = make(rows)
    members = spark.createDataFrame([(7, i) for i, _ in rows], "key bigint, id bigint")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 16)], "id bigint, component bigint")
    mixed = near_dedup._mixed(members, labels).withColumn("total", near_dedup.F.lit(100))
    near = near_dedup.Near(words=4)
    nodes = near_dedup.shingle_table(docs, near).withColumnRenamed("doc_id", "id")
    got = {tuple(r) for r in near_dedup._crowded_links(mixed, nodes, docs, near, block=7).collect()}
    comp = {i: 1 if i < 16 else i for i, _ in rows}
    sets = {i: shingles(t, 4) for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got <= {(a, b) for a, b in linked if comp[a] != comp[b]}

    def parts(links):
        part = dict(comp)
        for _ in part:
            for a, b in links:
                part[a] = part[b] = min(part[a], part[b])
        return part
    assert parts(got) == parts(linked | got)
    # A block of 7 outsiders and 7 members joins at most 14 components: no row per pair.
    assert len(got) <= 13 * 3 * 15


def test_neighbours_over_batches():
    """Pairs and members are the same however rows come in batches."""
    import pyarrow as pa

    r = random.Random(4)
    width = near_dedup.DEEPEST - near_dedup.DEPTH
    rows = sorted((r.randrange(12), np.array([r.randrange(2) for _ in range(width)], ">u4").tobytes(), k) for k in range(90))

    def run(sizes):
        batches, at = [], 0
        while at < len(rows):
            part = rows[at:at + sizes]
            at += sizes
            batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["key", "rest", "id"]))
        return {tuple(x.values()) for b in near_dedup._neighbours(iter(batches)) for x in b.to_pylist()}

    whole = run(1000)
    assert all(run(n) == whole for n in (1, 2, 3, 7, 89))
    want = {(near_dedup.MEMBER, k, i, None, None) for k, _, i in rows if k in (rows[0][0], rows[-1][0]) or sum(x[0] == k for x in rows) > 1}
    assert {x for x in whole if x[0] == near_dedup.MEMBER} <= want
    assert {x for x in whole if x[0] == near_dedup.MEMBER} >= {x for x in want if sum(y[0] == x[1] for y in rows) > 1}
    for k in range(len(rows) - 1):
        if rows[k][0] == rows[k + 1][0]:
            a, b = rows[k], rows[k + 1]
            x, y = (np.frombuffer(z[1], ">u4") for z in (a, b))
            depth = next((n for n in range(width) if x[n] != y[n]), width) + near_dedup.DEPTH
            assert (near_dedup.PAIR, a[0], min(a[2], b[2]), max(a[2], b[2]), depth) in whole


def test_components(spark, make):
    make([])
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    part = {}
    for a, b in links:
        for x in (a, b):
            part.setdefault(x, x)

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        part[y] = x
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    alone = {a for a, b in links if a == b}
    assert {i: c for i, c in got.items()} == {i: find(i) for i in part if not (i in alone and i not in got)}


def test_merged_components(spark, make, monkeypatch):
    """Further links give what all links at once give, and only a round that changes something is run."""
    make([])
    r = random.Random(5)
    old = [(r.randrange(200), r.randrange(200)) for _ in range(90)]
    new = [(r.randrange(260), r.randrange(260)) for _ in range(70)] + [(k, k + 1) for k in range(300, 320)]

    def table(links):
        return spark.createDataFrame([x for x in links if x[0] != x[1]], "a bigint, b bigint")

    def labels(df):
        return sorted(map(tuple, df.collect()))

    for few in (0, 500_000):
        monkeypatch.setattr(components, "BROADCAST_ROWS", few)
        before = components.cut(components.components(table(old)))
        assert labels(components.merged(before, table(new))) == labels(components.components(table(old + new)))
        # Links inside a component change nothing, whatever star they hang on.
        assert labels(components.merged(before, table([(i, c) for i, c in labels(before)]))) == labels(before)
    rounds = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda *a: rounds.append(1) or star(*a))
    assert labels(components.components(table([(1, 5), (1, 7), (2, 6)]))) == [(1, 1), (2, 2), (5, 1), (6, 2), (7, 1)]
    assert not rounds


def labelled(bad_word, n=240):
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        w = prose(k, 60).split()
        if bad:
            w[k % 50] = bad_word + ("" if k % 8 else "en")
            w[(k * 7) % 50] = bad_word
        rows.append((k, " ".join(w) + "."))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_learns_words_and_beginnings(make, spark):
    rows, labels = labelled("zorgblat")
    docs = make(rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    new = make([(1, "You are a zorgblatish thing. " + prose(1, 20)), (2, prose(2, 40)), (3, None), (4, ""), (5, "You ZORGBLAT!"), (5, "You ZORGBLAT!")])
    scores = [(r.doc_id, r.score) for r in toxicity.score_toxicity(new, model).collect()]
    assert all((s >= 0.7) == (i in (1, 5)) for i, s in scores) and len(scores) == 6
    left = toxicity.reject_toxic(new, model)
    assert left.columns == new.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]


def test_toxicity_grammar():
    reader = toxicity.Reader({"idiot": 1.0}, {})
    kinds = toxicity.KINDS

    def matched(text):
        return {k for k, f in zip(kinds, reader.features(text)) if f}
    assert matched("What an idiot.") == {"plain"}
    assert matched("You complete idiot.") == {"targeted"}
    assert matched("She is not an idiot.") == {"negated"}
    assert matched("He wrote that the boss was some idiot. Fine.") == {"reported"}
    assert matched("I will kill you.") == {"threat"}
    assert matched("Kill the process.") == set()
    assert matched("No. What an id10t.") == {"plain"}


def test_reported_speech():
    """Quotations count as reported from a report to the closing quote, or where the report follows."""
    reader = toxicity.Reader({"idiot": 1.0}, {})

    def kinds(text):
        return {k for k, f in zip(toxicity.KINDS, reader.features(text)) if f}

    assert kinds('He wrote: "You are late. You idiot."') == {"reported"}
    assert kinds('"You idiot!" she said.') == {"reported"}
    assert kinds('"You are late," he said. You idiot!') == {"targeted"}
    assert kinds('He wrote: "Fine." You idiot!') == {"targeted"}
    assert kinds('"You idiot!" This is no report, she said.') == {"targeted"}
    assert kinds("He said you are an idiot. Idiot!") == {"reported", "plain"}
    # An opening quote without an end does not excuse the rest of a long text.
    assert "targeted" in kinds('He wrote: "' + "word " * 200 + "you idiot")
    assert kinds("You idiot") == {"targeted"} and kinds('"') == set() and kinds("") == set()
    many = reader.features('"Idiot!" she said. ' * 20_000)
    assert many[toxicity.REPORTED] > 1 and not any(many[:4])


def test_support_follows_the_share_of_toxic_documents(spark):
    """One rule for any number of labels: three hits of three prove little where half are toxic."""
    from pyspark.sql import functions as F

    def nats(bad, good, share):
        return spark.range(1).select(toxicity._evidence(F.lit(bad), F.lit(good), share)).first()[0]

    assert nats(3, 0, 0.5) < 4 <= nats(6, 0, 0.5) and nats(3, 0, 0.25) >= 4 and nats(3, 0, 0.05) > 8
    assert nats(1, 9, 0.5) == 0 and 0 < nats(8, 2, 0.5) < nats(10, 0, 0.5)


def test_models_gather_one_text_for_an_id(spark, make):
    rows, labels = labelled("zorgblat", 40)
    docs = make(rows + rows[:1] * 500)
    sample = toxicity._sample(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), 100)
    assert sample.count() == 40
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    sizes = []
    real = quality_model.train
    try:
        quality_model.train = lambda x, y: sizes.append(len(x)) or real(x, y)
        quality_model.fit(docs, known)
    finally:
        quality_model.train = real
    assert sizes == [40]


def test_toxicity_without_labels(make, spark):
    model = toxicity.fit(make([]), spark.createDataFrame([], "doc_id bigint, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(make([(1, "such an idiot and a moron"), (2, "a fine day")]), model).collect()}
    assert got[1] > got[2]


def test_quality_model(make, spark):
    rows = [(k, prose(k, 50) if k % 3 else " ".join(["again"] * (20 + k % 7))) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(None, 1)], "doc_id bigint, quality int")
    model = quality_model.fit(make(rows), labels)
    got = {r.doc_id: r.score for r in quality_model.score_quality(make([(1, prose(1, 77)), (2, "more " * 30), (3, None), (4, "")]), model).collect()}
    assert got[1] > 0.9 and got[2] < 0.1 and got[3] == got[4] and 0 <= got[3] <= 1
    empty = quality_model.fit(make([]), labels.limit(0))
    assert [r.score for r in quality_model.score_quality(make([(1, "x")]), empty).collect()] == [0.5]


def test_quality_model_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality_model.train(x, y, n_pairs=1)
    assert model.pairs[0][:2] == (2, 0)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def page(body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
            f"<nav><ul><li><a href='/x'>Home page</a></li><li><a>More links</a></li></ul></nav>{extra}<article>{body}</article>"
            f"<footer>&copy; someone &middot; all rights</footer></body></html>")


PAGES = [
    page("<h1>Title &amp; more</h1><p>First   para\n with <b>bold</b> text.</p><p>x</p><ul><li>One item</li></ul>"),
    page(f"<p>{prose(1, 80)}</p><p>{prose(2, 10)} &lt;tag&gt; &eacute;</p>", '<div class="ad">Buy this thing now</div>'),
    page(f"<h2>{prose(3, 4)}</h2>" + "".join(f"<p>{prose(k, 9)}</p>" for k in range(20))),
]


def test_page_text(spark, make):
    rows = [(k, "http://x", h) for k, h in enumerate(PAGES)]
    odd = [(10, None, None), (11, "u", ""), (12, "u", "just text"), (13, "u", "<p>open <b>bold <i>x"), (14, "u", "<script>only"),
           (15, "u", "<!-- a"), (16, "u", '<p title="a>b" class=x>inside</p>'), (17, "u", "a < b && c <3")]
    pages = spark.createDataFrame(rows + odd, "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages, html_text.learn_weights(pages)).collect()}
    for k, _, h in rows:
        assert got[k] == (article(h), len(article(h)))
    assert got[10] == got[11] == got[14] == got[15] == ("", 0)
    assert got[12][0] == "just text" and got[13][0] == "open bold x" and got[16][0] == "inside" and got[17][0] == "a < b && c <3"


def test_page_parts_that_are_no_content(spark, make):
    make([])
    text = [prose(k, 60) for k in range(3)]
    inner = (f"<header><h1>Head</h1></header><p>{text[0]}</p><div class='ad-box'>Buy now please</div><aside>See also that</aside><p>{text[1]}</p>"
             f"<form><label>Name</label><input></form><p>{text[2]}</p><section id='comments'><p>{prose(9, 30)}</p></section>")
    html = page(inner, "<div class='cookie-notice'><p>We use cookies here</p></div><header>Site name</header>")
    bare = f"<body class='no-sidebar'><ul><li><a>Menu one</a></li></ul><div><h1>Big</h1><p>{text[0]}</p><p>{text[1]}</p></div><footer>End of it</footer>"
    pages = spark.createDataFrame([(1, "", html), (2, "", bare)] + [(k, "", h) for k, h in enumerate(PAGES, 5)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages, html_text.learn_weights(pages)).collect()}
    assert got[1] == "\n".join(["Head", *text])
    assert got[2].endswith("\n".join(["Big", text[0], text[1]])) and "End of it" not in got[2]


def test_marks_weigh_against_what_they_hold():
    weights = {}
    text = lambda page: html_text.main_text(page, weights)
    words = "one two three four five six"
    assert text(f'<article><div class="content has-sidebar"><p>{words}</p></div></article>') == words
    assert text(f'<article><section class="post social"><p>{words}</p></section></article>') == words
    assert text(f'<article><h2 id="related-work">All the related work</h2><p id="search-results">{words}</p></article>') == f"All the related work\n{words}"
    assert text(f'<div class="has-sidebar"><h1>A title of it</h1><p>{words}</p></div>') == f"A title of it\n{words}"
    # What is marked and small, or stands by itself outside the content, goes.
    for mark in ("comments", "ad banner", "related", "cookie-notice"):
        assert text(f'<article><p>{words} {words}</p><div class="{mark}"><p>other</p></div></article>') == f"{words} {words}"
    assert text(f'<div><p>{words}</p></div><div class="comments"><p>{words} {words}</p></div>') == words


def test_pages_are_read_by_one_rule_at_any_size():
    pad = "<!-- " + "x" * (1 << 20) + " -->"
    for extra in ("", pad):
        kinds = {r[0] for r in html_text.read_page(f"{extra}<ARTICLE><P>text</P></ARTICLE>")}
        assert "word p in marked" in kinds
    # A quote belongs to a value only behind an equals sign, however long the tag is.
    for n in (10, 5000):
        assert html_text.main_text(f"<p a={'b' * n} \">some words here</p><p>and \" more</p>", {}) == 'some words here\nand " more'
    names = {r[0] for k in range(3000) for r in html_text.read_page(f"<x-{k}>word</x-{k}>")}
    assert names == {"other bare", "/other bare", "word other bare"}
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert html_text.main_text(long, {}).count("\n") == 49_999


def test_best_stretch():
    r = random.Random(1)
    for _ in range(200):
        v = [r.randint(-4, 4) for _ in range(r.randint(0, 12))]
        a, b = html_text.best_stretch(v)
        best = max([0] + [sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1)])
        assert sum(v[a:b]) == best


@pytest.fixture(scope="module")
def sf_dir(make, spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    rows, labels = labelled("zorgblat", 120)
    bad = {i for i, y in labels if y}
    rows += cluster(6, 12, 1000, 90, 1) + [(2000, "short"), (2001, None), (2002, ""), (None, prose(31, 50)),
                                           (2003, prose(32, 40) + " password=abcdef123456 " + prose(33, 10)), (2003, prose(32, 40) + " password=abcdef123456 " + prose(33, 10))]
    # A column more, whose name the operators use inside.
    make(rows).selectExpr("*", "doc_id AS key", "text AS _row").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, rows, bad


def test_pipeline(spark, sf_dir):
    out, rows, bad = sf_dir
    docs = spark.read.parquet(f"{out}/documents.parquet")
    steps = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, out)
        if k < 4:
            assert got.columns == docs.columns, name
        path = f"{out}/step{k}"
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        steps.append(docs.collect())
    clean, ruled, single, masked, pieces = steps
    assert {r.doc_id for r in clean} == {i for i, _ in rows} - bad
    assert {r.doc_id for r in ruled} == {i for i, t in rows if t and len(t.split()) >= 20} - bad
    assert [r.doc_id for r in single if r.doc_id and r.doc_id >= 1000 and r.doc_id < 2000] == [1000]
    assert sum(r.doc_id == 2003 for r in single) == 1 and sum(r.doc_id is None for r in single) == 1
    assert len(masked) == len(single) and all("abcdef123456" not in r.text for r in masked)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in masked}
    assert corpus_pipeline.run(spark, out).count() == len(pieces)


def test_pipeline_on_empty_tables(spark, sf_dir, tmp_path):
    out, _, _ = sf_dir
    docs = spark.read.parquet(f"{out}/documents.parquet")
    docs.limit(0).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{out}/labels.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.read.schema(docs.schema).parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_held_out_rows_are_not_learned(spark, make):
    from pyspark.sql import functions as F

    from driftline.llm.common import held_out
    got = {r.doc_id: r.h for r in make([(k, "") for k in range(30)] + [(None, "")]).select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in range(30)} | {None: False}
