"""Main text of web pages as the maximum-scoring stretch of words and tags.

A page is read once as a sequence of word runs and tags. Each has a weight: the log-odds of standing
inside the content of labelled pages, so words in running text score high, words in links and lists
outside it and most tags score below zero. One linear scan finds the stretch with the greatest sum;
its words, without those in elements that are never content, are the text.

Labelled pages are those that mark their content themselves, with `article` or `main`. Counts are
taken over all of them. Kinds of words and tags that no page shows keep default weights, and so does
everything where no page is labelled. On a page with marks, words also know whether they stand
inside them; pages without marks are scored by element names alone. Element names outside HTML share
one kind, so there are a few hundred kinds at most.

Class, id and role words that name menus, adverts, comments and the like only weigh against an element.
They weigh nothing on inline elements, an id weighs nothing on a heading or paragraph, where it is an
anchor, and they are outweighed by what the element holds: a title, marked content, or at least half of
the words of the content it stands in.

Defined cases: null and empty pages have an empty text; unclosed tags, quotes, comments and scripts
end with the page; repeated rows are read row by row; an empty table gives an empty result. Only the
kept columns and `html` are read. Pages of any length are read by the same rules.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches

# The roles of element names, and the words in class, id and role attributes that mark
# what is not content.
CONTENT = frozenset("article main".split())
WHOLE = frozenset("html body main article".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody
    td tfoot th thead tr ul""".split())
NEVER = frozenset("""aside button canvas datalist dialog footer form head iframe input label menu nav noscript object option
    script select style svg template textarea title""".split())
INLINE = frozenset("""abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span
    strike strong sub sup time tt u var""".split())
OTHERS = frozenset("a audio center frame frameset map math picture slot video".split())
KNOWN = BLOCK | NEVER | VOID | RAW | CONTENT | INLINE | OTHERS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
MARKS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary
    contentinfo cookie cookies consent disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pager
    pagination popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription tags toolbar widget widgets""".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_CONTENT_TAG = re.compile("<(?:article|main)", re.I)
_MARKED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}

DEFAULT_WORD, DEFAULT_TAG, DEFAULT_NEVER = 1.0, -0.5, -0.5
LIMIT = 3.0


def pieces(page: str) -> Iterator[tuple]:
    """(name, attributes or None, is a closing tag, text): tags have a name, runs of text none."""
    at, n = 0, len(page)
    closing = {"'": True, '"': True}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield None, None, False, page[at:]
            return
        if lt > at:
            yield None, None, False, page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt)
        if not m:
            yield None, None, False, "<"
            at = lt + 1
            continue
        at, end = m.end(), -1
        while end < 0:
            stop = _STOP.search(page, at)
            if stop is None:
                end = n
            elif stop.group() == ">":
                end = stop.start()
            else:
                quote = stop.group()
                before = stop.start() - 1
                while before >= m.end() and page[before].isspace():
                    before -= 1
                opened = before >= m.end() and page[before] == "="
                close = page.find(quote, stop.end()) if opened and closing[quote] else -1
                if opened and close < 0:
                    closing[quote] = False
                at = stop.end() if close < 0 else close + 1
        name, attributes = m.group(1).lower(), page[m.end():end]
        at = end + 1
        if page[lt + 1] == "/":
            yield name, None, True, ""
            continue
        yield name, attributes, False, ""
        if name in RAW and not attributes.rstrip().endswith("/"):
            stop = _RAW_END[name].search(page, at)
            at = n if stop is None else stop.start()


def is_marked(name: str, attributes: str) -> bool:
    """Whether class, id or role has a word of MARKS that weighs on this element."""
    if "=" not in attributes or name in INLINE:
        return False
    anchor = name in HEADINGS or name == "p"
    for attribute, *groups in _MARKED.findall(attributes):
        if anchor and attribute.lower() == "id":
            continue
        if any(w.lower() in MARKS for w in _TOKENS.findall("".join(groups))):
            return True
    return False


class _Mark:
    """An open element with a mark: where it begins, the content around it, what it holds."""

    def __init__(self, start, around):
        self.start, self.around, self.titled = start, around, False


def read_page(page: str) -> list[tuple]:
    """(kind, words, text or None, block, in content) of every run and tag, in order. Kinds name what
    is weighed together; text is None for tags and for words that are never content."""
    where = "marked" if _CONTENT_TAG.search(page) else "bare"
    stack, opened = [], Counter()
    never = content = block = 0
    out, marks, regions, open_regions = [], [], [], []

    def close_mark(mark):
        if mark is not None:
            marks.append((mark, len(out)))

    def pop(to: int):
        nonlocal never, content
        while len(stack) > to:
            name, bad, mark = stack.pop()
            opened[name] -= 1
            never -= bad
            close_mark(mark)
            if name in CONTENT:
                content -= 1
                regions[open_regions.pop()][1] = len(out)

    for name, attributes, closes, text in pieces(page):
        if name is None:
            words = len(text.split())
            if words or text:
                inner = stack[-1][0] if stack else ""
                inner = inner if inner in KNOWN or not inner else "other"
                if never:
                    out.append(("never", words, None, block, content > 0))
                else:
                    kind = f"word {inner} {where}" if where == "bare" else f"word {inner} {'in' if content else 'out'} {where}"
                    out.append((kind, words, text, block, content > 0))
            continue
        if name in BLOCK:
            block += 1
        elif name == "br" and not never:
            out.append(("br", 0, " ", block, content > 0))
            continue
        inside = content > 0
        if closes:
            if opened[name] > 0:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            out.append((f"/{name if name in KNOWN else 'other'} {where}", 0, None, block, inside))
            continue
        if name in CLOSES and stack and opened.total():
            closed = CLOSES[name]
            k = len(stack) - 1
            # An open paragraph or item ends here, with what is open in it, but no further up than
            # the block around it.
            while k >= 0 and stack[k][0] not in closed and stack[k][0] not in BLOCK:
                k -= 1
            if k >= 0 and stack[k][0] in closed:
                pop(k)
        if name == "h1" or name in CONTENT:
            for _, _, mark in stack:
                if mark is not None:
                    mark.titled = True
        if name not in VOID:
            bad = name not in WHOLE and (name in NEVER or name == "header" and not content)
            # The page and its content as a whole are what their marks are about, not marked off.
            marked = name not in WHOLE and not bad and is_marked(name, attributes)
            stack.append((name, bad, _Mark(len(out), open_regions[-1] if open_regions else None) if marked else None))
            opened[name] += 1
            never += bad
            if name in CONTENT:
                content += 1
                open_regions.append(len(regions))
                regions.append([len(out), None])
        shown = name if name in KNOWN else "other"
        out.append((f"{shown} {where}" if not never else "never tag", 0, None, block, inside or content > 0))
    pop(0)
    return _without_marked(out, marks, regions)


def _without_marked(out: list, marks: list, regions: list) -> list:
    """The runs and tags, those of marked elements as never content, unless what they hold weighs more."""
    if not marks:
        return out
    total = [0]
    for kind, words, *_ in out:
        total.append(total[-1] + (words if kind.startswith("word") else 0))
    for mark, end in marks:
        own = total[end] - total[mark.start]
        if mark.titled:
            continue
        if mark.around is not None:
            a, b = regions[mark.around]
            if own and 2 * own >= total[b] - total[a]:
                continue
        for k in range(mark.start, end):
            kind, words, text, block, content = out[k]
            if kind.startswith("word"):
                out[k] = ("never", words, None, block, content)
            elif kind == "br":
                out[k] = ("never tag", 0, None, block, content)
            elif not kind.startswith("never"):
                out[k] = ("never tag", 0, None, block, content)
    return out


def default_weight(kind: str) -> float:
    if kind.startswith("word"):
        return DEFAULT_WORD
    return 0.0 if kind == "br" else DEFAULT_NEVER if kind.startswith("never") else DEFAULT_TAG


def learn_weights(pages: DataFrame, column="html") -> dict[str, float]:
    """Weights of kinds from all pages that mark their content. Kinds are few: names of HTML elements."""
    def count(batches):
        for b in batches:
            inside, outside = Counter(), Counter()
            for page in b.column(column).to_pylist():
                if not page:
                    continue
                for kind, words, _, _, content in read_page(page):
                    if kind.endswith("marked"):
                        by_name = " ".join([*kind.split(" ")[:2 if kind.startswith("word") else 1], "bare"])
                        for k in (kind, by_name):
                            (inside if content else outside)[k] += words or not kind.startswith("word")
            kinds = list({*inside, *outside})
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()),
                 pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "inside", "outside"])

    bounded_batches(pages.sparkSession, rows=500)
    rows = (pages.select(column).mapInArrow(count, "kind string, inside bigint, outside bigint").groupBy("kind")
            .agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect())
    weights = {}
    for r in rows:
        # Default weights count as a few observations.
        prior = math.exp(default_weight(r.kind))
        weights[r.kind] = max(-LIMIT, min(LIMIT, math.log((r.i + 4 * prior) / (r.o + 4))))
    return weights


def best_stretch(values) -> tuple[int, int]:
    """Start and end (exclusive) of the first longest stretch with the greatest sum above zero."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for k, v in enumerate(values):
        if run <= 0:
            run, start = 0.0, k
        run += v
        if run > best or run == best and best > 0 and span[0] == start:
            best, span = run, (start, k + 1)
    return span


def main_text(page: str, weights: dict) -> str:
    read = read_page(page)
    values = []
    for kind, words, _, _, _ in read:
        w = weights.get(kind)
        if w is None:
            w = default_weight(kind)
        values.append(w * words if kind.startswith("word") or kind == "never" else w)
    start, end = best_stretch(values)
    blocks, last = [], None
    for _, _, text, block, _ in read[start:end]:
        if text is None:
            continue
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(text)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, weights: dict, keep=("page_id", "url"), column="html") -> DataFrame:
    """The kept columns, the main text and its length in code points."""
    bounded_batches(pages.sparkSession, rows=500)
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            texts = [main_text(p, weights) if p else "" for p in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[*keep, "text", "n_chars"])

    return pages.select(*keep, column).mapInArrow(run, f"{fields}, text string, n_chars bigint")
