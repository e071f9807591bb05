"""Personal data: fixed patterns, and identifiers found through bootstrapped contexts.

Base patterns give spans of the kinds email, ip, card and phone, which seed the rest. A candidate is
a word with digits or an `@`; its lexical patterns are the word before it, the two words before it,
and the words on both sides. Over the graph of patterns and candidate strings Spark alternates two
steps: a pattern is as good as the strings it holds, shrunk where it holds few, times the share of
all its occurrences in the corpus that hold a candidate at all; a string is as sure as the patterns
around it make it, seeds being certain. Candidates in contexts of high confidence are reported as
`found`.

Defined cases: null and empty texts have no spans; spans are in code points, end exclusive; base
spans always stay and a found span never overlaps one; repeated rows are scanned row by row, and a
string counts once for a pattern however often it repeats; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches, map_texts, words_of
from driftline.session import cut

KINDS = ("email", "ip", "card", "phone", "found")
# The base patterns. Digits of an address are taken whole, from the first digit on.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
STRIP = ".,;:!?()[]{}<>\"'"


@dataclass(frozen=True)
class Bootstrap:
    """`seeds`: different seed strings a pattern needs; `good`: the least score of a pattern that
    counts; `sure`: the least confidence of a candidate that is reported."""

    rounds: int = 3
    seeds: int = 5
    good: float = 0.5
    sure: float = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        after = at + 1
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield 0, start, m.end()
                done = after = m.end()
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple]:
    """(kind index, start, end) by kind and start."""
    out = list(_emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        # Long digit strings are not turned into numbers.
        out += [(1, m.start(), m.end()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, taken) -> list[tuple]:
    """(start, end, string, patterns, is seed) of every word with a digit or an `@`. A word that
    touches a base span stands for the span; the words around are those outside it."""
    if not DIGIT.search(text) and "@" not in text:
        return []
    spans, k, out = sorted((a, b) for _, a, b in taken), 0, []
    units = []
    for m in WORD.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < b:
            if units and units[-1][3] == spans[k]:
                continue
            units.append((*spans[k], text[spans[k][0]:spans[k][1]], spans[k]))
        else:
            units.append((a, b, m.group(), None))
    for i, (a, b, word, span) in enumerate(units):
        if span is None:
            core = word.strip(STRIP)
            if len(core) < 4 or not ("@" in core or DIGIT.search(core)):
                continue
            a += word.index(core)
            b, word = a + len(core), core
        before = units[i - 1][2] if i else ""
        two = units[i - 2][2] if i > 1 else ""
        after = units[i + 1][2] if i + 1 < len(units) else ""
        # Patterns are made of words: the edges of a text are none.
        around = [f"L {before}"] if before else []
        around += [f"LL {two} {before}"] if before and two else []
        around += [f"LR {before} {after}"] if before and after else []
        out.append((a, b, word, around, span is not None))
    return out


def learn_patterns(docs: DataFrame, cfg=Bootstrap()) -> dict[str, float]:
    """Scores of the good patterns, over all documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    may = docs.select("text").filter(F.col("text").rlike("[0-9@]"))

    def edges(batches):
        for b in batches:
            rows = set()
            for text in b.column("text").to_pylist():
                for _, _, string, patterns, seed in candidates(text, base_spans(text)):
                    rows.update((p, string, seed) for p in patterns)
            p, s, f = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(s, pa.string()), pa.array(f, pa.bool_())],
                                             names=["pattern", "string", "seed"])

    graph = cut(may.mapInArrow(edges, "pattern string, string string, seed boolean")
                .groupBy("pattern", "string").agg(F.max("seed").alias("seed")))
    seeded = (graph.filter("seed").groupBy("pattern").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= cfg.seeds)
              .select("pattern").collect())
    chosen = frozenset(r.pattern for r in seeded)
    if not chosen:
        return {}
    firsts = frozenset(p.split(" ")[1 if p.startswith("L ") or p.startswith("LR") else 2] for p in chosen)

    def occurrences(batches):
        for b in batches:
            seen, held = Counter(), Counter()
            for text in b.column("text").to_pylist():
                text = text or ""
                words = words_of(text)
                if not firsts.isdisjoint(words):
                    for i, w in enumerate(words[:-1]):
                        if w in firsts:
                            two = words[i - 1] if i else ""
                            after = words[i + 2] if i + 2 < len(words) else ""
                            seen.update(p for p in (f"L {w}", f"LL {two} {w}", f"LR {w} {after}") if p in chosen)
                for _, _, _, patterns, _ in candidates(text, base_spans(text)):
                    held.update(p for p in patterns if p in chosen)
            both = list({*seen, *held})
            yield pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), pa.array([seen[p] for p in both], pa.int64()), pa.array([held[p] for p in both], pa.int64())],
                names=["pattern", "seen", "held"])

    share = (docs.select("text").mapInArrow(occurrences, "pattern string, seen bigint, held bigint").groupBy("pattern")
             .agg(F.sum("seen").alias("seen"), F.sum("held").alias("held"))
             .select("pattern", (F.col("held") / F.greatest("seen", "held", F.lit(1))).alias("share")))
    kept = cut(graph.join(cut(share), "pattern"))
    strings = kept.groupBy("string").agg(F.max(F.col("seed").cast("double")).alias("sure"))
    for _ in range(cfg.rounds):
        patterns = (kept.join(strings, "string").groupBy("pattern")
                    .agg((F.sum("sure") / (F.count("*") + 1) * F.max("share")).alias("score")))
        strings = cut(kept.join(patterns.filter(F.col("score") >= cfg.good), "pattern", "left").groupBy("string").agg(
            F.greatest(F.max(F.col("seed").cast("double")),
                       1 - F.exp(F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999)))))).alias("sure")))
    final = (kept.join(strings, "string").groupBy("pattern").agg((F.sum("sure") / (F.count("*") + 1) * F.max("share")).alias("score"))
             .filter(F.col("score") >= cfg.good).collect())
    return {r.pattern: float(r.score) for r in final}


def found_spans(text: str, taken, patterns: dict, sure: float) -> list[tuple]:
    if not patterns:
        return []
    out = []
    for a, b, _, around, seed in candidates(text, taken):
        if not seed:
            doubt = sum(math.log1p(-min(patterns.get(p, 0.0), 0.999)) for p in around)
            if 1 - math.exp(doubt) >= sure:
                out.append((4, a, b))
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, patterns: dict, cfg=Bootstrap(), keep=("doc_id",)) -> DataFrame:
    """The kept columns, a count per base kind, the SHA-256 of the base spans, and all spans."""
    def kernel(texts):
        rows = []
        for t in texts:
            base = base_spans(t)
            n = [0, 0, 0, 0]
            for k, _, _ in base:
                n[k] += 1
            every = base + found_spans(t, base, patterns, cfg.sure)
            rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
        return rows

    return map_texts(docs, kernel, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", keep)
