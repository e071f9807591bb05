"""Secrets: fixed patterns, and strings near sensitive words that a primed compressor cannot explain.

Base patterns give spans of the kinds assign, access and hex. The kind `novel` is found by zstandard:
a candidate (a long string outside base spans, shortly after a sensitive
word) costs as many bytes as it adds to the compressed surroundings, with a dictionary of the words
that are common around candidates in the whole corpus. Candidates and base spans are no part of
surroundings or dictionary, and a text counts once for the dictionary however often it repeats, so
repeated secrets stay novel. Strings that stay incompressible are reported.

The dictionary only makes common words cheap; it holds `dictionary_bytes` of them, the most common. A
word beyond it is measured like any other candidate, so the bound drops no secret.

Defined cases: null and empty texts have no spans; spans are in code points, end exclusive; repeated
rows are scanned row by row; an empty table gives an empty result and an empty dictionary.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches, map_texts

KINDS = ("assign", "access", "hex", "novel")
# Patterns of the base kinds and the words that make a context sensitive.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Whole words, also in names such as client_secret; letters beside them make another word.
SENSITIVE = re.compile(r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?s?|pwd|secrets?|tokens?|api.?keys?|auth(?:orization|entication)?|"
                       r"bearer|credentials?|(?:private|secret|access|encryption|signing).?keys?|signature|client.?id|session(?:.?id)?|"
                       r"cookies?)(?![A-Za-z])", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


@dataclass(frozen=True)
class Novelty:
    """`reach` characters before a candidate may hold the sensitive word; `around` characters on
    each side are the surroundings. A string is reported if it adds at least `least` bytes and
    `ratio` bytes per character. The dictionary holds at most `dictionary_bytes`."""

    reach: int = 48
    around: int = 2048
    least: int = 10
    ratio: float = 0.55
    dictionary_bytes: int = 32768


def base_spans(text: str) -> list[tuple]:
    """(kind index, start, end), by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, taken, cfg: Novelty) -> list[tuple]:
    """(start, end) of long strings shortly after a sensitive word and outside the taken spans. What
    characters they have is left to the compressor."""
    out, spans, k = [], sorted((s, e) for _, s, e in taken), 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < b:
            continue
        if SENSITIVE.search(text, max(0, a - cfg.reach), a):
            out.append((a, b))
    return out


def blanked(text: str, spans) -> str:
    """The text with spaces in place of the (start, end) spans, so that positions stay."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            a = max(a, at)
            out += [text[at:a], " " * (b - a)]
            at = b
    return "".join(out) + text[at:]


def surroundings(text: str, hidden: str, a: int, b: int, cfg: Novelty) -> str:
    """What stands around a candidate without candidates, base spans and other copies of it, so that
    no secret explains itself or another. `hidden` is the blanked text."""
    near = hidden[max(0, a - cfg.around):a] + " " + hidden[b:b + cfg.around]
    return near.replace(text[a:b], " ")


def without_copies(words: set, strings: set) -> list[str]:
    """The words that hold none of the strings, in time that grows with their lengths."""
    import ahocorasick

    finder = ahocorasick.Automaton()
    for x in strings:
        finder.add_word(x, True)
    finder.make_automaton()
    return [w for w in words if next(finder.iter(w), None) is None]


def build_dictionary(docs: DataFrame, cfg=Novelty()) -> bytes:
    """Words common around candidates, over all distinct documents, the most common last (near
    matches are cheaper). Bounded by `dictionary_bytes`."""
    def words_around(batches):
        for b in batches:
            words, owners = [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                taken = base_spans(text)
                found = candidates(text, taken, cfg)
                if not found:
                    continue
                hidden = blanked(text, [*found, *((s, e) for _, s, e in taken)])
                near = set()
                for a, e in found:
                    near.update(w for w in surroundings(text, hidden, a, e, cfg).split() if len(w) >= 3)
                # A copy may stand near another candidate only.
                near = without_copies(near, {text[a:e] for a, e in found})
                words += near
                owners += [hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.binary()), pa.array(words, pa.string())], names=["owner", "word"])

    bounded_batches(docs.sparkSession)
    common = (docs.select("text").mapInArrow(words_around, "owner binary, word string").distinct()
              .groupBy("word").count().filter("count > 1").orderBy(F.desc("count"), "word")
              .limit(cfg.dictionary_bytes // 4).collect())
    kept, size = [], 0
    for r in common:
        size += len(r.word.encode()) + 1
        if size > cfg.dictionary_bytes:
            break
        kept.append(r.word)
    return " ".join(reversed(kept)).encode()


class Scanner:
    """Finds all spans of a text. Made on the driver, it opens its compressor where it is used."""

    def __init__(self, dictionary: bytes, cfg=Novelty()):
        self.dictionary, self.cfg = dictionary, cfg

    def _size(self):
        import zstandard
        primed = zstandard.ZstdCompressionDict(self.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) \
            if len(self.dictionary) >= 8 else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=primed) if primed else zstandard.ZstdCompressor(level=3)
        return lambda s: len(packer.compress(s.encode("utf-8", "surrogatepass")))

    def __getstate__(self):
        return {"dictionary": self.dictionary, "cfg": self.cfg}

    def novel_spans(self, text: str, taken) -> list[tuple]:
        found = candidates(text, taken, self.cfg)
        if not found:
            return []
        if "measure" not in self.__dict__:
            self.measure = self._size()
        out, hidden = [], blanked(text, [*found, *((s, e) for _, s, e in taken)])
        for a, b in found:
            near = surroundings(text, hidden, a, b, self.cfg)
            added = self.measure(near + text[a:b]) - self.measure(near)
            if added >= self.cfg.least and added >= self.cfg.ratio * (b - a):
                out.append((3, a, b))
        return out

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans, and all spans in the same order."""
        base = base_spans(text)
        return base, sorted(base + self.novel_spans(text, base), key=lambda s: (s[1], s[0]))


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, scanner: Scanner, keep=("doc_id",)) -> DataFrame:
    """The kept columns, a count per base kind, the SHA-256 of the base spans, and all spans."""
    def kernel(texts):
        rows = []
        for t in texts:
            base, every = scanner.spans(t)
            n = [0, 0, 0]
            for k, _, _ in base:
                n[k] += 1
            rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
        return rows

    return map_texts(docs, kernel, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", keep)


def mask(text: str, spans, mark="[SECRET]") -> str:
    """The text with every run of touching or overlapping spans replaced by the mark."""
    out, at, until = [], 0, -1
    for _, a, b in spans:
        if a > until:
            out += [text[at:a], mark]
        until = max(until, b)
        at = until
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """All rows and columns, secrets masked in `text`; `n_chars`, where present, follows the text."""
    names = docs.columns

    def run(batches):
        for b in batches:
            texts, cols = [], list(b.columns)
            for t in b.column("text").to_pylist():
                every = scanner.spans(t)[1] if t else []
                texts.append(mask(t, every) if every else t)
            cols[names.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    bounded_batches(docs.sparkSession)
    masked = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked
