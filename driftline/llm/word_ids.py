"""Token ids of texts through the ids of their distinct words.

A word here is a stretch of text that the tokenizer never looks across, so that the ids of a text
are the ids of its words one after another and every distinct word needs to be encoded only once.
"""

from __future__ import annotations

import re
from functools import lru_cache

# White space as the tokenizers' patterns see it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Byte-level BPE: one space belongs to the word after it; the last character of other white space
# stands alone before a word.
SPACED = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
# Word-level BPE drops white space.
BARE = re.compile(f"[^{_WHITE}]+")
MARKS = ".,:;!?"
_CONTROL = re.compile("[\\x1c-\\x1f]")


def bare_words(text: str) -> list[str]:
    """Words for a tokenizer that drops white space and case."""
    if text.isascii():
        # Lower case of other letters is left to the tokenizer, which goes letter by letter.
        text = text.lower()
    # str.split() differs from the pattern in four control characters.
    return BARE.findall(text) if _CONTROL.search(text) else text.split()


@lru_cache(maxsize=2)
def open_tokenizer(path: str):
    """The tokenizer of a file, with its truncation and padding unused, on one thread. A worker opens a
    file once for all its tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def _borders(path: str, spaced: bool):
    """For every id, whether a word begins (pieces with a space in front) or ends there."""
    import numpy as np

    vocab = open_tokenizer(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        out[i] = piece.startswith("\u0120") if spaced else piece.endswith("</w>")
    return out


class WordIds:
    """Ids of words as little-endian unsigned 32-bit bytes. Holds at most `memory` words.

    Words of letters alone are one unit of the tokenizer's pattern. Many of them are encoded as one
    text, whose ids tell where a word ends (pieces with the mark of a word's end) or begins (pieces
    with a space in front). Where the counts do not agree, words are encoded one by one.
    """

    def __init__(self, path: str, split, spaced: bool, memory=500_000):
        self.path, self.split, self.spaced, self.memory = path, split, spaced, memory
        self.known: dict[str, bytes] = {}
        self.tok = None

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "tok": None, "border": None}

    def _open(self):
        self.tok = open_tokenizer(self.path)
        self.border = _borders(self.path, self.spaced)

    def encode(self, words: list[str]) -> dict[str, bytes]:
        import numpy as np

        if self.tok is None:
            self._open()
        if self.spaced:
            plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        else:
            plain = [w for w in words if w.isalpha()]
        out = {}
        for k in range(0, len(plain), 500):
            part = plain[k:k + 500]
            # The fast call makes the same ids without their places in the text.
            text = ("" if self.spaced else " ").join(part)
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(self.border[ids])
            if len(marks) != len(part) or (self.spaced and marks[0] != 0):
                continue
            data = ids.tobytes()
            cuts = (4 * marks).tolist() + [len(data)] if self.spaced else [0] + (4 * marks + 4).tolist()
            for w, a, b in zip(part, cuts, cuts[1:]):
                out[w] = data[a:b]
        rest = [w for w in words if w not in out]
        for k in range(0, len(rest), 20_000):
            part = rest[k:k + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def learn(self, new) -> None:
        """Words with one mark after a letter are that word and the mark: patterns split there."""
        known = self.known
        marked = [w for w in new if w[-1] in MARKS and len(w) > 1 and w[-2].isalpha()]
        bare = set(new).difference(marked).union([w[:-1] for w in marked], [w[-1] for w in marked])
        bare = list(bare.difference(known))
        known.update(self.encode(bare))
        known.update([(w, known[w[:-1]] + known[w[-1]]) for w in marked])

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.memory:
            known.clear()
            new = set(words)
        if new:
            self.learn(new)
        return [known[w] for w in words]

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Very long texts are fine: only distinct words are kept."""
        known = self.known
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(known) if split else ()
        if len(known) + len(new) > self.memory:
            known.clear()
            new = set().union(*split)
        if new:
            self.learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]
