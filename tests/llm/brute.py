"""Plain one-document-at-a-time versions of what the operators return."""

import hashlib
import html
import random
import re

import regex

WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfgaeiou") for _ in range(r.randint(2, 7))) for _ in range(n))


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def near_components(docs, k, percent=80):
    """{doc_id: smallest doc_id reachable} over all pairs."""
    sets = {i: shingles(t, k) for i, t in docs}
    part = {i: i for i in sets}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    part[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PII.items() for m in regex.finditer(p, text or "") if ok(m.group())]


def secret_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.A)
        if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m.group()) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def article(page):
    """The text of well-formed test pages: blocks of the article element."""
    inner = re.search("<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"</?(?:h1|h2|p|ul|li)>", inner.group(1)) if inner else []
    lines = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)
