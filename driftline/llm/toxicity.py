"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as symbols (insult, threat, target, negation, report, quote) by a lexicon whose
insults are learned from labelled documents: whole words and word beginnings that stand in many
different contexts of toxic documents and hardly in clean ones. Four small transducers (target,
negation, reported speech, emission) are composed once into a single deterministic one, which
rewrites each clause into weighted matches: plain, targeted, threat, negated, reported. A logistic
model over the match weights gives the score, so how much a negated or quoted insult still counts
is learned, not assumed. A quotation is reported speech from a report to its closing quote, over any
number of clauses, and also where the report follows it.

Defined cases: null and empty texts have no clause and get the score of a text without matches.
Repeated rows are scored one by one and equal texts score alike; very long texts are scored whole. An
empty table gives an empty result. Of a labelled id that repeats, one text is learned from (the smallest),
and an id with both labels is toxic. Without labelled rows of both classes the built-in seed words and default weights apply. Other columns are not read; clashing
names are no matter.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches, map_texts, words_of
from driftline.session import cut

# Cue words of the grammar in English, German, French and Spanish.
SEEDS = ("idiot", "moron", "scum", "loser", "worthless", "pathetic", "disgusting", "stupid", "trash")
THREATS = ("kill", "hurt", "destroy", "beat", "shoot", "stab", "murder", "strangle", "slaughter", "töten", "umbringen", "erschießen",
           "tuer", "assassiner", "matar", "asesinar")
TARGETS = ("you", "your", "he", "she", "they", "du", "dich", "ihr", "tu", "vous", "toi", "tú", "usted", "ustedes")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")
# Words after a closing quote in which a report may still follow, and words after which an unclosed quotation ends.
AFTER_QUOTE, QUOTATION = 3, 100

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, STOP = range(8)
KINDS = ("plain", "targeted", "threat", "negated", "reported")
PLAIN, TARGETED, THREATENED, NEGATED, REPORTED = range(5)
# Log-odds a match of unit weight adds before anything is learned.
PRIOR = (3.0, 3.5, 3.5, 1.0, 1.0)
SCOPE = 3

_OPENS, _CLOSES = "\"“”„«»‟", "\"“”«»"
_STRIP = "\"'“”„«»()[]{}<>*#%&$!?.,;:-–—_|~`"
_ENDS = ".!?;"
_LEET = str.maketrans("013457@$", "oieastas")


# Transducers: a start state and a step from (state, symbol) to (state, symbol). Symbols passed on
# by the later ones are pairs of a symbol and a kind of match.

def _countdown(state, symbol, opener):
    """States of a cue that reaches over the next SCOPE words of its clause."""
    if symbol == STOP:
        return 0
    return SCOPE if symbol == opener else max(state - 1, 0)


def _target(state, item):
    symbol, kind = item
    if symbol == INSULT and state:
        kind = TARGETED
    return _countdown(state, symbol, TARGET), (symbol, kind)


def _negation(state, item):
    symbol, kind = item
    if symbol in (INSULT, THREAT) and state:
        kind = NEGATED
    return _countdown(state, symbol, NEGATION), (symbol, kind)


def _reported(state, item):
    """The rest of a clause after a report (state 1), and a quotation opened there, up to its closing
    quote (states above 1, which count the words that are left of it)."""
    symbol, kind = item
    if symbol in (INSULT, THREAT) and state:
        kind = REPORTED
    if symbol == QUOTE:
        return (1 + QUOTATION if state == 1 else 0 if state > 1 else state), (symbol, kind)
    if symbol == STOP:
        return (state if state > 1 else 0), (symbol, kind)
    if state > 1:
        return (state - 1 if state > 2 else 0), (symbol, kind)
    return (1 if symbol == REPORT else state), (symbol, kind)


def _emit(state, item):
    symbol, kind = item
    if symbol == INSULT:
        return state, (symbol, PLAIN if kind is None else kind)
    if symbol == THREAT:
        # A threat counts where the clause also has a target or is negated or reported.
        return state, (symbol, THREATENED if kind is None else kind)
    return state, (symbol, None)


def compose(*steps):
    """One table {(state, symbol): (state, kind)} of the reachable states of the composition."""
    start = (0,) * len(steps)
    ids, queue, table = {start: 0}, [start], {}
    while queue:
        states = queue.pop()
        for symbol in range(8):
            item, after = (symbol, None), []
            for step, state in zip(steps, states):
                state, item = step(state, item)
                after.append(state)
            after = tuple(after)
            if after not in ids:
                ids[after] = len(ids)
                queue.append(after)
            table[ids[states], symbol] = ids[after], item[1] if symbol in (INSULT, THREAT) else None
    return table


GRAMMAR = compose(_target, _negation, _reported, _emit)


@dataclass(frozen=True)
class Model:
    """Insult weights of whole words and of beginnings, and the logistic weights over KINDS."""

    words: dict
    stems: dict
    weights: tuple
    bias: float

    def score(self, features) -> float:
        z = self.bias + sum(w * f for w, f in zip(self.weights, features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def normal_form(word: str) -> str:
    w = word.strip(_STRIP).lower()
    if not w.isalpha() and any(c.isalpha() for c in w) and any(c in "013457@$" for c in w):
        w = w.translate(_LEET)
    return w


class Reader:
    """Reads words as symbols. Results are kept for words seen before, up to a bound."""

    def __init__(self, words, stems, memory=150_000):
        cues = {}
        for symbol, listed in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            cues.update(dict.fromkeys(listed, symbol))
        self.cues, self.words, self.stems, self.memory = cues, words, stems, memory
        self.lengths = sorted({len(s) for s in stems})
        self.seen: dict[str, tuple] = {}

    def read(self, word):
        """(symbol, weight, ends the clause, opens or closes a quotation)."""
        form, ends = normal_form(word), word.rstrip("\"'”»)").endswith(tuple(_ENDS))
        opens, closes = word[0] in _OPENS, word.rstrip(".,;:!?)")[-1:] in _CLOSES and len(word) > 1
        weight = self.words.get(form)
        if weight is None:
            weight = next((self.stems[form[:n]] for n in self.lengths if form[:n] in self.stems), None)
        if weight is not None:
            return INSULT, weight, ends, opens, closes
        return self.cues.get(form, OTHER), 1.0, ends, opens, closes

    def features(self, text: str) -> tuple:
        """Match weights of a text by kind: the strongest match plus a damped rest."""
        seen, tokens = self.seen, words_of(text)
        new = set(tokens).difference(seen)
        if new:
            if len(seen) + len(new) > self.memory:
                seen.clear()
                new = set(tokens)
            for w in new:
                seen[w] = self.read(w)
        symbols = [seen[w] for w in tokens]
        if not any(s[0] in (INSULT, THREAT) for s in symbols):
            return (0.0,) * 5
        found = []
        state = clause_target = 0
        # Matches of the open quotation, or of the one just closed; words in which a report may follow.
        threats, quoted, within, left = [], [], 0, 0

        def add(kind, weight, inside):
            found.append([kind, weight])
            if inside:
                quoted.append(found[-1])

        for symbol, weight, ends, opens, closes in symbols:
            if left:
                left -= 1
                if symbol == REPORT:
                    for match in quoted:
                        match[0] = REPORTED
                    left = 0
            if opens and not within:
                state, _ = GRAMMAR[state, QUOTE]
                quoted, within, left = [], QUOTATION, 0
            state, kind = GRAMMAR[state, symbol]
            if symbol == TARGET:
                clause_target = 1
            if symbol == THREAT:
                threats.append((kind, weight, within > 0))
            elif kind is not None:
                add(kind, weight, within > 0)
            if ends:
                state, _ = GRAMMAR[state, STOP]
                if clause_target:
                    for threat in threats:
                        add(*threat)
                threats, clause_target = [], 0
            if within:
                within -= 1
                if closes:
                    state, _ = GRAMMAR[state, QUOTE]
                    within, left = 0, AFTER_QUOTE
        if clause_target:
            for threat in threats:
                add(*threat)
        by = [[w for k, w in found if k == kind] for kind in range(len(KINDS))]
        return tuple(max(f) + math.log1p(sum(f) - max(f)) if f else 0.0 for f in by)


def _forms(word, lengths):
    yield "=" + word
    for n in lengths:
        if len(word) > n:
            yield word[:n]


def _sample(docs, labels, per_class) -> DataFrame:
    """At most `per_class` labelled texts of each class, one for each id, in an order that only ids decide."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_class = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = by_class[0].unionByName(by_class[1])
    # At most 2 * per_class rows of two numbers, and one text for each.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return cut(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def _evidence(bad: Column, good: Column, share: float) -> Column:
    """How unlikely it is (in nats) that `bad` of `bad + good` are toxic, where `share` of all are."""
    n = (bad + good).cast("double")
    p = bad / n
    rest = F.when(good > 0, good * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return F.when(p > share, bad * F.log(p / share) + rest).otherwise(0.0)


def learn_lexicon(sample: DataFrame, share: float, lengths=(4, 5, 6, 7), least=3, evidence=4.0, precision=0.95):
    """Weights of whole words and of beginnings. Documents with a form are counted first; of the
    forms left, the different words before them, so that copies of a text count once. A form needs
    `least` of them and an `evidence` that follows from the `share` of toxic documents, the same rule
    for any number of labels. All forms that meet it are kept; there are no more than the words of the
    sample, which is bounded, have."""
    def counted(batches):
        for b in batches:
            hits = (Counter(), Counter())
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = {normal_form(w) for w in words_of(text or "")}
                hits[toxic].update({f for w in words if len(w) > 2 for f in _forms(w, lengths)})
            # Forms of clean documents alone can never be chosen.
            forms = list(hits[1])
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array([hits[1][f] for f in forms], pa.int64())],
                                             names=["form", "toxic"])

    common = (sample.filter("toxic = 1").mapInArrow(counted, "form string, toxic bigint")
              .groupBy("form").agg(F.sum("toxic").alias("n"))
              .filter((F.col("n") >= least) & (_evidence(F.col("n"), F.lit(0), share) >= evidence)))
    common_rows = common.collect()
    candidates = frozenset(r.form for r in common_rows)
    if not candidates:
        return {}, {}

    def clean(batches):
        for b in batches:
            hits = Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                if not toxic:
                    words = {normal_form(w) for w in words_of(text or "")}
                    hits.update({f for w in words if len(w) > 2 for f in _forms(w, lengths) if f in candidates})
            yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.string()), pa.array(list(hits.values()), pa.int64())],
                                             names=["form", "clean"])

    common = {r.form: r.n for r in common_rows}
    n_clean = sample.mapInArrow(clean, "form string, clean bigint").groupBy("form").agg(F.sum("clean").alias("n")).collect()
    for r in n_clean:
        if common[r.form] < precision * (common[r.form] + r.n):
            del common[r.form]
    candidates = frozenset(common)

    def contexts(batches):
        for b in batches:
            rows = set()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                before = ""
                for w in map(normal_form, words_of(text or "")):
                    if len(w) > 2:
                        for f in _forms(w, lengths):
                            if f in candidates:
                                rows.add((f, before, toxic))
                    before = w
            f, c, t = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(c, pa.string()), pa.array(t, pa.int32())],
                                             names=["form", "context", "toxic"])

    seen = sample.mapInArrow(contexts, "form string, context string, toxic int").distinct()
    counts = (seen.groupBy("form").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
              .filter((F.col("bad") >= least) & (_evidence(F.col("bad"), F.col("good"), share) >= evidence)
                      & (F.col("bad") >= precision * (F.col("bad") + F.col("good") + 0.25)))
              .orderBy("form").collect())
    weight = {r.form: math.log((r.bad + 0.5) / (r.good + 0.5)) for r in counts}
    top = max(weight.values(), default=1.0)
    stems, words = {}, {}
    for form in sorted(weight, key=len):
        if form.startswith("="):
            continue
        if not any(form[:n] in stems for n in range(1, len(form))):
            stems[form] = min(1.0, 0.5 + weight[form] / (2 * top))
    for form, w in weight.items():
        if form.startswith("=") and not any(form[1:n + 1] in stems for n in range(1, len(form))):
            words[form[1:]] = min(1.0, 0.5 + w / (2 * top))
    return words, stems


def _logistic(x, y, prior, strength=1.0, steps=400):
    """Weights that fit best and stay near the prior where the data say little (Newton's method)."""
    n, k = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    weight = np.where(y == 1, n / (2 * max(y.sum(), 1)), n / (2 * max((1 - y).sum(), 1)))
    target = np.array([*prior, -3.0])
    beta, pull = target.copy(), np.array([strength] * k + [0.05])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - pull * (beta - target)
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, beta[:k])), float(beta[k])


def fit(docs: DataFrame, labels: DataFrame, per_class=8000) -> Model:
    """A model from at most `per_class` labelled documents of each class. `labels` has the columns
    doc_id and toxic and only the rows that may be learned from."""
    default = Model(dict.fromkeys(SEEDS, 1.0), {}, PRIOR, -3.0)
    sample = _sample(docs, labels, per_class)
    classes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return default
    words, stems = learn_lexicon(sample, classes[1] / sum(classes.values()))
    if not words and not stems:
        return default
    reader = Reader(words, stems)
    rows = map_texts(sample, lambda texts: [reader.features(t) for t in texts],
                     ", ".join(f"{k} double" for k in KINDS), keep=("toxic",)).toPandas()
    x, y = rows[list(KINDS)].to_numpy(float), rows["toxic"].to_numpy(float)
    weights, bias = _logistic(x, y, PRIOR)
    # A match never lowers a score, and an insult aimed at someone or a threat weighs as much as one
    # without an aim, also where no labelled text has any.
    weights = [max(w, 0.0) for w in weights]
    for kind in (TARGETED, THREATENED):
        weights[kind] = max(weights[kind], weights[PLAIN])
    return Model(words, stems, tuple(weights), bias)


def score_toxicity(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """The kept columns, the score (0 to 1) and the match weights by kind of every whole text."""
    reader = Reader(model.words, model.stems)

    def kernel(texts):
        return [(model.score(f), *f) for f in map(reader.features, texts)]

    return map_texts(docs, kernel, "score double, " + ", ".join(f"{k} double" for k in KINDS), keep)


def reject_toxic(docs: DataFrame, model: Model, threshold=0.7) -> DataFrame:
    """The rows of `docs` with all columns whose score stays below the threshold."""
    reader = Reader(model.words, model.stems)

    def run(batches):
        for b in batches:
            keep = [model.score(reader.features(t or "")) < threshold for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
