"""First match in long rule tables by an index of their literal parts.

A chain of a few rules is a CASE of JVM expressions (`functions.globs`). Thousands of branches neither
compile nor run well, so longer chains look rules up: whole paths, names and endings in hash tables, and
other patterns by the literal characters they begin or end with; only patterns found there are tested.
The verdict is that of the chain: the first rule in order that matches.
"""

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters at the beginning or end of a pattern that are looked up, at most.
HEAD, TAIL = 8, 8
# Directories whose verdict a task remembers.
REMEMBERED = 100_000

# POSIX class names in Java and the ASCII characters they stand for.
_CLASSES = {
    "Alpha": "a-zA-Z", "Digit": "0-9", "Alnum": "a-zA-Z0-9", "Upper": "A-Z", "Lower": "a-z", "Space": r" \t\n\x0b\f\r",
    "Punct": r"!-/:-@\[-`{-~", "XDigit": "0-9a-fA-F",
}


class RuleIndex:
    """`rules` are (include, body, directories only, anchored, ending, Java regular expression), in
    order; `ending` is what follows the star of a pattern that is a star and literal characters."""

    def __init__(self, rules):
        self.includes, self.dirs, self.regex = [], [], []
        self.paths, self.names = defaultdict(list), defaultdict(list)
        self.endings, self.heads, self.starts, self.tails = ({} for _ in range(4))
        self.rest = []
        for k, (include, body, dir_only, anchored, ending, regex) in enumerate(rules):
            self.includes.append(include)
            self.dirs.append(dir_only)
            self.regex.append(None)
            head = re.match(r"[^*?\[]*", body).group()
            if head == body:
                (self.paths if anchored else self.names)[body].append(k)
                continue
            if ending:
                self._put(self.endings, ending, k)
                continue
            self.regex[k] = re.sub(r"\\p\{(\w+)\}", lambda m: _CLASSES[m[1]], regex).replace(r"\z", r"\Z")
            tail = re.search(r"[^*?\[\]]*\Z", body).group()
            if anchored and head:
                self._put(self.heads, head[:HEAD], k)
            elif head:
                self._put(self.starts, head[:HEAD], k)
            elif tail:
                self._put(self.tails, tail[-TAIL:], k)
            else:
                self.rest.append(k)
        self.known: dict[str, bool] = {}

    @staticmethod
    def _put(table, text, k):
        table.setdefault(len(text), {}).setdefault(text, []).append(k)

    def __getstate__(self):
        # Patterns are compiled where they are used, and memory starts empty.
        return {**self.__dict__, "regex": [r if r is None or isinstance(r, str) else r.pattern for r in self.regex], "known": {}}

    def _hits(self, path: str, k: int) -> bool:
        r = self.regex[k]
        if isinstance(r, str):
            r = self.regex[k] = re.compile(r)
        return r.search(path) is not None

    def keeps(self, path: str, is_dir: bool) -> bool:
        best = len(self.includes)

        def look(found, test):
            nonlocal best
            for k in found:
                if k >= best:
                    return
                if (is_dir or not self.dirs[k]) and (not test or self._hits(path, k)):
                    best = k
                    return

        look(self.paths.get(path, ()), False)
        look(self.names.get(path.rpartition("/")[2], ()), False)
        for n, table in self.endings.items():
            look(table.get(path[-n:], ()), False)
        for n, table in self.heads.items():
            look(table.get(path[:n], ()), True)
        for n, table in self.tails.items():
            look(table.get(path[-n:], ()), True)
        if self.starts:
            at = 0
            while True:
                for n, table in self.starts.items():
                    look(table.get(path[at:at + n], ()), True)
                at = path.find("/", at) + 1
                if not at:
                    break
        look(self.rest, True)
        return self.includes[best] if best < len(self.includes) else True

    def pruned(self, path: str) -> bool:
        """Is a directory above excluded?"""
        at = path.find("/")
        while at > 0:
            above = path[:at]
            kept = self.known.get(above)
            if kept is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                kept = self.known[above] = self.keeps(above, True)
            if not kept:
                return True
            at = path.find("/", at + 1)
        return False


def matches(index: RuleIndex, path: Column, is_dir: Column) -> Column:
    @F.arrow_udf(T.BooleanType())
    def kept(paths: pa.Array, dirs: pa.Array) -> pa.Array:
        return pa.array([None if p is None else index.keeps(p, bool(d)) for p, d in zip(paths.to_pylist(), dirs.to_pylist())], pa.bool_())
    return kept(path, is_dir)


def under_excluded_dir(index: RuleIndex, path: Column) -> Column:
    @F.arrow_udf(T.BooleanType())
    def pruned(paths: pa.Array) -> pa.Array:
        return pa.array([None if p is None else index.pruned(p) for p in paths.to_pylist()], pa.bool_())
    return pruned(path)
