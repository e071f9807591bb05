"""Ordered include/exclude rules as Spark columns.

A rule becomes a boolean column of path and type, so filtering is row-local: no join and no
shuffle, also for directory pruning, where a row tests its own ancestors. Long rule tables are looked
up in an index instead (`functions.rules`), row by row as well.
"""

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import rules as long_rules
from driftline.functions.paths import ancestors

# A glob token; possessive parts so that an unterminated class falls through to a literal "[".
_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|\[!?+\]?+[^\]]*+\]|.", re.S)

# POSIX class names and their Java spelling.
_POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}",
    "lower": r"\p{Lower}", "space": r"\p{Space}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}",
}
_MAGIC = re.compile(r"[*?\[]")
# Chains above this many rules are looked up in an index.
INDEXED = 200


def _char_class(token: str) -> str:
    body = token[1:-1]
    negate = body[:1] in ("!", "^")
    body = body[1:] if negate else body
    # Java gives "[", "]", "&&" and "^" inside a class a meaning that a glob does not have.
    body = re.sub(r"([\[\]&^])", r"\\\1", body)
    return "[" + ("^" if negate else "") + body + "]"


def glob_regex(pattern: str) -> str:
    """Java regular expression of a glob without its leading and trailing slash rules."""
    named = re.compile(r"\[(!?)\[:(\w+):\]\]")
    out, pos = [], 0
    while pos < len(pattern):
        m = named.match(pattern, pos)
        if m and m.group(2) in _POSIX:
            out.append("[" + ("^" if m.group(1) else "") + _POSIX[m.group(2)] + "]")
            pos = m.end()
            continue
        tok = _TOKEN.match(pattern, pos).group()
        pos += len(tok)
        if tok == "**/":
            out.append(r"([^\n]*/)?")
        elif tok == "**":
            out.append(r"[^\n]*")
        elif tok == "*":
            out.append("[^/]*")
        elif tok == "?":
            out.append("[^/]")
        elif len(tok) > 1:
            out.append(_char_class(tok))
        else:
            out.append(re.escape(tok))
    return "".join(out)


def _parts(pattern: str):
    """(body, directories only, anchored, literal suffix after a leading star) of a pattern."""
    dir_only = pattern.endswith("/")
    body = pattern[:-1] if dir_only else pattern
    anchored = "/" in body
    body = body[1:] if body.startswith("/") else body
    rest = body[1:] if body.startswith("*") else ""
    return body, dir_only, anchored, "" if anchored or _MAGIC.search(rest) else rest


def _regex(body: str, anchored: bool, end: str) -> str:
    regex = ("^" if anchored else "(^|/)") + glob_regex(body)
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "a", regex))
    except re.error as e:
        raise ValueError(f"bad filter pattern {body!r}: {e}") from None
    return regex + end


def glob_col(pattern: str, path: Column = None, is_dir: Column = None) -> Column:
    """Does a path match an rsync-style glob? A trailing slash restricts it to directories, any
    other slash anchors it at the root, and without one it may start after any slash."""
    path = F.col("rel_path") if path is None else path
    is_dir = (F.col("file_type") == "dir") if is_dir is None else is_dir
    body, dir_only, anchored, suffix = _parts(pattern)
    if not _MAGIC.search(body):
        hit = path == body
        hit = hit if anchored else hit | path.endswith("/" + body)
    elif suffix:
        hit = path.endswith(suffix)
    else:
        hit = path.rlike(_regex(body, anchored, r"\z"))
    return (is_dir & hit) if dir_only else hit


def glob_above(pattern: str, path: Column = None) -> Column:
    """Does some directory above a path match the glob? The same tests, ending at a slash inside
    the path instead of at its end."""
    path = F.col("rel_path") if path is None else path
    body, _, anchored, suffix = _parts(pattern)
    if not _MAGIC.search(body):
        hit = path.startswith(body + "/")
        return hit if anchored else hit | path.contains("/" + body + "/")
    return path.contains(suffix + "/") if suffix else path.rlike(_regex(body, anchored, "/"))


def parse_rule(line: str):
    """`+ p` includes, `- p` or a bare pattern excludes; blank lines and `#` give None."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    if line[:2] in ("+ ", "- "):
        return line[0] == "+", line[2:].strip()
    return False, line


def size_bounds(min_size: int = 0, max_size: int = 0, size: Column = None, is_dir: Column = None):
    """Bounds for everything but directories; 0 leaves a bound unset."""
    size = F.col("size") if size is None else size
    is_dir = (F.col("file_type") == "dir") if is_dir is None else is_dir
    ok = F.lit(True)
    if min_size > 0:
        ok = ok & (size >= min_size)
    if max_size > 0:
        ok = ok & (size <= max_size)
    return is_dir | ok


@dataclass(frozen=True)
class FilterChain:
    """Size bounds first, then the rules in order: the first match decides, default include."""

    rules: tuple = field(default_factory=tuple)
    min_size: int = 0
    max_size: int = 0

    @property
    def empty(self) -> bool:
        return not self.rules and not self.min_size and not self.max_size

    def _index(self):
        """The index of a long chain, None for a short one."""
        if len(self.rules) <= INDEXED:
            return None
        parts = [(include, *_parts(pattern)) for include, pattern in self.rules]
        return long_rules.RuleIndex([(i, body, dirs, anchored, end, _regex(body, anchored, r"\z")) for i, body, dirs, anchored, end in parts])

    def _rules(self, path, is_dir) -> Column:
        if not self.rules:
            return F.lit(True)
        index = self._index()
        if index:
            return long_rules.matches(index, path, is_dir)
        case = None
        for include, pattern in self.rules:
            hit = glob_col(pattern, path, is_dir)
            case = F.when(hit, include) if case is None else case.when(hit, include)
        return case.otherwise(True)

    def matches(self, path=None, is_dir=None, size=None) -> Column:
        """True for entries that stay."""
        path = F.col("rel_path") if path is None else path
        is_dir = (F.col("file_type") == "dir") if is_dir is None else is_dir
        if not self.min_size and not self.max_size:
            return self._rules(path, is_dir)
        return size_bounds(self.min_size, self.max_size, size, is_dir) & self._rules(path, is_dir)

    def under_excluded_dir(self, path=None) -> Column:
        """True where an ancestor directory is excluded, i.e. a walk would not have come here.
        Row-local, because the verdict on a directory depends on its path alone. Without an
        include before an exclude, one look at the whole path answers for all its ancestors."""
        path = F.col("rel_path") if path is None else path
        includes = [include for include, _ in self.rules]
        excluded = [pattern for include, pattern in self.rules if not include]
        if not excluded:
            return F.lit(False)
        index = self._index()
        if index:
            return long_rules.under_excluded_dir(index, path)
        if includes == sorted(includes):
            return reduce(lambda a, b: a | b, [glob_above(p, path) for p in excluded])
        return F.exists(ancestors(path), lambda a: ~self._rules(a, F.lit(True)))

    def keeps(self, prune: bool) -> Column:
        return self.matches() & ~self.under_excluded_dir() if prune else self.matches()


def filter_chain(rules=(), min_size: int = 0, max_size: int = 0) -> FilterChain:
    """Chain from rule lines in order, or from a table (ord, rule)."""
    if isinstance(rules, DataFrame):
        # Rules are configuration, as a list of them would be.
        rules = [r["rule"] for r in rules.orderBy("ord").collect()]
    parsed = (parse_rule(r) if isinstance(r, str) else r for r in rules)
    return FilterChain(tuple(p for p in parsed if p), min_size, max_size)


def load_rules(*files: str, first=()) -> list:
    """Rule lines of filter files, after the rules given on the command line."""
    lines = list(first)
    for name in files:
        with open(name, encoding="utf-8") as f:
            lines += [x.rstrip("\n") for x in f]
    return lines
