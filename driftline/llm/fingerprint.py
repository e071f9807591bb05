"""Merkle fingerprints of documents, by column functions alone.

A document is a tree: the root over sections, a section over paragraphs (lines), a paragraph over
clauses. A section ends after a paragraph whose hash divides by SECTION, so an edit moves no
section border but those beside it. Every node is the SHA-256 of the full hashes of its children, so
equal roots mean equal texts. Only what is written out is shortened: below the root, hashes serve to
compare the branches of two trees.

The fingerprint is one string: the root, then per section its paragraphs and per paragraph its clauses,
each as `hash:characters`. It is the same for equal texts, and two of them can
be compared without the texts.

Two fingerprints are compared from the top down. Branches that both have, as often as both have them,
are set aside, sections first; the paragraphs of the sections left are compared the same way, and then
the clauses of the paragraphs left. What is left of clauses is where the texts differ. A branch
counts in full where the branch before it is the same as well, and by half where it stands elsewhere.

Defined cases: null is the empty text; an empty text has one section with one empty paragraph;
blank lines are paragraphs; repeated rows and ids have a fingerprint each; the order of rows with
equal ids is that of their texts; very long texts are one row, and the work grows with their length
times its logarithm; an empty table gives an empty result. Only `doc_id` and `text` are read, other
columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators.ordered import Scan, ordered_scan
from driftline.session import cut

SECTION = 4
# Hexadecimal digits of inner nodes and of leaves as they are written; the root has all 64.
NODE = 16
REST = 64 - NODE
LEAF = 8
# A clause ends after a mark and white space.
CLAUSE_END = "(?<=[.!?;:,]\\s)|(?<=[。！？，])"


def _sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    """The whole tree as a string, every node as `hash:characters`:
    `root|section{paragraph(clause,clause)paragraph(clause)}section{...}`."""
    clauses = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.struct(
        F.length(p).alias("n"), F.transform(F.split(p, CLAUSE_END), lambda s: F.struct(_sha(s).alias("h"), F.length(s).alias("n"))).alias("c")))
    paragraphs = F.transform(clauses, lambda p: F.struct(
        _sha(F.array_join(F.transform(p["c"], lambda x: x["h"]), "")).alias("h"), p["n"].alias("n"),
        F.array_join(F.transform(p["c"], lambda x: F.concat(F.substring(x["h"], 1, LEAF), F.lit(":"), x["n"].cast("string"))), ",").alias("w")))
    # A section ends after a paragraph whose first hexadecimal digit divides by SECTION. The rest of its
    # hash stands behind a paragraph until its section is hashed.
    marked = F.array_join(F.transform(paragraphs, lambda p: F.concat(
        F.substring(p["h"], 1, NODE), F.lit(":"), p["n"].cast("string"), F.lit("("), p["w"], F.lit(")"), F.substring(p["h"], NODE + 1, REST),
        F.when(F.conv(F.substring(p["h"], 1, 1), 16, 10).cast("int") % SECTION == 0, "~\n").otherwise("~"))), "")
    sections = F.transform(F.filter(F.split(marked, "\n"), lambda s: s != ""), lambda s: F.struct(
        _sha(s).alias("h"), F.transform(F.filter(F.split(s, "~"), lambda p: p != ""), lambda p: F.substring(p, F.lit(1), F.length(p) - REST)).alias("p")))
    written = F.transform(sections, lambda s: F.struct(s["h"].alias("h"), F.concat(
        F.substring(s["h"], 1, NODE), F.lit(":"), _characters(s["p"], "(").cast("string"), F.lit("{"), F.array_join(s["p"], ""), F.lit("}")).alias("w")))
    # The root is over the full hashes of sections, each of which is over those of its paragraphs.
    # A list of one, so that the sections are worked out once for both uses.
    return F.get(F.transform(F.array(written), lambda w: F.concat(
        _sha(F.array_join(F.transform(w, lambda s: s["h"]), "")), F.lit("|"), F.array_join(F.transform(w, lambda s: s["w"]), ""))), 0)


def root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def _key(branch: Column, opener: str) -> Column:
    """`hash:characters` of a branch, without what is below it."""
    return F.substring_index(branch, opener, 1)


def _characters(branches: Column, opener: str) -> Column:
    return F.aggregate(branches, F.lit(0).cast("long"), lambda n, x: n + F.substring_index(_key(x, opener), ":", -1).cast("long"))


def _counted(branches: Column, keys: Column) -> Column:
    """Branches numbered among their equals, so that sets of them count as bags: `branch`, `branch#2`.
    Where some are equal, they meet by sorting and are taken in runs, so the work is that of the sort."""
    runs = F.regexp_extract_all(F.concat(F.array_join(F.array_sort(branches), "\n"), F.lit("\n")), F.lit("(([^\\n]++\\n)\\2*+)"), F.lit(1))
    numbered = F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(1), (F.length(r) / F.instr(r, "\n")).cast("int")),
        lambda k: F.concat(F.substring_index(r, "\n", 1), F.when(k == 1, "").otherwise(F.concat(F.lit("#"), k.cast("string")))))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), branches).otherwise(numbered)


def _after(keys: Column) -> Column:
    """Every key with the one before it in front."""
    return F.transform(keys, lambda x, k: F.concat(F.when(k == 0, "").otherwise(F.get(keys, k - 1)), F.lit(">"), x))


# Levels of the tree: what a branch is cut off by, and what opens what is below it ("#" stands for nothing).
LEVELS = (("\\}", "{"), ("\\)", "("), (",", "#"))


def compare(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """`rows` with the likeness (0 to 1) of the fingerprints in columns `a` and `b` in column `name`, and in
    `name_left` the clauses of `a` that `b` lacks, as often as it lacks them: where a text was edited."""
    columns = rows.columns
    # Each step is a column of its own, so that it is worked out once. Level 0 has one branch, the tree.
    step = rows.withColumns({"_a0": F.array(a), "_b0": F.array(b)})
    shared, total, above = F.lit(0), None, "|"
    for k, (end, opener) in enumerate(LEVELS, 1):
        # What is below the branches left so far, in their order.
        step = step.withColumns({f"_{x}s{k}": F.flatten(F.transform(f"_{x}{k - 1}", lambda y: F.filter(
            F.split(F.substring_index(F.substring_index(y, above, -1), "#", 1), end), lambda z: z != ""))) for x in "ab"})
        step = step.withColumns({f"_{x}k{k}": F.transform(f"_{x}s{k}", lambda y: _key(y, opener)) for x in "ab"})
        # Trees without a common branch here keep all of them for the level below.
        step = step.withColumn(f"_meet{k}", F.arrays_overlap(f"_ak{k}", f"_bk{k}"))
        meet = F.col(f"_meet{k}")
        step = step.withColumns({f"_{x}c{k}": F.when(meet, _counted(F.col(f"_{x}s{k}"), F.col(f"_{x}k{k}"))) for x in "ab"} | {
            f"_{x}o{k}": F.when(meet, _after(F.col(f"_{x}k{k}"))) for x in "ab"})
        step = step.withColumns({f"_{x}{k}": F.when(meet, F.array_except(f"_{x}c{k}", f"_{y}c{k}")).otherwise(F.col(f"_{x}s{k}"))
                                 for x, y in ("ab", "ba")})
        own = _characters(F.col(f"_ak{k}"), opener)
        total = own + _characters(F.col(f"_bk{k}"), opener) if total is None else total
        # Both sides have what they share, and each counts twice: by itself and behind its predecessor.
        orders = [_counted(F.col(f"_{x}o{k}"), F.col(f"_{x}o{k}")) for x in "ab"]
        behind = F.transform(F.array_intersect(*orders), lambda y: F.substring_index(y, "#", 1))
        step = step.withColumn(f"_m{k}", F.when(meet, own - _characters(F.transform(f"_a{k}", lambda y: F.substring_index(y, "#", 1)), opener)
                                                + _characters(behind, opener)).otherwise(0))
        shared, above = shared + F.col(f"_m{k}"), opener
    like = (F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), 1.0)
            .when(total > 0, F.least(shared / total, F.lit(1.0))).otherwise(0.0))
    left = F.transform("_a3", lambda x: F.substring_index(x, "#", 1))
    return step.select(*columns, like.alias(name), left.alias(f"{name}_left"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))


FIRST = -(1 << 63)


def _previous(keyed: DataFrame) -> DataFrame:
    """(key, before, n_before): for every id the one before it (the last before the first) and the
    length of its longest text. Only ids and lengths are ordered."""
    ids = keyed.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    seen = cut(ordered_scan(ids, [], ["key"], {
        "before": Scan("last", F.col("key"), before=True), "n_before": Scan("last", F.col("n"), before=True)}))
    last = seen.agg(F.max_by(F.struct("key", "n"), "key").alias("last")).scalar()
    return seen.select("key", F.coalesce("before", last["key"]).alias("before"), F.coalesce("n_before", last["n"]).alias("n_before"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Every row beside an edited text: its last half is replaced by the beginning of the next
    document's. Documents are ordered by id, a null id first; where an id repeats, all its rows have
    the same next document, and of a repeated next document the text with the smallest fingerprint
    counts.

    A text is shuffled once by its id; then its fingerprint and as much of its beginning as the
    document before can use go to that document.
    """
    # Both uses below read the same two columns, so that they share one exchange of the texts.
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    begun = (keyed.join(_previous(keyed).hint("shuffle_hash"), "key")
             .select(F.col("before").alias("key"), F.substring("text", F.lit(1), F.floor(F.col("n_before") / 2).cast("int")).alias("begin"),
                     fingerprint(F.col("text")).alias("next_fingerprint"))
             .withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy("next_fingerprint"))).filter("_r = 1").drop("_r"))
    half = F.floor(F.col("n") / 2).cast("int")
    made = (keyed.join(begun, "key", "left").withColumn("n", F.length("text"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("begin", F.lit(1), half)))
            .select(F.nullif("key", F.lit(FIRST)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
                    fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
                    "next_fingerprint"))
    made = compare(compare(made, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
