import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import prose  # noqa: E402

from driftline.session import checkpoint_dir  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs; further columns follow from them."""
    checkpoint_dir(spark)

    def docs(rows, schema=DOCS):
        full = [(i, t, "en", f"host{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, schema)
    return docs


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows, white space, a very long text."""
    long = prose(5, 60_000)
    return [(1, "one two three four five six"), (2, None), (3, ""), (None, "no id at all"), (4, " \t\n\r "), (5, long),
            (6, "one two three four five six"), (6, "one two three four five six"), (7, "émigré naïve Straße 東京 \U0001f600 é"),
            (8, "x"), (None, None)]
