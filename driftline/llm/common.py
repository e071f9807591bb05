"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def bounded_batches(spark, rows=1000, size="8m") -> None:
    """Bound the Arrow batches by rows and by bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def texts_of(batch: pa.RecordBatch, column="text") -> list[str]:
    """Texts of a batch; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


_SPLIT = re.compile(SPACE_RE)
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+`. str.split() also splits at other white space, so it serves only
    where there is none of it."""
    if _OTHER_SPACE.search(text):
        return [w for w in _SPLIT.split(text) if w]
    return text.split()


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def append_columns(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def map_texts(docs: DataFrame, kernel, schema: str, keep=("doc_id",)) -> DataFrame:
    """Rows of `kernel(list of texts)` (a list of tuples, one per text) beside the kept columns."""
    bounded_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    types = T.StructType.fromDDL(schema)
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [schema])
    names = [f.name for f in types]
    kinds = [_arrow(f.dataType.simpleString()) for f in types]
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = kernel(texts_of(b))
            cols = list(zip(*rows)) if rows else [() for _ in names]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*kept, *names])

    return docs.select(*kept, "text").mapInArrow(run, out)


def _arrow(kind: str) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
              "boolean": pa.bool_(), "binary": pa.binary()}
    if kind in simple:
        return simple[kind]
    inner = kind.removeprefix("array<")[:-1]
    return pa.list_(simple[inner])
