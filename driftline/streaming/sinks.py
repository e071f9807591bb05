"""Idempotent stream sinks: every micro-batch overwrites its own folder, so a retried batch
leaves no duplicates; readers take the newest row per key where rows are updated."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import scratch
from driftline.sources.tables import folder_names, remove_folder, table_exists, table_folder, write_table


def write_batches(stream: DataFrame, path: str, mode="append", transform=None, name=None, **trigger):
    """Start a query that writes each micro-batch to `path/batch=<id>`."""
    def save(df, batch_id):
        (transform(df) if transform else df).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
    w = (stream.writeStream.outputMode(mode).foreachBatch(save)
         .option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})))
    return (w.queryName(name) if name else w).start()


def read_batches(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*schema.names)


def read_latest(spark, path: str, schema, keys) -> DataFrame:
    """Newest version of each key over all micro-batches: those folded by `compact`, and the later ones."""
    folded = _folded(spark, path, schema)
    rows = spark.read.schema(f"{_ddl(schema)}, batch bigint").parquet(f"{path}/rows")
    if folded is not None:
        done = folded.agg(F.max("upto")).first()[0]
        rows = rows.filter(F.col("batch") > done).unionByName(folded.filter("batch IS NOT NULL").drop("upto"))
    return _newest(rows, schema, keys).drop("batch")


def _newest(rows: DataFrame, schema, keys) -> DataFrame:
    values = [f.name for f in schema if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"), F.max("batch").alias("batch"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values], "batch")


def _folded(spark, path: str, schema):
    """The newest folded table, or None. Besides its rows, it has one without a batch that tells, in
    `upto`, the last micro-batch it holds."""
    if not table_exists(spark, f"{path}/folded"):
        return None
    return spark.read.schema(f"{_ddl(schema)}, batch bigint, upto bigint").parquet(table_folder(spark, f"{path}/folded"))


def finished_batches(spark, path: str) -> list[int]:
    """Numbers of the micro-batches whose folders are complete."""
    rows = [n.removeprefix("batch=") for n in folder_names(spark, f"{path}/rows") if n.startswith("batch=")]
    return sorted(int(n) for n in rows if "_SUCCESS" in folder_names(spark, f"{path}/rows/batch={n}"))


def compact(spark, path: str, schema, keys) -> int:
    """Fold all finished micro-batches of an updating stream into one versioned table, so that reading
    does not slow down with their number. Returns the last micro-batch folded, or -1.

    The table is replaced as a whole and says itself up to where it goes: a fold that fails changes
    nothing, and one that is repeated, or overtaken by a retried micro-batch, gives the same rows.
    Folders are deleted only once the version before has folded them, so no reader loses them."""
    folded, finished = _folded(spark, path, schema), finished_batches(spark, path)
    done = -1 if folded is None else folded.agg(F.max("upto")).first()[0]
    new = [n for n in finished if n > done]
    if not new:
        return done
    rows = (spark.read.schema(f"{_ddl(schema)}, batch bigint").option("basePath", f"{path}/rows")
            .parquet(*[f"{path}/rows/batch={n}" for n in new]))
    if folded is not None:
        rows = rows.unionByName(folded.filter("batch IS NOT NULL").drop("upto"))
    none = F.lit(None)
    mark = spark.range(1).select(*[none.cast(f.dataType).alias(f.name) for f in schema], none.cast("bigint").alias("batch"),
                                 F.lit(new[-1]).cast("bigint").alias("upto"))
    whole = _newest(rows, schema, keys).withColumn("upto", none.cast("bigint"))
    write_table(whole.select(*mark.columns).unionByName(mark), f"{path}/folded")
    for n in finished:
        if n <= done:
            remove_folder(spark, f"{path}/rows/batch={n}")
    return new[-1]


def read_last_batch(spark, path: str, schema) -> DataFrame:
    """Rows of the last micro-batch: the whole result of a query in complete mode."""
    rows = spark.read.schema(f"{_ddl(schema)}, batch bigint").parquet(f"{path}/rows")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(last, "batch", "left_semi").drop("batch")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def drain(stream: DataFrame, mode="append", keys=None, name="stream", transform=None) -> DataFrame:
    """Process what is available and return the result as a batch table."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    write_batches(stream, path, mode, transform).awaitTermination()
    if mode == "complete":
        return read_last_batch(spark, path, stream.schema)
    return read_latest(spark, path, stream.schema, keys) if keys else read_batches(spark, path, stream.schema)


def fan_out(stream: DataFrame, sinks: dict, checkpoint: str, **trigger):
    """Write one stream to several tables, each with its own condition. `sinks` maps a path to a
    boolean column (None keeps all rows). The batch is computed once and filtered per sink."""
    def save(df, batch_id):
        df.persist()
        try:
            for path, keep in sinks.items():
                out = df if keep is None else df.filter(keep)
                out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            df.unpersist()
    return (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


# Log levels in rising order.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def at_least(level: str, col="level") -> Column:
    """Condition for a sink that takes entries of `level` and above."""
    return F.col(col).isin(*LEVELS[LEVELS.index(level):])
