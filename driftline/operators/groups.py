"""Joining rows to a per-group value when a few groups may hold a large share of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A group is hot above this share of all rows, so there are never more hot groups than this.
HOT_GROUPS = 1000


def lookup_groups(rows: DataFrame, groups: DataFrame, keys, n="n", hot_groups=HOT_GROUPS) -> DataFrame:
    """Left join `rows` to `groups` (one row per key with the row count in column `n`).

    `groups` is read three times and should be cheap to make (an aggregate over a written table).
    Groups with more than 1/`hot_groups` of all rows are joined by broadcast: there are fewer than
    `hot_groups` of them, whatever the data. All others are joined by shuffle, where no key then
    holds more than that share; rows already served get a scattered key so that they do not pile up.
    Nothing runs before an action does.
    """
    keys = list(keys)
    values = [c for c in groups.columns if c not in (*keys, n)]
    total = groups.agg(F.sum(n)).scalar()
    hot = groups.filter(F.col(n) * hot_groups > total).select(*keys, F.struct(*values).alias("_hot"))
    cold = groups.filter(F.col(n) * hot_groups <= total).select(
        *keys, F.lit(0).alias("_s"), F.struct(*values).alias("_cold"))
    scatter = F.when(F.col("_hot").isNull(), 0).otherwise(
        1 + F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in keys]), F.lit(4096)).cast("int"))
    out = (rows.join(F.broadcast(hot), keys, "left")
               .withColumn("_s", scatter)
               .join(cold, [*keys, "_s"], "left"))
    hit = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[hit[v].alias(v) for v in values])
