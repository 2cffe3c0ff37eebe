"""Exact quantiles without a sort of all values and without a buffer of them.

A mergeable sketch (counts of values by their leading bits) tells which bucket
holds each wanted rank; only the values of those buckets are counted one by
one. So a group of any size needs a table of at most 64 * 2**BITS counts, and a
rank is looked up among the different values of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading bits of a value that a bucket keeps.
BITS = 11


def _bucket(v: Column) -> Column:
    """The value with all but its leading bits cleared; its sign is kept, so buckets are in the values' order."""
    size = F.abs(v)
    low = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    return F.signum(v).cast("long") * F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys and, per name of wanted, that quantile of value (a long), interpolated between neighbours as SQL's continuous percentile is; nulls are left out."""
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), _bucket(F.col(value)).alias("_b"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    sketch = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).withColumns({"_upto": upto, "_all": F.sum("_n").over(group)})
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"), part.alias("part")) for name, q in wanted.items() for rank, part in _ranks(q)])).alias("x")
    ranks = sketch.select(*keys, "_b", "_n", "_upto", asked).select(*keys, "_b", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", "x.*").where("rank >= _before AND rank < _upto")
    values = rows.join(ranks.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_m"))
    reached = values.withColumn("_r", F.sum("_m").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = reached.join(ranks, [*keys, "_b"]).where("rank - _before < _r AND rank - _before >= _r - _m")
    return hit.groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == name, F.col("part") * F.col("_v"))).alias(name) for name in wanted])


def _ranks(q: float) -> list[tuple[Column, Column]]:
    """The two ranks (from 0) that a quantile lies between, and the weight of each."""
    place = F.lit(q) * (F.col("_all") - 1)
    low = F.floor(place)
    return [(low, F.lit(1.0) - (place - low)), (F.least(low + 1, F.col("_all") - 1), place - low)]
