"""Joins across layers; every key starts with the process."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_overlap(left: DataFrame, right: DataFrame, keys: list[str], bucket: int | None = None) -> DataFrame:
    """Pairs with equal keys whose half-open ranges [l_s, l_e) and [r_s, r_e) overlap; empty ranges overlap nothing.

    With bucket the ranges are dealt into cells of that width and joined on key and
    cell, so one hot key spreads over many tasks; a pair is kept in the cell where
    the overlap starts, which is one cell, so none is doubled.
    """
    left, right = left.where("l_s < l_e"), right.where("r_s < r_e")
    overlap = (F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e"))
    if bucket is None:
        joined = left.join(right, keys).where(overlap)
    else:
        cells = lambda s, e: F.explode(F.sequence(F.call_function("div", F.col(s), F.lit(bucket)), F.call_function("div", F.col(e) - 1, F.lit(bucket))))
        joined = left.withColumn("_cell", cells("l_s", "l_e")).join(right.withColumn("_cell", cells("r_s", "r_e")), [*keys, "_cell"]).where(overlap)
        joined = joined.where(F.col("_cell") == F.call_function("div", F.greatest("l_s", "r_s"), F.lit(bucket))).drop("_cell")
    return joined.withColumn("overlap", F.least("l_e", "r_e") - F.greatest("l_s", "r_s"))


def as_of(rows: DataFrame, states: DataFrame, keys: list[str], at: str = "timestamp_ns", since: str = "timestamp_ns", cell: int | None = None) -> DataFrame:
    """Each row with the state of its key that was last set at or before it; rows before the first state keep nulls.

    Both sides are sorted together once per key and the last state is carried
    forward, so there is no range join. Of states set in one instant the later-sorted one wins.
    With cell each key's time is cut into cells of that width, so one busy key spreads over many tasks;
    what holds at a cell's start is carried over from the cells before, one row per key and cell.
    """
    values = [c for c in states.columns if c not in keys and c != since]
    shape = F.struct(F.col(since).alias("valid_from"), *values)
    a = rows.select("*", F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(states.select(shape).schema[0].dataType).alias("_state"))
    b = states.select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_kind"), shape.alias("_state"))
    own = list(keys)
    if cell is not None:
        own.append("_cell")
        place = F.expr(f"(_at - pmod(_at, {cell}L)) div {cell}L")
        a, b = a.withColumn("_cell", place), b.withColumn("_cell", place)
        last = b.groupBy(*own).agg(F.max(F.struct("_at", "_state")).alias("_last"))
        cells = a.select(*own).distinct().join(last, own, "full")
        held = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        over = cells.withColumn("_held", held).where("_held IS NOT NULL").select(*own, (F.col("_cell") * cell).alias("_at"), F.lit(-1).alias("_kind"), F.col("_held._state").alias("_state"))
        b = b.unionByName(over)
    w = Window.partitionBy(*own).orderBy("_at", "_kind", "_state").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b, allowMissingColumns=True).withColumn("_state", F.last("_state", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select(*rows.columns, "_state.*")


def valid_paths(paths: DataFrame, keys: list[str], since: str = "timestamp_ns") -> DataFrame:
    """Paths with valid_from and valid_to: each holds until its connection's next one."""
    w = Window.partitionBy(*keys).orderBy(since)
    return paths.withColumn("valid_to", F.lead(since).over(w)).withColumnRenamed(since, "valid_from")


def address_join(paths: DataFrame, captured: DataFrame, endpoints: list[str], at: str = "timestamp_ns") -> DataFrame:
    """Captured datagrams with the connection whose path had their endpoints at that instant."""
    inside = (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return captured.join(paths, endpoints).where(inside)


def contained_time(outer: DataFrame, inner: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """outer (s, e) with the summed length of the inner intervals that lie inside it, and what remains."""
    i = inner.select(*keys, F.col("s").alias("is"), F.col("e").alias("ie"))
    hit = outer.join(i, [outer[k] == i[k] for k in keys] + [i["is"] >= outer["s"], i["ie"] <= outer["e"]], "left")
    cols = [outer[c] for c in outer.columns]
    return hit.groupBy(*cols).agg(F.coalesce(F.sum(F.col("ie") - F.col("is")), F.lit(0)).alias("nested_ns")).withColumn("exclusive_ns", F.col("e") - F.col("s") - F.col("nested_ns"))
