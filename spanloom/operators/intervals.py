"""Interval rules as window expressions, one sort per key.

All intervals are half-open [s, e). Where report order matters it is a column seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _before(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def poll_outcome(last: Column, err: Column) -> Column:
    """Only the completing poll that returned an error failed."""
    return F.when(last & err, "failed").otherwise("success")


def waits(polls: DataFrame, keys: list[str]) -> DataFrame:
    """Time between one poll's end and the next one's start."""
    w = Window.partitionBy(*keys).orderBy("s", "seq")
    return polls.withColumn("wait_s", F.lag("e").over(w)).where(F.col("wait_s").isNotNull()).select(*keys, "seq", F.col("wait_s").alias("s"), F.col("s").alias("e"))


def outermost(calls: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Intervals that no earlier one still covers."""
    reach = F.max("e").over(Window.partitionBy(*keys).orderBy("s", F.desc("e"), tie).rowsBetween(Window.unboundedPreceding, -1))
    return calls.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("_reach") <= F.col("s"))).drop("_reach")


def saturating_merge(rows: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """The first slots intervals as reported; later ones extend the last slot's end."""
    slot = F.least(F.row_number().over(Window.partitionBy(*keys).orderBy("seq")), F.lit(slots))
    return rows.withColumn("slot", slot).groupBy(*keys, "slot").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("merged"))


def innermost(scopes: DataFrame, points: DataFrame, keys: list[str], at: str, scope: str) -> DataFrame:
    """Points with the id (column scope) of the innermost scope [s, e) that is open at their instant; points outside every scope are left out.

    Scopes of one key (a thread) nest like calls; empty ones hold nothing. Scopes and points are sorted together once: a running
    sum of starts and ends is the depth, and the scope last opened at a point's depth is the one it is in.
    """
    row = lambda when, kind, delta, length, own: F.struct(when.alias("_at"), F.lit(kind).alias("_kind"), F.lit(delta).alias("_delta"), length.alias("_length"), own.alias("_own"))
    length, none = F.col("s") - F.col("e"), F.lit(None).cast(scopes.schema[scope].dataType)
    edges = scopes.where("s < e").select(*keys, F.explode(F.array(row(F.col("s"), 1, 1, length, F.col(scope)), row(F.col("e"), 0, -1, length, none))).alias("x")).select(*keys, "x.*")
    own = [c for c in points.columns if c not in keys]
    inside = points.select(*keys, F.col(at).alias("_at"), F.lit(2).alias("_kind"), F.lit(0).alias("_delta"), F.lit(0).cast("long").alias("_length"), F.struct(*own).alias("_point"))
    both = edges.unionByName(inside, allowMissingColumns=True)
    order = lambda *by: Window.partitionBy(*by).orderBy("_at", "_kind", "_length").rowsBetween(Window.unboundedPreceding, 0)
    deep = both.withColumn("_depth", F.sum("_delta").over(order(*keys)))
    found = deep.where("_delta >= 0").withColumn(scope, F.last("_own", ignorenulls=True).over(order(*keys, "_depth")))
    return found.where("_point IS NOT NULL AND _depth > 0").select(*keys, "_point.*", scope)


def publish_pieces(steps: DataFrame, wakes: DataFrame, keys: list[str], slots: int = 4) -> DataFrame:
    """A step cut by its wakes: step, notify, step, ..., step; the last piece carries the step's outcome. Empty pieces stay."""
    merged = saturating_merge(wakes, keys, slots)
    step = steps.select(*keys, F.col("s").alias("step_s"), F.col("e").alias("step_e"), F.col("outcome").alias("step_outcome"))
    # the closing piece is a row of its own after the wakes
    rows = merged.select(*keys, "slot", "s", "e").unionByName(step.select(*keys, F.lit(slots + 1).alias("slot"), F.col("step_e").alias("s"), F.lit(None).cast("long").alias("e"))).join(step, keys)
    order = Window.partitionBy(*keys).orderBy("slot")
    work = F.struct(F.lit("step").alias("piece"), F.coalesce(F.lag("e").over(order), F.col("step_s")).alias("s"), F.col("s").alias("e"), F.when(F.col("e").isNull(), F.col("step_outcome")).otherwise("success").alias("outcome"))
    notify = F.struct(F.lit("notify").alias("piece"), F.col("s").alias("s"), F.col("e").alias("e"), F.lit("success").alias("outcome"))
    both = rows.select(*keys, "slot", "e", work.alias("work"), notify.alias("notify"))
    return both.select(*keys, "slot", F.explode(F.array_compact(F.array("work", F.when(F.col("e").isNotNull(), F.col("notify"))))).alias("x")).select(*keys, "slot", "x.*")


def notify_gaps(fanouts: DataFrame, excluded: DataFrame, keys: list[str], slots: int = 8) -> DataFrame:
    """What is left of [s, e) of a fan-out after its exclusions, in report order.

    An exclusion is clamped to the end of those kept before it and lost if nothing
    remains; from the last slot on, ends overwrite. A fan-out without a start or a close has none.
    """
    span = fanouts.where(F.col("s").isNotNull() & F.col("e").isNotNull()).select(*keys, F.col("s").alias("start"), F.col("e").alias("close"))
    x = excluded.join(span, keys)
    past = _before(keys, "seq")
    floor = F.greatest("start", F.max(F.when(F.col("e") > F.col("s"), F.col("e"))).over(past))
    x = x.withColumn("cs", F.greatest("s", floor)).where(F.col("e") > F.col("cs"))
    x = x.withColumn("slot", F.least(F.row_number().over(Window.partitionBy(*keys).orderBy("seq")), F.lit(slots)))
    kept = x.groupBy(*keys, "slot").agg(F.min("cs").alias("cs"), F.max("e").alias("xe")).join(span, keys).where(F.col("cs") < F.col("close"))
    # one more row per fan-out closes it, also where nothing was excluded
    rows = kept.select(*keys, "slot", "cs", "xe", "start").unionByName(span.select(*keys, F.lit(slots + 1).alias("slot"), F.col("close").alias("cs"), F.lit(None).cast("long").alias("xe"), "start"))
    left = F.coalesce(F.lag("xe").over(Window.partitionBy(*keys).orderBy("slot")), F.col("start"))
    return rows.withColumn("s", left).where(F.col("s") < F.col("cs")).select(*keys, "s", F.col("cs").alias("e"))


def first_closes(fanouts: DataFrame, closes: DataFrame, excluded: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fan-outs (s) with their end, the first close by report order (seq), and the exclusions reported before it; one that never began is never closed."""
    first = closes.groupBy(*keys).agg(F.min_by("at", "seq").alias("e"), F.min("seq").alias("_closed"))
    ended = fanouts.join(first, keys, "left").withColumn("e", F.when(F.col("s").isNotNull(), F.col("e")))
    before = excluded.join(ended.select(*keys, "_closed"), keys).where(F.col("_closed").isNull() | (F.col("seq") < F.col("_closed"))).drop("_closed")
    return ended.drop("_closed"), before


def kept_exclusions(fanouts: DataFrame, excluded: DataFrame, keys: list[str], slots: int = 8) -> DataFrame:
    """keys, s, e and the exclusions held for each fan-out, in order: two of equal columns are the same fan-out."""
    span = fanouts.select(*keys, "s", "e")
    x = excluded.withColumnsRenamed({"s": "xs", "e": "xe"}).join(span.where(F.col("s").isNotNull()), keys)
    floor = F.greatest("s", F.max(F.when(F.col("xe") > F.col("xs"), F.col("xe"))).over(_before(keys, "seq")))
    x = x.withColumn("cs", F.greatest("xs", floor)).where(F.col("xe") > F.col("cs"))
    x = x.withColumn("slot", F.least(F.row_number().over(Window.partitionBy(*keys).orderBy("seq")), F.lit(slots)))
    merged = x.groupBy(*keys, "slot").agg(F.min("cs").alias("cs"), F.max("xe").alias("xe"))
    held = merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "cs", "xe"))).alias("held"))
    return span.join(held, keys, "left").withColumn("held", F.coalesce(F.transform("held", lambda h: F.struct(h["cs"].alias("s"), h["xe"].alias("e"))), F.array().cast("array<struct<s:bigint,e:bigint>>")))


def notify_spans(gaps: DataFrame, inbound: DataFrame, keys: list[str]) -> DataFrame:
    """Each gap as a notify span, a success, on the inbound object that fanned out; only on objects that record phases (column records)."""
    own = inbound.where("records").drop("records")
    spans = gaps.join(own, keys).withColumnsRenamed({"s": "start_ns", "e": "end_ns"})
    return spans.withColumns({"phase": F.lit("notify"), "outcome": F.lit("success")})


def copy_work(scopes: DataFrame, begins: DataFrame, ends: DataFrame, thread: list[str], scope: str, copy: str) -> DataFrame:
    """What each copy's work excludes, and from which fan-out: the first start marked while a fan-out was active, to the end, from the fan-out active at the end.

    begins: thread, copy, seq, called_ns, s; ends: thread, copy, e.
    """
    marked = innermost(scopes, begins, thread, "called_ns", scope)
    first = marked.groupBy(*thread, copy).agg(F.min_by("s", "seq").alias("s"))
    return innermost(scopes, ends.join(first, [*thread, copy]), thread, "e", scope)


def union_length(rows: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Sum and union length of each key's intervals; overlaps count once in the union."""
    reach = F.max("e").over(_before(keys, "s", "e", tie))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(reach, F.col("s"))))
    return rows.withColumn("_new", new).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("total_ns"), F.sum("_new").alias("wall_ns"))


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of touching or overlapping intervals."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(_before(keys, "s", "e"))
    cut = rows.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
