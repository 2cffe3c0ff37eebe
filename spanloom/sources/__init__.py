"""Event tables on disk: one folder per event, Parquet, read with fixed schemas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, masks
from ..schemas import EVENTS, decoded_schema, raw_schema


def read_event(spark: SparkSession, root: str, event: str, raw: bool = True) -> DataFrame:
    """One event's table, decoded; the schema is given, never inferred."""
    if raw:
        return decode(spark.read.schema(raw_schema(event)).parquet(f"{root}/event={event}"), event)
    return spark.read.schema(decoded_schema(event)).parquet(f"{root}/event={event}")


def write_events(stream: DataFrame, root: str, mode: str = "append") -> None:
    """A tagged stream (column event) into one folder per event."""
    stream.write.mode(mode).partitionBy("event").parquet(root)


def tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several events as one stream with a column event; columns that an event lacks are null."""
    unknown = set(tables) - set(EVENTS)
    if unknown:
        raise ValueError(f"no such events: {sorted(unknown)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("event", F.lit(name)) for name, t in tables.items()])


def enabled(stream: DataFrame, events: list[str]) -> DataFrame:
    """Rows of the enabled events; on disk this prunes folders."""
    return stream.where(F.col("event").isin(events))


@dataclass(frozen=True)
class Wrapper:
    """One event's pair of calls: whether it is enabled, and emitting rows of it."""

    event: str

    def enabled(self, mask: Column) -> Column:
        return masks.enabled(mask, self.event)

    def emit(self, rows: DataFrame, mask: Column | None = None) -> DataFrame:
        """rows as a tagged stream of this event, less those whose mask has it off; a column that is no column of the event is an error."""
        unknown = set(rows.columns) - set(decoded_schema(self.event).names)
        if unknown:
            raise ValueError(f"{self.event} has no columns {sorted(unknown)}")
        return tagged({self.event: rows if mask is None else rows.where(self.enabled(mask))})


def wrappers() -> dict[str, Wrapper]:
    return {event: Wrapper(event) for event in EVENTS}


def counters(stream: DataFrame) -> DataFrame:
    """Per event of a tagged stream (event, timestamp_ns, edge): clock readings, one an event, and span ids, one a start edge."""
    return stream.groupBy("event").agg(F.count("timestamp_ns").alias("clock_reads"), F.count_if(F.coalesce(F.col("edge") == "start", F.lit(False))).alias("span_ids"))


def recording(spark: SparkSession, event: str, rows: list[tuple]) -> DataFrame:
    """An in-memory table of one event, oldest first."""
    return spark.createDataFrame(rows, decoded_schema(event))


def discard(df: DataFrame) -> None:
    """Runs a plan without keeping its rows."""
    df.write.format("noop").mode("overwrite").save()
