"""Decoded trace text: one event a line, as trace readers print it, into typed tables.

A line looks like

    [14:03:05.123456789] (+0.000001234) host provider:event: { cpu_id = 3 }, { vpid = 71 }, { timestamp_ns = 100, trace_id = 1, direction = ( "rx" : container = 0 ) }

Braces before the last ones are context; an enumeration shows its label and its
code, or only the code where that is unknown. Lines that are no event of the
schemas are left out. Everything is column expressions over spark.read.text: no
Python per line, and one pass for any number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode
from ..schemas import ENUMS, EVENTS, raw_schema

_LINE = r"^\[[^\]]*\] (?:\([^)]*\) )?(?:(\S+) )?\w+:(\w+): (.*)$"


def _value(payload: Column, name: str) -> Column:
    """A field as text: a number, or the code of an enumeration."""
    return F.regexp_extract(payload, rf"(?:^|[\s,]){name} = (?:\( (?:[^:()]* : )?container = )?(-?[0-9]+)", 1)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The event lines of text files."""
    return event_lines(spark.read.text(path).select(F.col("value").alias("line")))


def event_lines(lines: DataFrame) -> DataFrame:
    """process_key (host and, where it is told, process), event and payload of every line that is an event."""
    line = lines.select("line").where(F.col("line").rlike(_LINE))
    part = lambda k: F.regexp_extract("line", _LINE, k)
    body = part(3)
    vpid = F.nullif(F.regexp_extract(body, r"\bvpid = ([0-9]+)", 1), F.lit(""))
    rows = line.select(F.concat_ws(":", F.nullif(part(1), F.lit("")), vpid).alias("process_key"), part(2).alias("event"), F.regexp_extract(body, r"\{([^{}]*)\}\s*$", 1).alias("payload"))
    return rows.where(F.col("event").isin(list(EVENTS)))


def event_rows(lines: DataFrame, event: str, raw: bool = False) -> DataFrame:
    """One event's table from read_lines(), decoded unless raw; a field that is missing, or no number, is null."""
    schema = raw_schema(event)
    columns = [_value(F.col("payload"), f.name).try_cast(f.dataType).alias(f.name) for f in schema if f.name != "process_key"]
    rows = lines.where(F.col("event") == event).select("process_key", *columns)
    return rows if raw else decode(rows, event)


def read_trace(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Every event's table, decoded."""
    lines = read_lines(spark, path)
    return {event: event_rows(lines, event) for event in EVENTS}


def written_line(event: str) -> Column:
    """A raw table's row as a line of decoded text."""
    shown = []
    for f in raw_schema(event):
        if f.name == "process_key":
            continue
        value, kind = F.col(f.name).cast("string"), dict((n, k) for part in EVENTS[event].split() for n, k in [part.rstrip("?").split(":")]).get(f.name)
        if kind in ENUMS:
            label = F.get(F.array(*map(F.lit, ENUMS[kind])), F.col(f.name).cast("int"))
            value = F.concat(F.lit("( "), F.coalesce(F.concat(F.lit('"'), label, F.lit('" : ')), F.lit("")), F.lit("container = "), value, F.lit(" )"))
        shown.append(F.concat(F.lit(f"{f.name} = "), value))
    return F.concat(F.lit("[00:00:00.000000000] (+0.000000001) "), F.col("process_key"), F.lit(f" provider:{event}: {{ cpu_id = 0 }}, {{ "), F.concat_ws(", ", *shown), F.lit(" }"))
