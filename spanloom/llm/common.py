"""What several operators share: scratch tables, word splitting, let-bindings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the white-space kind are runs of characters outside this class.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Words of the letter kind are runs of characters outside this class, after A-Z is lower-cased.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Items of one list that scanned() appends to.
SCAN = 256


class Scratch:
    """Tables written to the shared checkpoint folder, so that lineage is cut and any executor may be lost.

    The folder is spark.checkpoint.dir as the session has it; only where that
    is unset in a local run (tests) a folder below the warehouse is used. On a cluster it must be set.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that the executors share")
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.root = f"{root.rstrip('/')}/spanloom-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, tag: str) -> str:
        self._n += 1
        if self._n == 1:
            fs, p = self._fs(self.root)
            fs.deleteOnExit(p)
        return f"{self.root}/{self._n:03d}-{tag}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for df in frames:
            for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                fs, p = self._fs(name)
                fs.delete(p, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row: Catalyst inlines plain aliases into lambdas."""
    return F.transform(F.array(value), body)[0]


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column], Column], kind: str) -> Column:
    """emit(state) after each item, in order, of states made by step(state, item) from zero.

    Lists are made SCAN items at a time, so that appending does not copy all that came before.
    """
    last = (F.size(items) - 1).cast("int")
    blocks = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(SCAN)))
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def block(state: Column, at: Column) -> Column:
        each = lambda a, x: let(step(a["state"], x), lambda new: F.struct(new.alias("state"), F.array_append(a["out"], emit(new)).alias("out")))
        return F.aggregate(F.slice(items, at + 1, F.lit(SCAN)), F.struct(state.alias("state"), none.alias("out")), each)

    every = lambda a, at: let(block(a["state"], at), lambda done: F.struct(done["state"].alias("state"), F.array_append(a["outs"], done["out"]).alias("outs")))
    return F.aggregate(blocks, F.struct(zero.alias("state"), nothing.alias("outs")), every, lambda a: F.flatten(a["outs"]))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Words split at white space (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def letter_words(text: Column) -> Column:
    """Lower-cased words of digits, a-z and non-ASCII characters (null: none)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of a table broadcast at most.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, width: Column | int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table, hinted for a broadcast only if its rows have at most that many bytes in all; otherwise the join shuffles.

    width is a row's size: a number, or an expression for the parts that vary.
    """
    size = df.count() * width if isinstance(width, int) else df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def text_bytes(c: Column) -> Column:
    """Size of a list of strings, with what the list itself takes."""
    return F.octet_length(F.array_join(c, "")) + 24 * F.size(c)
