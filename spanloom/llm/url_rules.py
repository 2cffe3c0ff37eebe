"""URL filters: a sort-merge range join of canonical keys against prefix rules.

The canonical key of a rule is its host with the labels reversed, a closing
dot, a NUL and its path: every URL it fits, under some suffix of its host, has
a key in the interval that starts with the rule's key. Rules nest, so walking
keys in order while a stack holds the rules whose interval is still open finds
the longest one.

URL keys and rules are dealt together into ranges of keys (cells). In each cell a
fold over its sorted rules keeps the stack: a rule closes those that do not prefix it and
opens itself. The rules still open where a cell begins come from the cells before: they are
the rules that prefix its first key, found by that key's prefixes alone. A URL key then takes
the stack of the last rule at or before it, and of that the last rule that prefixes it.

Distribution: URLs and their keys are made distinct before they are dealt, so neither a hot host
nor a path that many hosts share is more than one row in a cell. Each rule is in one cell.

Defined results: null or without `://`: host and path are empty strings, no
rule fits, and the verdict is the default. Ties between rules of equal length
go to the smaller rule string; repeated rows are all returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ascii_lower, read, scanned

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".\x00"), path)


RULE = "struct<rule:string,verdict:string>"
OPEN = f"struct<key:string,r:{RULE}>"


def _stacks(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of keys and rules dealt into cells (cell, key, r: null for URL keys): the stack at each cell's start, and the one after each rule."""
    rules = dealt.where("r IS NOT NULL").select("cell", "key", "r")
    first = dealt.groupBy("cell").agg(F.min("key").alias("first"))
    cuts = first.select(F.col("cell").alias("at"), F.explode(F.sequence(F.lit(1), F.length("first"))).alias("n"), "first").select("at", F.substring("first", F.lit(1), F.col("n")).alias("key"))
    before = rules.join(cuts, "key").where(F.col("cell") < F.col("at"))
    carried = before.groupBy(F.col("at").alias("cell")).agg(F.sort_array(F.collect_list(F.struct("key", "r"))).alias("open"))
    start = F.coalesce("open", F.array().cast(f"array<{OPEN}>"))
    own = rules.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("key", "r"))).alias("rules")).join(carried, "cell", "left")
    step = lambda a, x: F.struct(F.array_append(F.filter(a["open"], lambda o: x["key"].startswith(o["key"])), x).alias("open"))
    each = scanned(F.col("rules"), F.struct(start.alias("open")), step, lambda a: a["open"], f"array<{OPEN}>")
    return carried, own.select("cell", F.explode(each).alias("open")).select("cell", F.element_at("open", -1)["key"].alias("key"), "open")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """url, host, path, rule, verdict for each distinct URL."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col("url"))
    urls = scratch.write(pages.select(F.col(url).alias("url")).distinct().withColumn("host", host).withColumn("path", path), "urls")
    labels = F.reverse(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".\x00"), F.col("path")))
    keys = urls.where(F.col("host") != "").select("url", F.explode(suffixes).alias("key"))
    ruled = rules.select(ascii_lower("host").alias("host"), "path", "verdict").groupBy(_key(F.col("host"), F.col("path")).alias("key")).agg(F.min(F.struct(F.concat("host", "path").alias("rule"), "verdict")).alias("r"))
    both = keys.select("key").distinct().withColumn("r", F.lit(None).cast(RULE)).unionByName(ruled)
    dealt = scratch.write(both.repartitionByRange(cells, "key").withColumn("cell", F.spark_partition_id()), "dealt")
    carried, stacks = _stacks(dealt)
    swept = dealt.where("r IS NULL").select("cell", "key", F.lit(1).alias("kind"), F.lit(None).cast(f"array<{OPEN}>").alias("open")).unionByName(stacks.select("cell", "key", F.lit(0).alias("kind"), "open"))
    last = F.last("open", ignorenulls=True).over(Window.partitionBy("cell").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = swept.withColumn("open", last).where("kind = 1").join(carried.withColumnRenamed("open", "held"), "cell", "left")
    fits = F.filter(F.coalesce("open", "held"), lambda o: F.col("key").startswith(o["key"]))
    hit = swept.select("key", F.get(fits, F.size(fits) - 1)["r"].alias("r")).where("r IS NOT NULL")
    found = keys.join(hit, "key").select("url", (-F.length("r.rule")).alias("len"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    best = found.groupBy(F.col("url").alias("u")).agg(F.min(F.struct("len", "rule", "verdict")).alias("best"))
    return urls.join(best, F.col("url").eqNullSafe(F.col("u")), "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])))
    judged = judge(pages, rules).withColumnRenamed("url", "u")
    return pages.join(judged, F.col("url").eqNullSafe(F.col("u")), "left").select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT rid, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT rid, rh || rp AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, rh || rp) AS k FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m ON h.rid = m.rid AND k = 1
"""
