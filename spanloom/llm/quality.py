"""Quality rules: adaptive thresholds from mergeable quantile sketches.

Each document gets integer metrics. For every language and source a
sketch (a histogram whose buckets keep the six leading bits of a value, so
its relative error is at most 1/32 and two sketches merge by adding counts)
yields the quartiles of every metric. A document fails where a metric lies
beyond Tukey's outer fence of its own language and source, FENCE times the
quartiles' distance beyond them. No cutoff is fixed: only so that a uniform, clean source rejects
nothing does that distance count as an eighth of the group's median (mean
word length) or LEAST (symbols, duplicate lines) at least.

Defined results: a null or empty text has no words and fails the base rule;
null languages and sources form groups of their own; repeated rows are judged
row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CHARS, Scratch, let, space_words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
FENCE = 3
#: What the quartiles' distance counts as at least: symbols per 1000 words, duplicate lines per 1000.
LEAST = {"sym": 50, "dup": 100}


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more; windows are compared by 64-bit hash."""

    def of(w: Column) -> Column:
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
        twice = let(keys, lambda s: F.filter(s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        new = let(starts, lambda r: F.transform(r, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(r, k - 1), F.lit(-3)))))
        return F.when(F.size(w) >= 3, F.aggregate(new, F.lit(0), lambda a, x: a + x)).otherwise(0)

    return let(words, of).cast("long")


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row; no shuffle, one scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "lang", "source", *base_counts(text))


def base_counts(text: Column, prefix: str = "") -> list[Column]:
    words = space_words(text)
    lines = let(_lines_with_words(text), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return [
        F.size(words).cast("long").alias(f"{prefix}n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias(f"{prefix}word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias(f"{prefix}n_symbols"),
        lines["n"].cast("long").alias(f"{prefix}n_lines"),
        lines["d"].cast("long").alias(f"{prefix}n_dup_lines"),
        _repeat_words(words).alias(f"{prefix}n_repeat_words"),
    ]


def _metrics(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(f"{prefix}{name}")
    return {
        "len": F.expr(f"(100 * {prefix}word_chars) div greatest({prefix}n_words, 1L)"),
        "sym": F.expr(f"(1000 * {prefix}n_symbols) div greatest({prefix}n_words, 1L)"),
        "dup": F.expr(f"(1000 * {prefix}n_dup_lines) div greatest({prefix}n_lines, 1L)"),
    }


def _bucket(v: Column) -> Column:
    """The value with all but its six leading bits cleared."""
    low = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def thresholds(metrics: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source and the accepted range of each metric, from one small shuffle of bucket counts."""
    rows = metrics.where(F.col("n_words") >= MIN_WORDS).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in _metrics().items()])).alias("m"))
    sketch = rows.groupBy("lang", "source", F.col("m.metric").alias("metric"), _bucket(F.col("m.value")).alias("bucket")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "source", "metric")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    at = lambda quarter: F.min(F.when(F.col("upto") * 4 >= F.col("all") * quarter, F.col("bucket"))).alias(f"q{quarter}")
    q = ranked.groupBy("lang", "source", "metric").agg(at(1), at(2), at(3))
    least = F.coalesce(*[F.when(F.col("metric") == k, v) for k, v in LEAST.items()], F.expr("q2 div 8"))
    spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    fences = q.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "metric", (F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))
    wide = fences.groupBy("t_lang", "t_source").agg(*[F.max(F.when(F.col("metric") == k, F.col(end))).alias(f"{k}_{end}") for end in ("lo", "hi") for k in _metrics()])
    return scratch.write(wide, "thresholds")


def _base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < MIN_WORDS) | (F.col(f"{prefix}n_repeat_words") * 100 > n * 50)


def _within(prefix: str = "") -> Column:
    ok = F.lit(True)
    for k, v in _metrics(prefix).items():
        ok = ok & F.coalesce(v.between(F.col(f"{k}_lo"), F.col(f"{k}_hi")), F.lit(True))
    return ok


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs: the base counts, base_failed and kept.

    The counts are written once (no text), so texts are split once. The thresholds
    table has one row per language and source; it is read back
    from the scratch folder, so Spark broadcasts it only below the session's
    threshold and otherwise splits a hot source's partition.
    """
    scratch = Scratch(docs.sparkSession)
    metrics = scratch.write(measured(docs), "measures")
    limits = thresholds(metrics, scratch)
    joined = metrics.join(limits, metrics["lang"].eqNullSafe(limits["t_lang"]) & metrics["source"].eqNullSafe(limits["t_source"]), "left")
    return joined.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & _within())


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    limits = thresholds(measured(docs), Scratch(docs.sparkSession))
    own = docs.select("*", *base_counts(F.coalesce(F.col("text"), F.lit("")), "__q_"))
    joined = own.join(limits, docs["lang"].eqNullSafe(limits["t_lang"]) & docs["source"].eqNullSafe(limits["t_source"]), "left")
    return joined.where(~_base_failed("__q_") & _within("__q_")).select(*[docs[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
g2 AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + d AS p FROM g2, (VALUES (0), (1), (2)) AS o(d)) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.rid = r.rid),
v AS (SELECT rid, lang, source, n_words, unnest([{'k': 'len', 'v': (100 * word_chars) // greatest(n_words, 1)}, {'k': 'sym', 'v': (1000 * n_symbols) // greatest(n_words, 1)}, {'k': 'dup', 'v': (1000 * n_dup_lines) // greatest(n_lines, 1)}]) AS kv FROM m),
b AS (SELECT lang, source, kv.k AS k, (kv.v >> greatest(length(bin(kv.v)) - 6, 0)::BIGINT) << greatest(length(bin(kv.v)) - 6, 0)::BIGINT AS b, count(*) AS n FROM v WHERE n_words >= 50 GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, k ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, k) AS total FROM b),
q AS (SELECT lang, source, k, min(b) FILTER (upto * 4 >= total) AS q1, min(b) FILTER (upto * 2 >= total) AS q2, min(b) FILTER (upto * 4 >= total * 3) AS q3 FROM c GROUP BY ALL),
f AS (SELECT lang, source, k, q1 - 3 * greatest(q3 - q1, least) AS lo, q3 + 3 * greatest(q3 - q1, least) AS hi FROM (SELECT *, CASE k WHEN 'sym' THEN 50 WHEN 'dup' THEN 100 ELSE q2 // 8 END AS least FROM q)),
bad AS (SELECT DISTINCT v.rid FROM v JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.kv.k = f.k WHERE v.kv.v NOT BETWEEN f.lo AND f.hi)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rid NOT IN (SELECT rid FROM bad) AS kept FROM m
"""
