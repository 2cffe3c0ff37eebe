"""Benchmark decontamination by winnowing.

Fingerprints are the minimum 5-gram hash of every 6 consecutive 5-grams, so any
10 words that a document shares with a benchmark item have, in both, the same
fingerprint. Document fingerprints are joined with the benchmark's; each hit is
then extended to both sides, to the (up to six) 10-word windows that hold its 5-gram. These are
joined with the benchmark's windows on a hash of their words and confirmed on the words
themselves, never on hashes; neighbouring windows make longer spans.
Items of fewer than ten words form one window each, looked up by a hash of
exactly that many words.

Distribution: one scan of the documents makes the fingerprints inside
whole-stage code and probes the benchmark's: a table of numbers, broadcast if it has few bytes, else shuffled
to with each document's different fingerprints. What is left are places, gathered per document (bounded by its words) to meet
its words again once; a text is never copied per hit. Windows that many items
hold are one row; common 5-grams cost nothing, as only equal windows pair. Items are cut into pieces, so a row is bounded for any length.

Defined results: a null or empty text has no words and no hits; items without
words have no window; items with a null id hit words but are not counted;
repeated document rows each get their own full result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, let, letter_words, read, text_bytes

SPAN = 10
GRAM = 5
REACH = SPAN - GRAM
#: Windows of an item that one row holds.
PIECE = 4096


def _packed(w: Column) -> Column:
    """Hash of the 5-gram at each place, from its words' hashes; the three low bits hold the place modulo 8."""

    def of(h: Column) -> Column:
        gram = lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(GRAM)])
        return F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: gram(i).bitwiseAND(F.lit(-8)).bitwiseOR(i.bitwiseAND(F.lit(7)).cast("long")))

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def _minima(words: Column) -> Column:
    """Packed minimum of each 10-word window."""

    def of(w: Column) -> Column:
        rolled = let(_packed(w), lambda v: F.transform(F.sequence(F.lit(0), F.size(w) - SPAN), lambda i: F.least(*[F.get(v, i + d) for d in range(REACH + 1)])))
        return F.when(F.size(w) >= SPAN, rolled).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, win (the words of a window) and wh (their hash), distinct."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), letter_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - SPAN, F.lit(0)), F.lit(PIECE)), lambda at: F.slice("w", at + 1, F.lit(PIECE + SPAN - 1)))
    pieces = rows.select("item_id", F.explode(cut).alias("w"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - SPAN, F.lit(0))), lambda at: F.slice("w", at + 1, F.lit(SPAN)))
    return pieces.select("item_id", F.explode(each).alias("win")).withColumn("wh", F.xxhash64("win")).distinct()


def _places(words: DataFrame, windows: DataFrame, sizes: list[int], scratch: Scratch) -> DataFrame:
    """doc_id, th and the places (at, and n: words from there) where a window of the benchmark may stand."""
    found = []
    if SPAN in sizes:
        prints = windows.where(F.size("win") == SPAN).select(F.explode(_minima(F.col("win"))).alias("m")).select(F.col("m").bitwiseAND(F.lit(-8)).alias("fp")).distinct()
        prints = broadcast_if_small(scratch.write(prints, "prints"), 32)
        probes = words.select("doc_id", "th", F.posexplode_outer(_minima(F.col("w"))).alias("i", "m"))
        place = F.col("i") + F.pmod(F.col("m").bitwiseAND(F.lit(7)).cast("int") - F.col("i"), F.lit(8))
        hit = probes.withColumn("fp", F.col("m").bitwiseAND(F.lit(-8))).join(prints, "fp", "left_semi").select("doc_id", "th", place.alias("at")).distinct()
        around = F.explode(F.sequence(F.greatest(F.col("at") - REACH, F.lit(0)), F.col("at")))
        found.append(hit.select("doc_id", "th", around.alias("at")).distinct().withColumn("n", F.lit(SPAN)))
    short = [n for n in sizes if n < SPAN]
    if short:
        of = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(F.xxhash64(F.slice("w", i + 1, F.lit(n))).alias("wh"), i.alias("at"), F.lit(n).alias("n"))))
        probes = words.select("doc_id", "th", F.explode_outer(F.flatten(F.array_compact(F.array(*map(of, short))))).alias("x")).select("doc_id", "th", "x.*")
        keys = broadcast_if_small(scratch.write(windows.where(F.size("win") < SPAN).select("wh").distinct(), "short"), 32)
        found.append(probes.join(keys, "wh", "left_semi").select("doc_id", "th", "at", "n"))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return every.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "n")).alias("places"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text) with hits: doc_id, th (hash of the text), spans (start, end of word runs), items."""
    scratch = Scratch(docs.sparkSession)
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), letter_words(F.col("text")).alias("w"))  # the hash before any generator, which would copy the words into its rows to have it after
    holders = scratch.write(benchmark_windows(benchmark), "holders")
    sizes = sorted(r[0] for r in holders.select(F.size("win")).distinct().collect())  # ten values at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id", F.lit(0).cast("long").alias("th"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"), F.array().cast("array<string>").alias("items")).schema)
    windows = scratch.write(holders.select("wh", "win").distinct(), "windows")
    places = scratch.write(_places(words, windows, sizes, scratch), "places")
    key_bytes = 64 + F.coalesce(F.octet_length(F.col("doc_id").cast("string")), F.lit(0)) + 16 * F.size("places")
    places = broadcast_if_small(places, key_bytes).withColumnsRenamed({"doc_id": "s_id", "th": "s_th"})
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(places, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")))
    own = own.select("doc_id", "th", letter_words(F.col("text")).alias("w"), "places")  # only texts with places are cut again
    each = F.transform("places", lambda x: F.struct(x["at"].alias("s"), x["n"].alias("n"), F.slice("w", x["at"] + 1, x["n"]).alias("win")))
    spans = own.select("doc_id", "th", F.explode(each).alias("x")).select("doc_id", "th", "x.*").where(F.size("win") == F.col("n")).distinct().withColumn("wh", F.xxhash64("win"))
    found = scratch.write(spans.join(broadcast_if_small(windows, 64 + text_bytes(F.col("win"))), ["wh", "win"]), "found")
    runs = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("spans"))
    named = found.select("doc_id", "th", "wh", "win").distinct().join(holders.where("item_id IS NOT NULL"), ["wh", "win"]).select("doc_id", "th", "item_id").distinct()
    items = named.groupBy(F.col("doc_id").alias("i_id"), F.col("th").alias("i_th")).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    both = runs.join(items, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("th") == F.col("i_th")), "left")
    return both.select("doc_id", "th", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(spans: Column) -> Column:
    """Words in a union of sorted runs."""
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("e"))
    step = lambda a, x: F.struct((a["c"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["e"]))).alias("c"), F.greatest(a["e"], x["e"]).alias("e"))
    return F.aggregate(spans, start, step, lambda a: a["c"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans, items of every row of docs; spans and items are null where nothing hits."""
    found = hits(docs, benchmark)
    own = docs.select("doc_id", F.size(letter_words(F.col("text"))).cast("long").alias("n_words"), F.xxhash64("text").alias("th"))
    return own.join(found, own["doc_id"].eqNullSafe(found["doc_id"]) & (own["th"] == found["th"]), "left").select(own["doc_id"], "n_words", "spans", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs without any hit, with all their columns.

    The keys of hit rows are broadcast only if they are few (Spark's own size check on the written table).
    """
    found = Scratch(docs.sparkSession).write(hits(docs, benchmark).select(F.col("doc_id").alias("__w_id"), F.col("th").alias("__w_hash")), "hit")
    own = docs.withColumn("__w_own", F.xxhash64("text"))
    return own.join(found, docs["doc_id"].eqNullSafe(found["__w_id"]) & (own["__w_own"] == found["__w_hash"]), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN it ON d.rid = it.rid
"""
