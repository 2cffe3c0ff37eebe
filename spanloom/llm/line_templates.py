r"""Line dedup with a log-template tree of fixed depth.

A line's fields are its parts between single spaces; a field with a digit is
written `<*>`. The tree's first level is the number of fields, the next ones
the leading DEPTH fields: that path is the line's leaf. A leaf generalises its
other fields by the votes of its distinct lines (a copy has no vote): a position is
constant where more than half of them hold the same field, else variable. A node whose
constant positions are at least SIMILAR of all has a template, to which its lines
that agree with every constant field belong; the other lines vote again among
themselves. A node without a template is split by the position that has the fewest
different fields, so that a leaf keeps several templates. That is done ROUNDS times;
what belongs to none has itself, with digits masked, as its template.

A template that occurs in two documents or more is dropped from all of them but
for its first occurrence (by doc_id, then line). Lines of fewer than MIN_FIELDS
fields coincide by chance: those with a letter are compared as they are, digits
included, and dropped where LONG bytes or more recur in two documents, fewer in
SHORT_DOCS documents and one of SHORT_SHARE at least.

Distribution: one scan makes a table of line hashes (no text); copies of a line
are counted before any shuffle. Fields (64-bit hashes) are looked at only in nodes with
several different lines, once per different line. A third of all rows may share a line or a leaf: counts combine
map-side, and the joins back are equi-joins against unique keys that adaptive execution may split.

Defined results: null texts stay null and have no lines; empty texts stay
empty; repeated rows (same doc_id and text) count as one document and come out
alike; null doc_ids sort first; an empty table stays empty; all other columns are
kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, broadcast_if_small, read

DEPTH = 2
MIN_FIELDS = 5
#: Bytes from which a line of few fields (no spaces, tabs) counts as long.
LONG = 40
#: Documents that hold a shorter line before it is dropped: at least so many, and one of so many.
SHORT_DOCS, SHORT_SHARE = 10, 1000
LETTER = r"[A-Za-z]|[^\x00-\x7F]"
#: Lines from which a node's votes are counted in many tasks.
HOT = 1_000
#: Constant positions of a node's template, of ten, and how often nodes vote.
SIMILAR, ROUNDS = 7, 3
#: A run of characters other than white space that holds a digit, tried at its start only.
MASK = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, MASK, "<*>")).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, rk (hash of doc_id and text), k (line number), raw (the line), n (fields) and leaf; lines of few fields are leaves each, with n = 0 if long, -1 if short and null without a letter."""
    text, raw = F.col("text"), F.col("raw")
    rows = docs.where(text.isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")  # the hash before the generator, which would copy the text into its rows to have it after
    rows = rows.select("doc_id", "rk", F.posexplode_outer(F.split(text, "\n")).alias("k", "raw"))  # outer, and no filter here: an inferred one would do the work twice
    rows = rows.withColumn("spaces", F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit(" "), F.lit(""))))
    few = F.when(raw.rlike(LETTER), F.when(F.octet_length(raw) >= LONG, 0).otherwise(-1))
    rows = rows.withColumn("n", F.when(F.col("spaces") + 1 >= MIN_FIELDS, F.col("spaces") + 1).otherwise(few)).drop("spaces")
    lead = F.when(F.col("n") > 0, _masked(F.substring_index("raw", " ", DEPTH))).otherwise(raw)
    return rows.withColumn("leaf", F.xxhash64("n", lead))


def _hash(n: Column, raw: Column) -> Column:
    return F.xxhash64(F.when(n > 0, _masked(raw)).otherwise(raw))


def _vote(own: DataFrame, again: int, dealt: bool) -> DataFrame:
    """own (leaf, lh, node, f) with the template that a line belongs to or the node that it votes in next (below, of c lines).

    All that is grouped and joined here has the node in its key, so lines that come dealt by node (dealt) are not shuffled again.
    """
    support = own.select("node", F.posexplode("f").alias("at", "f")).groupBy("node", "at", "f").agg(F.count("*").alias("s"))
    # every line has every position, so a position's votes are the node's lines
    most = F.when(F.max("s") * 2 > F.sum("s"), F.max_by("f", "s"))
    places = support.groupBy("node", "at").agg(F.count("*").alias("kinds"), most.alias("f"))
    split = F.min(F.when(F.col("kinds") > 1, F.col("kinds") * F.lit(1 << 31) + F.col("at"))).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    nodes = places.groupBy("node").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("f").isNotNull(), F.struct("at", "f"))).alias("constant"), split.alias("split"))
    nodes = nodes.select("node", F.when(F.size("constant") * 10 >= F.col("n") * SIMILAR, F.col("constant")).alias("constant"), "split")
    fits = F.coalesce(F.forall("constant", lambda x: F.get("f", x["at"]) == x["f"]), F.lit(False))
    below = F.when(F.col("constant").isNotNull(), F.col("node")).otherwise(F.xxhash64("node", "split", F.get("f", F.col("split"))))
    told = own.join(nodes, "node").select("leaf", "lh", "node", "f", F.when(fits, F.xxhash64("node", F.lit(again))).alias("template"), F.when(~fits, below).alias("below"))
    if dealt:
        return told.withColumn("c", F.count("*").over(Window.partitionBy("node", "below")))
    sizes = told.where("below IS NOT NULL").groupBy("node", "below").agg(F.count("*").alias("c"))
    return told.join(sizes, ["node", "below"], "left")


def _members(fields: DataFrame, scratch: Scratch) -> DataFrame:
    """leaf, lh and template of the lines that belong to one, from the distinct lines (leaf, lh, node, c: lines of the node, f: their fields) of nodes with two or more.

    Lines are dealt by node, once a round; those of nodes with more than HOT lines vote by counts that combine before they are shuffled.
    """
    found = []
    for again in range(ROUNDS):
        cold = _vote(fields.where(F.col("c") <= HOT).drop("c").repartition("node"), again, True)
        told = scratch.write(cold.unionByName(_vote(fields.where(F.col("c") > HOT).drop("c"), again, False)).where("template IS NOT NULL OR c > 1"), f"round{again}")
        found.append(told.where("template IS NOT NULL").select("leaf", "lh", "template"))
        fields = told.where("template IS NULL").select("leaf", "lh", F.col("below").alias("node"), "f", "c")
    return reduce(DataFrame.unionByName, found)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, rk and the numbers of the lines to drop, for documents that have any."""
    scratch = Scratch(docs.sparkSession)
    lines = _lines(docs)
    table = scratch.write(lines.select("doc_id", "rk", "k", "leaf", _hash(F.col("n"), F.col("raw")).alias("lh"), "n"), "lines").where("n IS NOT NULL")
    kinds = scratch.write(table.groupBy("leaf", "lh").agg(F.min(F.struct("doc_id", "rk", "k")).alias("first"), F.min("rk").alias("lo"), F.max("rk").alias("hi")), "kinds")
    leaves = scratch.write(kinds.groupBy("leaf").agg(F.count("*").alias("c")).where("c > 1"), "leaves")
    copies = lines.select("leaf", "raw").join(broadcast_if_small(leaves, 32), "leaf").withColumn("line", _masked(F.col("raw")))
    copies = copies.select("leaf", "c", F.xxhash64("line").alias("lh"), F.transform(F.split("line", " "), lambda x: F.xxhash64(x)).alias("f"))
    fields = scratch.write(copies.groupBy("leaf", "lh").agg(F.first("c").alias("c"), F.first("f").alias("f")).withColumn("node", F.col("leaf")), "fields")
    members = _members(fields, scratch)
    keyed = kinds.join(members, ["leaf", "lh"], "left").withColumn("general", F.col("template").isNotNull()).withColumn("key", F.coalesce("template", "lh"))
    keyed = scratch.write(keyed.drop("template"), "keyed")
    recurring = keyed.groupBy("leaf", "general", "key").agg(F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("leaf", "general", "key", "first")
    least = max(SHORT_DOCS, -(-docs.count() // SHORT_SHARE))
    rare = table.where("n = -1").select("leaf", "rk").distinct().groupBy("leaf").count().where(F.col("count") < least).select("leaf")
    recurring = recurring.join(rare, "leaf", "left_anti")
    out = keyed.select("leaf", "lh", "general", "key").join(recurring, ["leaf", "general", "key"]).select("leaf", "lh", "first")
    gone = table.join(out, ["leaf", "lh"]).where(~F.struct("doc_id", "rk", "k").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "rk").agg(F.collect_list("k").alias("gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with text less the dropped lines, and __l_lines and __l_gone (how many lines there were and went)."""
    gone = dropped_lines(docs).select(F.col("doc_id").alias("__l_id"), F.col("rk").alias("__l_rk"), F.col("gone").alias("__l_which"))
    own = docs.withColumn("__l_own", F.xxhash64("doc_id", "text"))
    joined = own.join(gone, docs["doc_id"].eqNullSafe(gone["__l_id"]) & (own["__l_own"] == gone["__l_rk"]), "left")
    parts = F.split(docs["text"], "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__l_parts") - 1), F.col("__l_which")), lambda i: F.get("__l_parts", i)), "\n")
    text = F.when(F.col("__l_which").isNull(), docs["text"]).otherwise(left)
    lines = F.when(docs["text"].isNull(), 0).otherwise(F.size("__l_parts")).cast("long")
    return joined.withColumn("__l_parts", parts).select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], lines.alias("__l_lines"), F.coalesce(F.size("__l_which"), F.lit(0)).cast("long").alias("__l_gone"))


def drop_templates(docs: DataFrame) -> DataFrame:
    """docs without recurring lines; a document that loses all its words goes."""
    d = deduplicated(docs)
    return d.where((F.col("__l_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("__l_lines").alias("n_lines"), F.col("__l_gone").alias("n_dropped"), "text")


def _sql() -> str:
    """The SQL, with its rounds written out."""
    rounds, lines = "", "kind"
    for r in range(ROUNDS):
        rounds += f"""
n{r} AS MATERIALIZED (SELECT n, lead, path, count(*) AS c FROM {lines} GROUP BY ALL HAVING count(*) > 1),
v{r} AS MATERIALIZED (SELECT k.* FROM {lines} k JOIN n{r} USING (n, lead, path)),
s{r} AS (SELECT n, lead, path, c, p, fs[p] AS tok, count(*) AS s FROM (SELECT v.n, v.lead, v.path, c, fs, unnest(range(1, v.n + 1)) AS p FROM v{r} v JOIN n{r} USING (n, lead, path)) GROUP BY ALL),
p{r} AS (SELECT n, lead, path, p, count(*) AS kinds, max(tok) FILTER (s * 2 > c) AS tok FROM s{r} GROUP BY ALL),
t{r} AS MATERIALIZED (SELECT n, lead, path, 10 * count(tok) >= 7 * n AS has, list(p ORDER BY p) FILTER (tok IS NOT NULL) AS ps, list(tok ORDER BY p) FILTER (tok IS NOT NULL) AS toks, min({{'kinds': kinds, 'p': p}}) FILTER (kinds > 1) AS split FROM p{r} GROUP BY n, lead, path),
j{r} AS MATERIALIZED (SELECT v.*, has, split, has AND list_transform(ps, lambda p: fs[p]) = toks AS fits FROM v{r} v JOIN t{r} USING (n, lead, path)),
k{r} AS (SELECT n, lead, CASE WHEN has THEN path ELSE path || ' ' || split.p || ' ' || fs[split.p] END AS path, line, fs FROM j{r} WHERE NOT fits),"""
        lines = f"k{r}"
    members = " UNION ALL ".join(f"SELECT n, lead, line, {r} AS round, path FROM j{r} WHERE fits" for r in range(ROUNDS))
    return SQL_LINES + rounds + f"\ngen AS MATERIALIZED ({members})," + SQL_REST


SQL_LINES = r"""
WITH l AS MATERIALIZED (SELECT doc_id, k - 1 AS k, ls[k] AS raw, regexp_replace(ls[k], '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') AS masked FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
f AS (SELECT *, string_split(masked, ' ') AS fs FROM l),
t AS MATERIALIZED (SELECT doc_id, k, masked AS line, fs, len(fs) AS n, fs[1] || ' ' || fs[2] AS lead FROM f WHERE len(fs) >= 5
      UNION ALL SELECT doc_id, k, raw, NULL, CASE WHEN strlen(raw) >= 40 THEN 0 ELSE -1 END, raw FROM f WHERE len(fs) < 5 AND regexp_matches(raw, '[A-Za-z]|[^\x00-\x7F]')),
kind AS MATERIALIZED (SELECT n, lead, '' AS path, line, any_value(fs) AS fs FROM t WHERE n > 0 GROUP BY n, lead, line),"""
SQL_REST = r"""
keyed AS MATERIALIZED (SELECT t.doc_id, t.k, t.n, t.lead, gen.round, CASE WHEN gen.line IS NULL THEN t.line ELSE gen.path END AS key FROM t LEFT JOIN gen ON t.n = gen.n AND t.lead = gen.lead AND t.line = gen.line),
rec AS (SELECT n, lead, round, key, min({'d': doc_id, 'k': k}) AS first FROM keyed GROUP BY ALL HAVING count(DISTINCT doc_id) >= CASE WHEN n = -1 THEN greatest(10, (SELECT CAST(ceil(count(*) / 1000) AS BIGINT) FROM documents)) ELSE 2 END),
gone AS (SELECT keyed.doc_id, keyed.k FROM keyed JOIN rec ON keyed.n = rec.n AND keyed.lead = rec.lead AND keyed.round IS NOT DISTINCT FROM rec.round AND keyed.key = rec.key WHERE {'d': keyed.doc_id, 'k': keyed.k} <> first),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.k) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY l.k) FILTER (gone.k IS NULL), '') AS text FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.k = gone.k GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, s.text FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
SQL = _sql()
