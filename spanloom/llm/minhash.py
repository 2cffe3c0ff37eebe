"""Near-duplicate documents by b-bit MinHash.

A document's set is that of its hashed word shingles; equal sets form a class
that takes part once. 128 minima per class make 32 bands of four, which give
candidates, and a signature of their four lowest bits. For a candidate pair the
share of equal places, corrected for chance (1/16), estimates the similarity;
pairs within MARGIN of the threshold or above it are confirmed on full sets.
A pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8, and
falls below the margin (77 of 128 places are asked for) with probability below 1e-8.

No bucket is joined with itself. First every member of a bucket is compared
with the smallest one; confirmed links are joined into components. Then only
buckets that still hold several components are looked at. Estimates pick the
members with a possible link across components; these alone are sent, with
their full sets, to blocks of at most twice BLOCK members, where possible links
are confirmed, likeliest first, until components stop merging. A pair that meets
in several bands is compared in the first; only links that join components are returned.
So no cap loses a link between different texts; only the chance above does, whatever a bucket's size, and a group of
thousands of near copies yields rows in proportion to its members.

Hot buckets: what a bucket holds is counted map-side and joined back, never sorted
in one window. Mixed buckets of more than TASK classes (texts that share much but
are not linked) lose no pair: two sets of the wanted similarity have a shingle in
common among the first n - ceil(n * percent / 100) + 1 of each, in any one order of
all shingles. With frequent shingles last, these are rare ones, and the classes of such buckets
meet by them instead, if that is less work. What is still larger than TASK is
compared cell by cell, TASK classes each, so no task's memory grows with a bucket.

Components come from min-label propagation with pointer jumping over the
links; every round is written to the shared checkpoint folder.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text of fewer words than a shingle is one shingle;
repeated rows and equal texts link; a null doc_id counts as larger than any
(a component of such rows alone has a null id); an empty table stays empty;
other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, Scratch, broadcast_if_small, let, read

BANDS, ROWS, BITS = 32, 4, 4
PERMS = BANDS * ROWS
#: Standard deviations of the estimate at the threshold that still count as a candidate.
MARGIN = 6
#: Members of a block.
BLOCK = 1000
#: Classes of a bucket or cell that one task compares.
TASK = 10_000
#: Sets of large buckets that have a shingle, from which on it goes last.
OFTEN = 100
_NIBBLES = 0x1111111111111111


def shingles(text: Column, k: int) -> Column:
    """Hashes of all k-word shingles, in order; one of the whole text if it has fewer words."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(k)]))
        return F.when(F.size(w) >= k, many).when(F.size(w) > 0, F.array(F.xxhash64(F.lit(k), w))).otherwise(F.array().cast("array<bigint>"))

    return let(F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACE), ""), of)


def _key_bytes(doc_id: str) -> Column:
    """Size of a row with a doc_id and a hash or two."""
    return F.coalesce(F.octet_length(F.col(doc_id).cast("string")), F.lit(0)) + 64


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, PERMS, dtype=np.uint64)


def minima(values: np.ndarray) -> np.ndarray:
    a, b = _coefficients()
    low = np.full(PERMS, 2**32 - 1, np.uint64)
    for at in range(0, len(values), 1024):
        v = values[at : at + 1024].view(np.uint64)
        v = v ^ (v >> np.uint64(29))
        low = np.minimum(low, ((a[:, None] * v[None, :] + b[:, None]) >> np.uint64(32)).min(1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """Four low bits of each minimum, sixteen to a word."""
    v = (low & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(v, 1).view(np.int64)


def least_equal(percent: int) -> int:
    """Equal places of two signatures from which a pair may have that similarity."""
    s = percent / 100
    e = s + (1 - s) / 2**BITS
    return int(PERMS * (e - MARGIN * (e * (1 - e) / PERMS) ** 0.5))


def _sign(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    for batch in batches:
        column = batch.column(2)
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        n, cls, bands, sig = [], [], [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = np.unique(values[a:b])
            n.append(len(own))
            if len(own):
                low = minima(own)
                cls.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                bands.append(band_keys(low))
                sig.append(packed(low))
            else:
                cls.append(None)
                bands.append([])
                sig.append([])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, longs), pa.array(sig, longs)], ["doc_id", "th", "n", "cls", "bands", "sig"])


def _equal_places(a: Column, b: Column) -> Column:
    total = F.lit(PERMS)
    for i in range(PERMS // 16):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        shift = lambda v, k: F.call_function("shiftrightunsigned", v, F.lit(k))
        y = x.bitwiseOR(shift(x, 1)).bitwiseOR(shift(x, 2)).bitwiseOR(shift(x, 3)).bitwiseAND(F.lit(_NIBBLES))
        total = total - F.bit_count(y)
    return total


def _near(sig: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Equal places of the signatures of rows with those of all."""
    equal = np.full((len(rows), len(sig)), PERMS, np.int16)
    for w in range(sig.shape[1]):
        x = sig[rows, w][:, None] ^ sig[None, :, w]
        x |= (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))
        equal -= np.bitwise_count(x & np.uint64(_NIBBLES)).astype(np.int16)
    return equal


def _possible(at: int, comp: list, sig: np.ndarray, bands: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, equal places) across components that may be links and share no band before the at-th."""
    code = np.unique(np.array(comp, object), return_inverse=True)[1]
    outside = np.flatnonzero(code != np.bincount(code).argmax())  # one end of any pair is here
    inside = np.ones(len(code), bool)
    inside[outside] = False
    for k in range(0, len(outside), 64):
        rows = outside[k : k + 64]
        equal = _near(sig, rows)
        i, j = np.nonzero((equal >= least) & (code[rows][:, None] != code[None, :]) & (inside[None, :] | (rows[:, None] < np.arange(len(code))[None, :])))
        mine = ~(bands[rows[i], :at] == bands[j, :at]).any(1)
        yield rows[i[mine]], j[mine], equal[i[mine], j[mine]]


def _groups(batches: Iterator, columns: int) -> Iterator[list[tuple]]:
    """Rows with equal first fields, one group at a time, from sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _longs(rows: list) -> np.ndarray:
    return np.array(rows, np.int64)


def _needed(least: int):
    """Members of each bucket that have a pair to compare, dealt into pairs of blocks of at most BLOCK members."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in _groups(batches, 6):
            band, at, cls, comp = *rows[0][:2], [r[2] for r in rows], [r[3] for r in rows]
            sig, bands = _longs([r[4] for r in rows]).view(np.uint64), _longs([r[5] for r in rows])
            found: dict[tuple[int, int], set[int]] = {}
            for i, j, _ in _possible(at, comp, sig, bands, least):
                p, q = np.minimum(i, j) // BLOCK, np.maximum(i, j) // BLOCK
                for block in set(zip(p.tolist(), q.tolist(), strict=True)):
                    here = (p == block[0]) & (q == block[1])
                    found.setdefault(block, set()).update(i[here].tolist(), j[here].tolist())
            out = [(f"{band}:{p}:{q}", at, cls[m], comp[m]) for (p, q), members in found.items() for m in sorted(members)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.binary())], ["block", "at", "cls", "comp"])

    return run


def _compared(least: int, percent: int):
    """Links of each block, found on full sets, likeliest pairs first; pairs that links have joined since are passed over."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in _groups(batches, 7):
            at, cls, comp = rows[0][1], [r[2] for r in rows], [r[3] for r in rows]
            sig, bands = _longs([r[4] for r in rows]).view(np.uint64), _longs([r[5] for r in rows])
            sets = [np.array(r[6], np.int64) for r in rows]
            top = {c: c for c in comp}

            def find(c: bytes, top: dict = top) -> bytes:
                while top[c] != c:
                    top[c] = c = top[top[c]]
                return c

            links = []
            parts = list(_possible(at, comp, sig, bands, least))
            i, j, equal = (np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in range(3))
            for k in np.argsort(-equal, kind="stable").tolist():
                a, b = int(i[k]), int(j[k])
                x, y = find(comp[a]), find(comp[b])
                if x == y:
                    continue
                n, m = len(sets[a]), len(sets[b])
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                both = np.sort(np.concatenate([sets[a], sets[b]]))
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (n + m - same):
                    top[x] = y
                    links.append((cls[a], cls[b]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.binary()), pa.array([p[1] for p in links], pa.binary())], ["a", "b"])

    return run


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and comp (the smallest id reachable) of every end of links (a, b)."""
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.least("comp", "c").alias("to"), F.col("comp").alias("was"))
        jump = new.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step = scratch.write(new.join(jump, "to").select("id", F.col("next").alias("comp"), (F.col("next") != F.col("was")).alias("moved")), "labels")
        moved = step.where("moved").limit(1).count()
        scratch.drop(labels)
        labels = step.select("id", "comp")
        if not moved:
            return labels


def _mixed(rows: DataFrame) -> DataFrame:
    """rows (band, comp, ...) of buckets that hold several components, with m, the rows of their bucket."""
    many = rows.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("band", "m")
    return rows.join(many, "band").select("band", "at", "cls", "comp", "m")


def _rare(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """cls and rare: of each set (cls, s) the first shingles, frequent ones last, so many that sets of that similarity have one in common."""
    each = sets.select("cls", F.size("s").alias("n"), F.explode("s").alias("g"))
    often = scratch.write(each.groupBy("g").count().where(F.col("count") >= OFTEN), "often")
    own = each.join(broadcast_if_small(often, 16), "g", "left").groupBy("cls").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "g"))).alias("order"))
    wanted = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    return own.select("cls", F.explode(F.slice("order.g", F.lit(1), wanted.cast("int"))).alias("rare"))


def _compared_once(named: DataFrame, full_sets, percent: int, scratch: Scratch) -> DataFrame:
    """What one task compares: part (of a bucket), at, cls, comp. Of named: band, at, cls, comp; full_sets gives the sets of classes."""
    buckets = scratch.write(_mixed(named), "mixed")
    hot = buckets.where(F.col("m") > TASK)
    if not hot.isEmpty():
        found = hot.select("cls", "comp").distinct()
        sets = full_sets(found.select("cls"))
        # no band goes before the first: pairs meet by shingles, whichever bands they share
        met = found.join(_rare(sets, percent, scratch), "cls").select(F.xxhash64(F.lit("rare"), "rare").alias("band"), F.lit(0).alias("at"), "cls", "comp")
        finer = scratch.write(_mixed(met), "finer")
        scratch.drop(sets)
        pairs = lambda b: b.agg(F.sum("m")).first()[0] or 0
        if pairs(finer) < pairs(hot):
            buckets = scratch.write(buckets.where(F.col("m") <= TASK).unionByName(finer), "mixed")
    cells = F.call_function("div", F.col("m") + TASK - 1, F.lit(TASK))
    dealt = buckets.withColumn("own", F.pmod(F.xxhash64("cls"), cells)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("other"))
    return dealt.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "at", "cls", "comp")


def classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """A row per row of docs (doc_id, th: hash of the text, n: set size, cls: class of equal sets, null if empty) and the components (id: cls, comp)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), shingles(F.col("text"), k).alias("h"))
    signed = scratch.write(own.mapInArrow(_sign, f"doc_id {kind}, th bigint, n bigint, cls binary, bands array<bigint>, sig array<bigint>"), "signed")
    unique = signed.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("one"))
    one = scratch.write(unique.select("cls", "one.doc_id", "one.th"), "classes")
    signatures = scratch.write(signed.where("n > 0").select("cls", "sig", "bands").dropDuplicates(["cls"]), "signatures")
    every = signatures.select("cls", F.posexplode("bands").alias("at", "band"))
    several = every.groupBy("band").agg(F.count("*").alias("m"), F.min("cls").alias("hub")).where("m > 1").select("band", "hub")
    members = scratch.write(every.join(several, "band").select("band", "at", "cls", "hub"), "buckets")
    sigs = signatures.select("cls", "sig")
    least = least_equal(percent)

    def full_sets(ends: DataFrame) -> DataFrame:
        """cls and set of the classes in ends, from the texts."""
        wanted = scratch.write(one.join(ends.distinct(), "cls").select("cls", F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")), "wanted")
        # a repeated row gives its set again, so classes are made unique before texts are split
        text = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text")).join(broadcast_if_small(wanted, _key_bytes("w_id")), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
        return scratch.write(text.groupBy("cls").agg(F.first("text").alias("text")).select("cls", F.array_distinct(shingles(F.col("text"), k)).alias("s")), "sets")

    star = members.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    star = star.join(sigs.select(F.col("cls").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("cls").alias("b"), F.col("sig").alias("y")), "b")
    pairs = scratch.write(star.where(_equal_places(F.col("x"), F.col("y")) >= least).select("a", "b"), "pairs")
    sets = full_sets(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))))
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("y")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("t"))
    links = scratch.write(sized.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b"), "confirmed")
    scratch.drop(sets)
    labels = components(links, scratch).withColumnRenamed("id", "cls")

    named = members.select("band", "at", "cls").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = _compared_once(named, full_sets, percent, scratch).join(signatures, "cls").select("part", "at", "cls", "comp", "sig", "bands").repartition("part").sortWithinPartitions("part", "cls")
    needed = scratch.write(rows.mapInArrow(_needed(least), "block string, at int, cls binary, comp binary"), "needed")
    sets = full_sets(needed.select("cls"))
    rows = needed.join(signatures, "cls").join(sets, "cls").select("block", "at", "cls", "comp", "sig", "bands", "s").repartition("block").sortWithinPartitions("block", "cls")
    more = scratch.write(rows.mapInArrow(_compared(least, percent), "a binary, b binary"), "more")
    scratch.drop(sets)
    return signed.select("doc_id", "th", "n", "cls"), components(links.union(more), scratch)


def linked(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, th, n_shingles, component_id and comp (the component's own key) of every row of docs."""
    rows, labels = classes(docs, k, percent)
    rows = rows.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = rows.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "comp", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "comp")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of its smallest doc_id (then smallest hash of the text; of equal rows any one)."""
    d = Scratch(docs.sparkSession).write(linked(docs, k, percent).where("n_shingles > 0"), "linked")
    texts = d.groupBy("comp", "doc_id", "th").agg(F.count("*").alias("c"), F.first("component_id").alias("least"))
    chosen = texts.where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("comp").agg(F.min(F.struct("th", "c")).alias("one"), F.first("doc_id").alias("doc_id"))
    one = chosen.select("comp", F.col("one.th").alias("th"), F.col("one.c").alias("c"))
    ranked = texts.select("comp", "doc_id", "th", "least").join(one, ["comp", "th"], "left").withColumn("kept", F.col("c").isNotNull() & F.col("doc_id").eqNullSafe(F.col("least")))
    out = ranked.where(~F.col("kept") | (F.col("c") > 1)).select(F.col("doc_id").alias("__m_id"), F.col("th").alias("__m_th"), F.col("kept").alias("__m_kept"))
    out = broadcast_if_small(Scratch(docs.sparkSession).write(out, "out"), _key_bytes("__m_id"))
    own = docs.withColumn("__m_own", F.xxhash64("text"))
    joined = own.join(out, own["doc_id"].eqNullSafe(out["__m_id"]) & (own["__m_own"] == out["__m_th"]), "left")
    single = joined.where(F.col("__m_kept").isNull()).select(*docs.columns)
    repeated = joined.where("__m_kept").dropDuplicates(["__m_id", "__m_th"]).select(*docs.columns)
    return single.union(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linked(read(spark, sf_dir, "documents"), 4, 80)
    return d.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, lo) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d.b, r.lo FROM r JOIN d ON r.id = d.a AND r.lo < d.b),
c AS (SELECT id, min(lo) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN c ON w.doc_id = c.id
"""
