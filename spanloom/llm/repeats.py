"""Removal of repeated 400-byte strings by a sorted-suffix merge.

Every byte that lies in a SPAN-byte string which also starts somewhere else, in
another document or the same one, is removed.

Which suffixes are sorted: each string start has an anchor, the leftmost place
in the string whose GRAM-byte gram has the least hash, so equal strings have
equal anchors at equal distance. Consecutive starts with one anchor form a
segment (about 185 starts). Only segments whose gram occurs twice go on, and
equal segments are counted, not compared. What follows an anchor is sorted as a
suffix, what precedes it as a suffix of the reversed text; sorting the suffix
of every start instead gives the same repeats from two hundred times the rows.

How they are sorted: each task sorts its segments into runs and front-codes
them (length of the prefix shared with the row before, and the rest). Runs are
exchanged by gram, that is by the suffix's first GRAM bytes, and a loser tree
merges them. It keeps for each head the prefix known to be shared with the last
winner: unequal lengths decide without looking at bytes, equal ones are
compared from there on. The merge thus also yields the common prefix of
neighbours in the order. Two strings at distance d before their anchor are
equal where d bytes before it and SPAN - d after it are, which the neighbours'
prefixes tell for all d at once. Bytes decide, not hashes; only equal segments
are recognised by a 128-bit digest.

Distribution: two scans (grams, then the segments of repeated grams). Copies of
a segment collapse map-side before the shuffle, so a passage in a third of all
documents is one row. The gram table is broadcast below a checked size only.
The different segments of one gram meet in one task, unless the gram occurs more
than HOT times (a short passage that many texts share): then each segment is cut
by distance into parts of STEP, and only parts that agree in the SPAN - STEP + 1
bytes which all their strings hold meet. Equal strings agree in them, so no repeat
is left out. Repeats come back to each occurrence by an equi-join on the segment's digest.

Defined results: a null or empty text has no bytes and nothing is removed;
repeated rows (same doc_id and text) repeat each other; texts shorter than SPAN
keep everything; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, read

SPAN = 400
GRAM = 32
#: Places told apart in one go; longer texts go in overlapping pieces.
PIECE = 1 << 20
#: Bytes of segments sorted into one run.
RUN = 8 << 20
#: Segments whose repeats are worked out at once (whole grams), and entries of a table of segments by distances.
BATCH = 4_000
#: Occurrences from which a gram's segments are dealt out by more of their bytes, and the distances of one part.
HOT = 2_000
STEP = 32
CELLS = 1 << 20

_PLACES = np.uint64(PIECE - 1)


def _grams(b: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each byte."""
    x = b.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    n = len(b) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        g = (g ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return g * np.uint64(0xBF58476D1CE4E5B9)


def segments(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a text's bytes: anchors' gram hashes, places, and the first and last start each anchors."""
    starts, width = len(b) - SPAN + 1, SPAN - GRAM + 1
    step = PIECE - SPAN
    for at in range(0, max(starts, 0), step):
        n = min(step, starts - at)
        g = _grams(b[at : at + n + SPAN - 1])
        low = (g & ~_PLACES) | np.arange(len(g), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        anchor = (low[:n] & _PLACES).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], n) - 1
        yield g[anchor[first]].view(np.int64), anchor[first] + at, first + at, last + at


def sliced(batches: Iterator, rows: int = 500) -> Iterator:
    """The batches in slices of so many rows, so that a worker's objects are bounded by a slice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _gram_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in sliced(batches):
        found = [s[0] for t in batch.column(0).to_pylist() if t and len(t) * 4 >= SPAN for s in segments(np.frombuffer(t.encode(), np.uint8))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["g"])


def _segment_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for part in sliced(batches):
        rows: list[list] = [[], [], [], [], []]  # gram, document, place, anchor within the segment, bytes
        for rk, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if not t or len(t) * 4 < SPAN:
                continue
            data = t.encode()
            for g, anchor, first, last in segments(np.frombuffer(data, np.uint8)):
                for one, mid, a, z in zip(g.tolist(), anchor.tolist(), first.tolist(), last.tolist(), strict=True):
                    rows[0].append(one)
                    rows[1].append(rk)
                    rows[2].append(a)
                    rows[3].append(mid - a)
                    rows[4].append(data[a : z + SPAN])
        digest = [hashlib.blake2b(x, digest_size=16).digest() for x in rows[4]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(digest, pa.binary()), pa.array(rows[4], pa.binary())], ["g", "rk", "at", "mid", "sd", "seg"])


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which known bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def parts(g: int, sd: bytes, copies: int, mid: int, seg: bytes) -> Iterator[tuple]:
    """A segment of a hot gram in parts by distance to the anchor, each with a key of the bytes that its strings hold.

    A part's digest is the segment's with the part's place in the segment after it.
    """
    low = SPAN - (len(seg) - mid)
    for near in range(low - low % STEP, mid + 1, STEP):
        far = near + STEP - 1
        key = hashlib.blake2b(near.to_bytes(4, "little") + seg[mid - near : mid + SPAN - far], digest_size=8).digest()
        least, most = max(near, low), min(far, mid)
        yield int.from_bytes(key, "little", signed=True), sd + (mid - most).to_bytes(4, "little"), copies, most, seg[mid - most : mid + SPAN - least]


def _runs(batches: Iterator) -> Iterator:
    """Front-coded sorted runs: what follows the anchors (side 0), and what precedes them, reversed (side 1)."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["g", "side", "run", "pos", "lcp", "tail", "sd", "copies"]
    run = TaskContext.get().partitionId() << 20

    def coded(rows: list, side: int) -> pa.RecordBatch:
        keys = sorted((r[0], r[4][: r[3]][::-1] if side else r[4][r[3] :], i) for i, r in enumerate(rows))
        lcps, tails, before, gram = [], [], b"", None
        for g, own, _ in keys:
            lcp = shared(before, own) if g == gram else 0
            lcps.append(lcp)
            tails.append(own[lcp:])
            before, gram = own, g
        n = len(keys)
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([side] * n, pa.int32()), pa.array([run] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(lcps, pa.int32()), pa.array(tails, pa.binary()), pa.array([rows[k[2]][1] for k in keys], pa.binary()), pa.array([rows[k[2]][2] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    rows, total = [], 0
    for batch in batches:
        for g, sd, copies, mid, seg, hot in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            own = list(parts(g, sd, copies, mid, seg)) if hot else [(g, sd + bytes(4), copies, mid, seg)]
            rows += own
            total += sum(len(r[4]) for r in own)
            if total > RUN:
                yield from (coded(rows, 0), coded(rows, 1))
                rows, total, run = [], 0, run + 1
    if rows:
        yield from (coded(rows, 0), coded(rows, 1))


def merged(runs: list[list[tuple]]) -> list[tuple]:
    """One sorted run of sorted runs of (common prefix with the one before, string, ...), by a loser tree."""
    if len(runs) == 1:
        return runs[0]
    lanes = 1 << (len(runs) - 1).bit_length()
    at = [0] * lanes
    head = [r[0] if r else None for r in runs] + [None] * (lanes - len(runs))
    known = [0] * lanes

    def loses(a: int, b: int) -> bool:
        """Whether b goes before a; the loser's known prefix becomes the one shared with the winner."""
        if head[b] is None:
            return False
        if head[a] is None:
            return True
        if known[a] != known[b]:
            return known[a] < known[b]
        x, y = head[a][1], head[b][1]
        n = shared(x, y, known[a])
        after = x[n : n + 1] > y[n : n + 1]
        known[a if after else b] = n
        return after

    losers, best = [0] * lanes, [0] * lanes + list(range(lanes))
    for node in range(lanes - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        best[node], losers[node] = (b, a) if loses(a, b) else (a, b)
    lane, out = best[1], []
    while head[lane] is not None:
        out.append((known[lane], *head[lane][1:]))
        at[lane] += 1
        own = runs[lane]
        if at[lane] < len(own):
            head[lane] = own[at[lane]]
            known[lane] = head[lane][0]
        else:
            head[lane] = None
        node = (lane + lanes) >> 1
        while node:
            if loses(lane, losers[node]):
                lane, losers[node] = losers[node], lane
            node >>= 1
    return out


def repeated_starts(after: np.ndarray, rank: np.ndarray, before: np.ndarray, rank_before: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segment, least and greatest distance to the anchor of runs of strings that another segment has, too.

    after and before hold the common prefix of each suffix (reversed prefix) with the one before it in its order,
    rank and rank_before each segment's place there, low and high the distances of each segment's strings.
    """
    n = len(rank)
    place = np.arange(n)[:, None]
    step = max(CELLS // n, 1)
    for d in range(int(low.min()), int(high.max()) + 1, step):
        ds = np.arange(d, min(d + step, int(high.max()) + 1))
        right = np.maximum.accumulate(np.where(after[:, None] < SPAN - ds, place, 0), axis=0)[rank]
        left = np.maximum.accumulate(np.where(before[:, None] < ds, place, 0), axis=0)[rank_before]
        row, col = np.nonzero((ds >= low[:, None]) & (ds <= high[:, None]))
        key = (left[row, col] * n + right[row, col]) * len(ds) + col
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice)
        if len(hit):
            cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(row[hit]) > 0))
            a, z = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)]
            yield row[a], ds[col[a]], ds[col[z]]


def _decoded(rows: Iterator) -> list[tuple]:
    """A front-coded run of one gram as (common prefix, string, digest, copies)."""
    out, own = [], b""
    for r in rows:
        own = own[: r[3]] + r[4]
        out.append((r[3], own, r[5], r[6]))
    return out


def _compare(batches: Iterator) -> Iterator:
    """Merges the runs of each gram and gives the ranges of repeated bytes of each segment."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True))

    def done(grams: list[tuple]) -> pa.RecordBatch:
        after = np.array([x[0] for _, sides in grams for x in sides[0]], np.int64)
        before = np.array([x[0] for _, sides in grams for x in sides[1]], np.int64)
        items = [(g, x[2], x[3]) for g, sides in grams for x in sides[0]]
        low = SPAN - np.array([len(x[1]) for _, sides in grams for x in sides[0]], np.int64)
        where = {(g, sd): i for i, (g, sd, _) in enumerate(items)}
        item = np.array([where[g, x[2]] for g, sides in grams for x in sides[1]], np.int64)
        high, rank_before = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
        high[item] = [len(x[1]) for _, sides in grams for x in sides[1]]
        rank_before[item] = np.arange(len(items))
        ranges: list[list[dict]] = [[{"a": 0, "z": int(h - w) + SPAN}] if x[2] > 1 else [] for x, w, h in zip(items, low, high, strict=True)]
        if any(len(sides[0]) > 1 for _, sides in grams):
            for which, a, z in repeated_starts(after, np.arange(len(items)), before, rank_before, low, high):
                for i, x, y in zip(which.tolist(), a.tolist(), z.tolist(), strict=True):
                    if items[i][2] == 1:
                        ranges[i].append({"a": int(high[i]) - y, "z": int(high[i]) - x + SPAN})
        kept = [i for i, r in enumerate(ranges) if r]
        place = {i: int.from_bytes(items[i][1][16:], "little") for i in kept}
        moved = [[{"a": x["a"] + place[i], "z": x["z"] + place[i]} for x in ranges[i]] for i in kept]
        return pa.RecordBatch.from_arrays([pa.array([items[i][1][:16] for i in kept], pa.binary()), pa.array(moved, kind)], ["sd", "ranges"])

    grams, total = [], 0
    for g, own in groupby(rows, itemgetter(0)):
        sides = [merged([_decoded(run) for _, run in groupby(side, itemgetter(2))]) for _, side in groupby(own, itemgetter(1))]
        grams.append((g, sides))
        total += len(sides[0])
        if total > BATCH:
            yield done(grams)
            grams, total = [], 0
    if grams:
        yield done(grams)


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    spans_type = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
    for batch in sliced(batches):
        names = ["doc_id", "n_bytes", "n_removed", "kept", "spans"]
        size, gone, kept, spans = [], [], [], []
        for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (t or "").encode()
            merged: list[list[int]] = []
            for a, z in sorted((x["a"], x["z"]) for x in found or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(z, merged[-1][1])
                else:
                    merged.append([a, z])
            left, at = [], 0
            for a, z in merged:
                left.append(data[at:a])
                at = z
            size.append(len(data))
            gone.append(sum(z - a for a, z in merged))
            kept.append(b"".join([*left, data[at:]]))
            spans.append([{"a": a, "z": z} for a, z in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, spans_type)], names)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (the remaining bytes) and spans (removed runs, bytes) of every row of docs."""
    scratch = Scratch(docs.sparkSession)
    grams = docs.select("text").mapInArrow(_gram_rows, "g bigint").groupBy("g").count().where("count > 1").select("g", (F.col("count") > HOT).alias("hot"))
    grams = scratch.write(grams, "grams")
    own = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "text")
    found = own.mapInArrow(_segment_rows, "g bigint, rk bigint, at bigint, mid int, sd binary, seg binary").join(broadcast_if_small(grams, 32), "g")
    found = scratch.write(found, "segments")
    kinds = found.groupBy("g", "sd").agg(F.count("*").alias("copies"), F.first("mid").alias("mid"), F.first("seg").alias("seg"), F.first("hot").alias("hot"))
    runs = kinds.select("g", "sd", "copies", "mid", "seg", "hot").mapInArrow(_runs, "g bigint, side int, run bigint, pos int, lcp int, tail binary, sd binary, copies bigint")
    ranges = runs.repartition("g").sortWithinPartitions("g", "side", "run", "pos").select("g", "side", "run", "lcp", "tail", "sd", "copies").mapInArrow(_compare, "sd binary, ranges array<struct<a:bigint,z:bigint>>")
    ranges = scratch.write(ranges, "ranges")
    spans = found.select("sd", "rk", "at").join(ranges, "sd").select("rk", F.explode(F.transform("ranges", lambda x: F.struct((x["a"] + F.col("at")).alias("a"), (x["z"] + F.col("at")).alias("z")))).alias("s"))
    per_doc = spans.groupBy("rk").agg(F.collect_set("s").alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk")).join(per_doc, "rk", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, kept binary, spans array<struct<a:bigint,z:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = without_repeats(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
