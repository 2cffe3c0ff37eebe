"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct segments (a run of word marks with what follows, a newline,
or what follows one) are joined into one text. Its suffix array is built by
prefix doubling up to the longest piece, every piece of the vocabulary is
binary-searched for its range of suffixes (all pieces at once, one character
after another), and the ranges give the edges of the batch: place, length,
piece. Sorted by place they form a table of the best piece per place and
length. Where no edge crosses a place, nothing can be joined across it, so there the text is cut into runs,
over which the edges are relaxed.

The public model is a BPE model: its relaxation joins, in every run at once,
the adjacent pair whose joined piece has the best rank, leftmost first, until
none is left; a unigram model would add costs along edges instead. In a run of more than LONG
characters the pairs wait in a heap, as joining one pair a round would take too many rounds; the edges are the same. Characters
without a piece become the bytes of their UTF-8 form. No piece reaches from one
segment into another, so a segment is encoded once and remembered, up to a bound.

Runs as one Arrow map over the scan: no shuffle; memory bounded by a batch.

Defined results: null encodes like an empty text, to no ids; repeated rows are
encoded row by row; other columns are ignored. Decoding gives the text back
(U+2581, which the format reserves, comes back as a space).
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import read

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
#: Segments a worker remembers; past that it starts anew.
CACHE = 500_000
#: Characters matched at once, and the longest run relaxed together with others.
BLOCK, LONG = 1 << 18, 96
NONE = np.int32(2**31 - 1)


class Pieces:
    """The vocabulary of a model file: id by piece, bytes by id."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes_of, ids = [b""] * n, {}
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece] = (-sp.get_score(i), i)
                self.bytes_of[i] = piece.encode().replace(MARK.encode(), b" ")
        order = sorted(ids, key=ids.__getitem__)
        #: Piece ids by rank: the better score first.
        self.id_at = np.array([ids[p][1] for p in order], np.int32)
        self.rank = {p: k for k, p in enumerate(order)}
        self.lengths = np.array([len(p) for p in order])
        self.longest = int(self.lengths.max())
        self.chars = np.zeros((len(order), self.longest), np.int32)
        for k, p in enumerate(order):
            self.chars[k, : len(p)] = list(map(ord, p))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text sorted by their next depth characters, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    h = 1
    order = np.argsort(rank)
    while h < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = rank[h:]
        key = rank * (n + 2) + after
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]]))
        rank, h = new, 2 * h
        if rank.max() == n:
            break
    return order


def ranges(text: np.ndarray, sa: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern, the suffixes that start with it: binary search, one character a round, all patterns together."""
    lo, hi = np.zeros(len(chars), np.int64), np.full(len(chars), len(sa), np.int64)
    padded = np.concatenate([text, np.full(chars.shape[1] + 1, -1, text.dtype)])
    for d in range(chars.shape[1]):
        live = np.flatnonzero((lengths > d) & (hi > lo))
        if not len(live):
            break
        want = chars[live, d]
        bounds = []
        for right in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                got = padded[sa[np.minimum(mid, len(sa) - 1)] + d]
                less = (got <= want) if right else (got < want)
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            bounds.append(a)
        lo[live], hi[live] = bounds
    return lo, hi


class Encoder:
    _instances: dict[str, Encoder] = {}

    def __init__(self, model: str):
        self.pieces = Pieces(model)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, model: str) -> Encoder:
        """A worker's own encoder, kept from task to task."""
        if model not in cls._instances:
            cls._instances[model] = cls(model)
        return cls._instances[model]

    def _table(self, text: np.ndarray) -> np.ndarray:
        """Rank of the piece at each place, by length less one; NONE where there is none."""
        p = self.pieces
        sa = suffix_array(text, p.longest)
        lo, hi = ranges(text, sa, p.chars, p.lengths)
        n = hi - lo
        which = np.repeat(np.arange(len(n), dtype=np.int32), n)
        place = sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        table = np.full((len(text) + 1, p.longest), NONE, np.int32)
        table[place, p.lengths[which] - 1] = which  # a row per place: the edges in order of place
        return table

    def _relax(self, table: np.ndarray, start: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Joins pairs until none can be joined; start: of each symbol (a character at first), segment: its segment."""
        length, done = np.ones(len(start), np.int64), [(start[:0], start[:0], segment[:0])]
        while len(start):
            joined = length[:-1] + length[1:]
            fits = (segment[:-1] == segment[1:]) & (joined <= self.pieces.longest)
            rank = np.full(len(start), NONE, np.int32)
            at = np.flatnonzero(fits)
            rank[at] = table[start[at], joined[at] - 1]
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(start)))
            live = np.repeat(best != NONE, size)
            done.append((start[~live], length[~live], segment[~live]))
            hits = np.flatnonzero(live & (rank == np.repeat(best, size)))
            if not len(hits):
                break
            left = hits[np.concatenate([[True], segment[hits[1:]] != segment[hits[:-1]]])]
            length[left] += length[left + 1]
            keep = live.copy()
            keep[left + 1] = False
            start, length, segment = start[keep], length[keep], segment[keep]
        s, n, g = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(s)
        return s[order], n[order], g[order]

    def _runs(self, table: np.ndarray) -> np.ndarray:
        """The run that each character of the matched text is in."""
        n = len(table) - 1
        far = np.ones(n, np.int64)
        for length in range(2, table.shape[1] + 1):
            far[table[:n, length - 1] != NONE] = length
        reach = np.maximum.accumulate(np.arange(n) + far)
        return np.cumsum(np.concatenate([[True], reach[:-1] <= np.arange(1, n)])) - 1

    def _queued(self, table: np.ndarray, at: int, n: int) -> tuple[list[int], list[int]]:
        """Starts and lengths of the symbols of one long run."""
        size, prev, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        longest, own = table.shape[1], table[at : at + n].tolist()
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (total := size[i] + size[j]) <= longest and (r := own[i][total - 1]) != NONE:
                heapq.heappush(heap, (r, i, total))

        for i in range(n):
            offer(i)
        while heap:
            _, i, total = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if j >= n or size[i] + size[j] != total:
                continue
            size[i], size[j], after[i] = total, 0, after[j]
            if after[i] < n:
                prev[after[i]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [at + i for i in range(n) if size[i]], [x for x in size if x]

    def _symbols(self, table: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of all symbols, in order."""
        run = self._runs(table)
        sizes = np.bincount(run)
        short = inside & (sizes[run] <= LONG)
        s, n, _ = self._relax(table, np.flatnonzero(short), run[short])
        found = [(s, n)]
        for at in np.flatnonzero(inside & ~short & np.concatenate([[True], run[1:] != run[:-1]])).tolist():
            found.append(tuple(np.array(x, np.int64) for x in self._queued(table, at, int(sizes[run[at]]))))
        if len(found) > 1:
            s, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(s)
            s, n = s[order], n[order]
        return s, n

    def _bytes(self, chars: str) -> list[int]:
        return [self.pieces.byte_ids[b] for b in chars.encode("utf-8", "surrogatepass")]

    def _learn(self, new: list[str]) -> None:
        id_at = self.pieces.id_at
        at = 0
        while at < len(new):
            part, total = [], 0
            while at < len(new) and total < BLOCK:
                part.append(new[at])
                total += len(new[at]) + 1
                at += 1
            joined = "\x00".join(part) + "\x00"
            text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32)
            sizes = np.array([len(s) for s in part])
            segment = np.repeat(np.arange(len(part)), sizes + 1)
            inside = np.ones(len(text), bool)
            inside[np.cumsum(sizes + 1) - 1] = False
            table = self._table(text)
            s, n = self._symbols(table, inside)
            g = segment[s]
            r = table[s, n - 1]
            ids = np.where(r != NONE, id_at[np.where(r != NONE, r, 0)], -1)
            cuts = np.searchsorted(g, np.arange(len(part) + 1))
            unknown = set(g[ids < 0].tolist())
            data = ids.astype("<u2").tobytes()
            for k, seg in enumerate(part):
                a, b = int(cuts[k]), int(cuts[k + 1])
                if k in unknown:
                    out = []
                    for i in range(a, b):
                        out += [int(ids[i])] if ids[i] >= 0 else self._bytes(joined[s[i] : s[i] + n[i]])
                    self.known[seg] = np.array(out, "<u2").tobytes()
                else:
                    self.known[seg] = data[2 * a : 2 * b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, 16 bits each."""
        cut = [_SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list({s for c in cut for s in c}.difference(self.known))
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        if len(self.known) > CACHE:
            self.known = {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _mapper(model: str, keep_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder.of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                blobs = encoder.encode(texts)
                ids = [np.frombuffer(b, "<u2") for b in blobs]
                same = [encoder.decode(i) == (t or "").replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
                n = pa.array([len(i) for i in ids], pa.int64())
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                    values = pa.array(np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), n, pa.ListArray.from_arrays(offsets, values), pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])
                else:
                    crc = pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), n, crc, pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return run


def encoded(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (or their unsigned crc32 as 32-bit integers) and whether decoding gave the text back."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = "ids array<int>" if keep_ids else "ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(_mapper(model, keep_ids), f"doc_id {kind}, n_tokens bigint, {ids}, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), keep_ids=False)
