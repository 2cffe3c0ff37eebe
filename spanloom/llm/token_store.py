"""Token-ID output: Elias-Fano document boundaries over a concatenated id array.

A shard file holds consecutive documents in ascending id order:

    magic "SLTS1", one byte id width, then little-endian
    u32 partition, u32 sequence, u64 documents, u64 ids, u64 null doc ids, i64 first doc id,
    u64 lengths of the two sequences, the boundaries (documents + 1 values) and
    the doc ids (less the first), each as an Elias-Fano sequence, and the ids.

An Elias-Fano sequence keeps the low bits of each value in a packed array and
the high bits in unary; the place of every 256th set bit is sampled (u32), so
select finds a value by reading at most a few bytes. That is about
2 + log2(mean length) bits a document, where a table of offsets takes 64.

Writing: documents are dealt by ranges of doc_id (and, so that a repeated or null id is split, a hash of the text), sorted inside each, encoded by
an Arrow map and cut into shards of at most SHARD_IDS ids; Spark's own committer
writes each shard as a file, so lost executors and speculative tasks leave nothing
half written. (The text writer adds one newline, which readers ignore.) The
boundaries are relative to the shard; the shard table (one row a file) gives what precedes.

Defined results: a null text is empty and has only the end id; null doc ids come
first; repeated ids are kept, in any order among themselves; an empty table has
no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read

MODEL = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"SLTS1"
HEAD = struct.Struct("<BIIQQQqQQ")
SHARD_IDS = 16_000_000
SAMPLE = 256
#: Documents whose bounds are looked up at once.
BLOCK = 4096
#: Chunks whose ids a worker remembers; past that it starts anew.
CACHE = 500_000
#: Closing punctuation that the tokenizer splits off letters.
TAILS = ".,;:!?*#$%&|"


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    HEAD = struct.Struct("<QQBQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        low = np.zeros(0, np.uint8)
        if bits:
            low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, len(self.low), self.low_bits, len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, n_low, bits, n_high, n_samples = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        low, high = np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", n_samples, at + n_low + n_high))

    def _low(self, i: int) -> int:
        bit = i * self.low_bits
        word = int.from_bytes(self.low[bit >> 3 : (bit + self.low_bits + 7) >> 3].tobytes(), "little")
        return (word >> (bit & 7)) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: int) -> int:
        """The i-th value, by select from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place >> 3
        byte = int(self.high[at]) >> (place & 7) << (place & 7)
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        return (((at << 3) + (byte & -byte).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def select(self, first: int, last: int) -> np.ndarray:
        """The values first to last (not included), from the sample before the first one to the one after the last."""
        first, last = max(first, 0), min(last, self.n)
        if first >= last:
            return np.zeros(0, np.int64)
        place, after = int(self.samples[first // SAMPLE]), (last - 1) // SAMPLE + 1
        at, end = place >> 3, (int(self.samples[after]) >> 3) + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at:end], bitorder="little")) + 8 * at
        ones = ones[ones >= place][first % SAMPLE : first % SAMPLE + last - first]
        value = (ones - np.arange(first, last)).astype(np.int64) << self.low_bits
        if self.low_bits:
            start, stop = first * self.low_bits, last * self.low_bits
            bits = np.unpackbits(self.low[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].reshape(last - first, self.low_bits)
            for b in range(self.low_bits):
                value |= bits[:, b].astype(np.int64) << b
        return value


def pack(part: int, seq: int, doc_ids: list, counts: np.ndarray, ids: bytes, width: int) -> bytes:
    """A shard file's bytes; ids are little-endian, width bytes each; null doc ids come first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    first = int(known[0]) if len(known) else 0
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(counts)])).to_bytes()
    names = EliasFano.of(known - first).to_bytes()
    return MAGIC + HEAD.pack(width, part, seq, len(doc_ids), len(ids) // width, nulls, first, len(bounds), len(names)) + bounds + names + ids


class Shard:
    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token shard")
        width, self.part, self.seq, self.n_docs, self.n_ids, self.nulls, self.first, n_bounds, n_names = HEAD.unpack_from(view, len(MAGIC))
        at = len(MAGIC) + HEAD.size
        self.bounds = EliasFano.from_bytes(view[at : at + n_bounds])
        self._names = EliasFano.from_bytes(view[at + n_bounds : at + n_bounds + n_names])
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at + n_bounds + n_names)

    def doc_ids(self, first: int, last: int) -> list:
        """The ids of documents first to last (not included)."""
        known = self._names.select(first - self.nulls, last - self.nulls) + self.first
        return [None] * (min(last, self.n_docs) - first - len(known)) + known.tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


class Encoder:
    """Ids of whole texts as bytes, 16 bits each.

    The tokenizer drops white space and no token or normal form reaches across a
    space or newline, so a text's ids are those of its chunks; a chunk is encoded
    once. Chunks of letters, less closing punctuation, are encoded many at a time,
    and cut where a token ends a word; all others one by one.
    """

    _instances: dict[str, Encoder] = {}

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids take more than 16 bits")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, model: str) -> Encoder:
        """A worker's own encoder, kept from task to task."""
        if model not in cls._instances:
            cls._instances[model] = cls(model)
        return cls._instances[model]

    def _words(self, words: list[str]) -> None:
        """Learns words of lower-case letters below U+0250: one token run each."""
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u2")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                self._chunks(part)
                continue
            data, left = ids.tobytes(), 0
            for word, right in zip(part, (2 * cuts).tolist(), strict=True):
                self.known[word] = data[left:right]
                left = right

    def _chunks(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            for chunk, enc in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[chunk] = np.array(enc.ids, "<u2").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Learns chunks of lower-cased Latin-1 text."""
        other, split, words, known = [], [], [], self.known
        for chunk in new:
            base = chunk.rstrip(TAILS)
            if not base.isalpha():
                other.append(chunk)
            elif len(base) == len(chunk):
                words.append(chunk)
            else:
                split.append((chunk, base))
        words = set(words)
        words.update({base for _, base in split}.difference(known))
        self._words(list(words))
        tails = {chunk[len(base) :] for chunk, base in split}
        self._chunks([*other, *tails.difference(known)])
        for chunk, base in split:
            known[chunk] = known[base] + known[chunk[len(base) :]]

    @staticmethod
    def _folded(text: str) -> str | None:
        """The text in lower case if that changes no id: Latin-1 without a special token's opening; else null."""
        if "<|" in text:
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return text.lower()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, end = [], struct.pack("<H", END_ID)
        for at in range(0, len(texts), 1000):
            part = [t or "" for t in texts[at : at + 1000]]
            folded = list(map(self._folded, part))
            cut = [(t if f is None else f).replace("\n", " ").split(" ") for t, f in zip(part, folded, strict=True)]
            self._learn(set().union(*[c for c, f in zip(cut, folded, strict=True) if f is not None]).difference(self.known))
            self._chunks(list(set().union(*[c for c, f in zip(cut, folded, strict=True) if f is None]).difference(self.known)))
            out += [b"".join([*map(self.known.__getitem__, chunks), end]) for chunks in cut]
            if len(self.known) > CACHE:
                self.known = {"": b""}
        return out


def _writer(model: str):
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, Encoder.of(model)
        ids, blobs, total = [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(part, seq, ids, np.array([len(b) // 2 for b in blobs], np.int64), b"".join(blobs), 2)], pa.binary())], ["value"])

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                if blobs and total + len(blob) > 2 * SHARD_IDS:
                    yield shard()
                    seq, ids, blobs, total = seq + 1, [], [], 0
                ids.append(doc_id)
                blobs.append(blob)
                total += len(blob)
        if blobs:
            yield shard()

    return write


def write(docs: DataFrame, path: str, model: str) -> None:
    """Writes the token files of docs (doc_id, text) below path."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("salt"), F.spark_partition_id().alias("place"))
    ranged = own.repartitionByRange(n, "doc_id", "salt", "place").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")
    shards = ranged.mapInArrow(_writer(model), "value binary")
    shards.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _documents(batches: Iterator) -> Iterator:
    """Documents of each shard, BLOCK at a time: their bounds are selected, never all unpacked."""
    import pyarrow as pa

    for batch in batches:
        for data in batch.column(0):
            s = Shard(data.as_buffer().to_pybytes())
            for at in range(0, s.n_docs, BLOCK):
                bounds = s.bounds.select(at, at + BLOCK + 1)
                n = len(bounds) - 1
                crc = [zlib.crc32(s.ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s.part, np.int32)), pa.array(np.full(n, s.seq, np.int32)), pa.array(s.doc_ids(at, at + n), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below path; each file is read once."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    own = files.select("content").mapInArrow(_documents, "part int, seq int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    own = Scratch(spark).write(own, "documents")
    table = own.groupBy("part", "seq").agg(F.max(F.col("local") + F.col("n_tokens")).alias("n_ids"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))  # one row a shard file
    return own.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark).path("tokens")
    write(read(spark, sf_dir, "documents"), path, public_tokenizers.path(MODEL))
    return documents(spark, path)
