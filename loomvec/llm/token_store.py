"""Operator 7: a token-id store with Elias-Fano document boundaries.

A store is a table of binary blocks, written by Spark's own file commit (a task that is
run again, or an executor that is lost, leaves no half block). A block holds the ids of
consecutive documents, concatenated, in ascending document order:

    magic "LVT1", then little-endian uint64: documents, null ids, ids, bytes per id,
    low bits of boundaries, bytes of their low and high parts, first document id, low bits
    of document ids, bytes of their low and high parts; then the four parts, then the ids.

Boundaries (documents + 1 values) and document ids are Elias-Fano sequences: each value's
low bits are packed, its high part is a one-bit in a unary-coded bit vector. ``select``
finds the i-th one-bits through a small directory of bit counts. Readers ask it for the
boundaries and ids of ``READ`` documents at a time, so no 64-bit offset table exists. Ids
take two bytes if they fit, else four.

Encoding: texts are cut before single spaces between other characters, where the
tokenizer's own pre-tokenizer always cuts; each distinct chunk of a batch is encoded once
by the tokenizers library. Chunks of one space and then surely none (``plain``) go to it
joined, many in one string, as each call costs as much as a chunk: a token that begins with
the space begins the next chunk. If the counts don't agree, they go one by one.

Defined results: null and empty text hold only the end id; null document ids come first;
rows that repeat an id follow each other in the order of their text; an empty table gives
an empty store; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomvec.llm import textscan as ts
from loomvec.llm.common import partitions, write

BLOCK_IDS = 1 << 20
_HEAD = struct.Struct("<4s11Q")
_DIRECTORY = 512
_ODD = np.array([0x3C, 0x7F, 0xC2, 0xE1, 0xE2, 0xE3], np.uint8)  # of special tokens, control and lead bytes of other spaces
READ = 4096


class EliasFano:
    """A non-decreasing sequence of unsigned values in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        counts = np.bitwise_count(self.high).astype(np.int64)
        whole = np.add.reduceat(counts, np.arange(0, len(counts), _DIRECTORY // 8)) if len(counts) else counts
        self.before = np.concatenate([[0], np.cumsum(whole)]).astype(np.uint32)  # ones before each 512 bits

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits and n:
            as_bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
            low = np.packbits(as_bits[:, 64 - bits :].ravel())
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low.tobytes(), np.packbits(high).tobytes())

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values of numbers ``i``, read from the 512 bits that hold each one's one-bit."""
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(i)
        part = np.searchsorted(self.before, i, "right") - 1
        parts, which = np.unique(part, return_inverse=True)
        size = _DIRECTORY // 8
        bytes_ = parts[:, None] * size + np.arange(size)
        high = np.where(bytes_ < len(self.high), self.high[np.minimum(bytes_, max(len(self.high) - 1, 0))] if len(self.high) else 0, 0).astype(np.uint8)
        ones = np.flatnonzero(np.unpackbits(high.ravel()))
        before = self.before[parts].astype(np.int64)
        count = self.before[parts + 1].astype(np.int64) - before
        at = ones[(np.cumsum(count) - count - before)[which] + i] + (part - which) * _DIRECTORY
        out = (at - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:  # up to 64 bits that begin inside a byte: from 16 bytes
            bit = i * self.low_bits
            padded = np.append(self.low, np.zeros(16, np.uint8))
            eight = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
            first, shift = eight[bit // 8].astype(np.uint64), (bit % 8).astype(np.uint64)
            rest = padded[bit // 8 + 8].astype(np.uint64)
            out |= (first << shift | rest >> (np.uint64(8) - shift)) >> np.uint64(64 - self.low_bits)
        return out


def pack_block(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a block of documents."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    names = EliasFano.of(known.astype(np.uint64) - np.uint64(first % (1 << 64)))
    ends = EliasFano.of(np.concatenate([[0], np.cumsum(lens)]))
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    parts = [ends.low.tobytes(), ends.high.tobytes(), names.low.tobytes(), names.high.tobytes()]
    head = _HEAD.pack(b"LVT1", len(doc_ids), len(doc_ids) - len(known), len(ids), width, ends.low_bits, len(parts[0]), len(parts[1]), first % (1 << 64), names.low_bits, len(parts[2]), len(parts[3]))
    return b"".join([head, *parts, ids.astype(f"<u{width}").tobytes()])


class Block:
    """A block's documents: ``doc_ids``, ``ids`` and Elias-Fano ``ends``."""

    def __init__(self, data: bytes) -> None:
        magic, n, nulls, n_ids, width, e_bits, e_low, e_high, first, d_bits, d_low, d_high = _HEAD.unpack_from(data)
        if magic != b"LVT1":
            raise ValueError("not a token block")
        at, cuts = _HEAD.size, []
        for size in (e_low, e_high, d_low, d_high):
            cuts.append(data[at : at + size])
            at += size
        self.n, self.ends = n, EliasFano(n + 1, e_bits, cuts[0], cuts[1])
        self.nulls, self.first, self.names = nulls, first, EliasFano(n - nulls, d_bits, cuts[2], cuts[3])
        self.ids = np.frombuffer(data, f"<u{width}", n_ids, at)

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """(document ids, boundaries) of ``READ`` documents at a time."""
        for a in range(0, self.n, READ):
            z = min(self.n, a + READ)
            known = self.names.select(np.arange(max(a, self.nulls), max(z, self.nulls)) - self.nulls) + np.uint64(self.first)
            yield [None] * (min(z, self.nulls) - min(a, self.nulls)) + known.view(np.int64).tolist(), self.ends.select(np.arange(a, z + 1)).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        a, z = self.ends.select(np.array([i, i + 1])).tolist()
        return self.ids[a:z]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Chunks:
    """Ids of chunks of text, as bytes, remembered from batch to batch of a worker.

    Beyond ``MOST`` chunks or ``MOST_IDS`` ids only those of the batch at hand stay, which
    bounds the memory and keeps the frequent ones.
    """

    MOST, MOST_IDS, LONGEST, AT_ONCE, JOINED = 400_000, 4_000_000, 64, 4096, 64

    def __init__(self, path: str) -> None:
        self.tokenizer, self.known = tokenizer(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # the byte-level sign of a space
        self.flat, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids in each)."""
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), "<u4", int(size.sum())), size

    def _joined(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain chunks."""
        n = self.JOINED
        flat, _ = self._encoded([b"".join(chunks[a : a + n]).decode() for a in range(0, len(chunks), n)])
        first = np.flatnonzero(self.begins[flat])
        if len(first) == len(chunks) and (not len(first) or first[0] == 0):
            return flat, np.diff(np.append(first, len(flat)))
        return self._encoded([c.decode() for c in chunks])

    def ids(self, chunks: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first and number of each chunk's); ``plain`` tells the chunks that may be joined."""
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            new = new[np.argsort(~plain[new], kind="stable")]
            fresh, n_plain = [chunks[k] for k in new.tolist()], int(plain[new].sum())
            parts = [(self.flat, self.size)]
            parts += [self._joined(fresh[a : min(a + self.AT_ONCE, n_plain)]) for a in range(0, n_plain, self.AT_ONCE)]
            parts += [self._encoded([c.decode() for c in fresh[a : a + self.AT_ONCE]]) for a in range(n_plain, len(fresh), self.AT_ONCE)]
            flat, sizes = zip(*parts, strict=True)
            at[new] = len(self.size) + np.arange(len(new))
            self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
            self.known.update((c, k) for c, k in zip(fresh, at[new].tolist(), strict=True) if len(c) <= self.LONGEST)
        first = (np.cumsum(self.size) - self.size)[at]
        found = self.flat, first, self.size[at]
        if len(self.known) > self.MOST or len(self.flat) > self.MOST_IDS:
            self.flat, self.size = self.flat[_ranges(first, found[2])], found[2]
            self.known = {c: k for k, c in enumerate(chunks) if len(c) <= self.LONGEST} if len(chunks) <= self.MOST else {}
            if not self.known or len(self.flat) > self.MOST_IDS:
                self.known, self.flat, self.size = {}, self.flat[:0], self.size[:0]
        return found


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one range after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first, size)


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> Chunks:
    return Chunks(path)


def cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of chunks: each text's, and each single space between characters that are surely no space.

    Bytes that may belong to a non-ASCII space (lead bytes C2, E1, E2, E3) do not cut.
    """
    n = len(raw)
    start = np.zeros(n, bool)
    if n > 4:
        spaceless = (raw > 32) & (raw != 0x7F)
        lead3 = (raw >= 0xE1) & (raw <= 0xE3)
        odd = (raw == 0xC2) | lead3
        safe_next = spaceless & ~odd
        safe_before = spaceless & ~odd
        safe_before[1:] &= ~((raw[1:] >= 0x80) & odd[:-1])
        safe_before[2:] &= ~((raw[2:] >= 0x80) & lead3[:-2])
        start[1:-1] = (raw[1:-1] == 32) & safe_before[:-2] & safe_next[2:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        start[edge[edge > 0] - 1] = False  # a text's last space has no character after it
    start[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(start)


def encode_texts(path: str, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids in each text)."""
    starts = cuts(raw, off)
    ends = np.append(starts[1:], len(raw))
    rep, which = ts.distinct_spans(raw, starts, ends) if len(starts) else (starts, starts)
    chunk, chunk_off = ts.joined(raw, starts[rep], ends[rep])
    data = chunk.tobytes()
    odd = np.concatenate([[0], np.cumsum((chunk <= 32) | np.isin(chunk, _ODD))])
    first = chunk[np.minimum(chunk_off[:-1], max(len(chunk) - 1, 0))] if len(chunk) else chunk
    plain = (first == 32) & (odd[chunk_off[1:]] - odd[chunk_off[:-1]] == 1) & (np.diff(chunk_off) > 1)
    flat, begin, size = chunk_ids(path).ids([data[a:b] for a, b in zip(chunk_off[:-1].tolist(), chunk_off[1:].tolist(), strict=True)], plain)
    lens = size[which]
    total = np.concatenate([[0], np.cumsum(lens)])
    return flat[_ranges(begin[which], lens)], np.diff(total[np.searchsorted(starts, off)])


def _blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, names, sizes, held, count
            data = pack_block(names, np.concatenate(sizes), np.concatenate(held))
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([count]), pa.array([data], pa.binary())]
            seq, before, names, sizes, held, count = seq + 1, before + count, [], [], [], 0
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "before", "n_ids", "block"])

        for batch in ts.gathered(batches, "t", 8_000_000):
            ids, n = encode_texts(path, *ts.text_bytes(batch.column("t")))
            ends = np.cumsum(n)
            ids, n = np.insert(ids, ends, end_id).astype(np.uint32), n + 1
            doc_ids = batch.column("d").to_pylist()
            ends = np.cumsum(n)
            a = 0
            while a < len(n):  # whole documents only, about block_ids ids a block
                room = block_ids - count
                done = int(ends[a - 1]) if a else 0
                z = max(a + 1, int(np.searchsorted(ends, done + max(room, 0), "right")))
                names += doc_ids[a:z]
                sizes.append(n[a:z])
                held.append(ids[done : ends[z - 1]])
                count += int(ends[z - 1]) - done
                a = z
                if count >= block_ids or a < len(n):
                    yield flush()
        if names:
            yield flush()

    return run


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the store to ``path`` in ascending id order."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    dealt = rows.repartitionByRange(4 * partitions(docs.sparkSession), F.col("d").asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first(), "t")
    write(dealt.mapInArrow(_blocks(tokenizer_path, end_id, block_ids), "part int, seq int, before long, n_ids long, block binary"), path, compression="none")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("block").to_pylist(), strict=True):
            block = Block(data)
            for doc_ids, ends in block.documents():
                wide, low = block.ids[ends[0] : ends[-1]].astype("<u4").tobytes(), 4 * int(ends[0])
                crc = [zlib.crc32(wide[a - low : b - low]) for a, b in zip((4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["d", "start", "n_tokens", "ids_crc32"])


def _with_starts(store: DataFrame) -> DataFrame:
    """Blocks with the ids before them; the running sum is over one row per written partition."""
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    reach = parts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("reach"))
    return store.join(F.broadcast(reach), "part").select((F.col("reach") + F.col("before")).alias("start"), "block")


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start, n_tokens, ids_crc32, all from the files."""
    store = spark.read.schema("part int, seq int, before long, n_ids long, block binary").parquet(path)
    out = _with_starts(store).mapInArrow(_documents, "d long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("d", id_col)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("block").to_pylist():
                block = Block(data)
                for doc_ids, ends in block.documents():
                    ids = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(block.ids[ends[0] : ends[-1]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], ["d", "ids"])

    store = spark.read.schema("part int, seq int, before long, n_ids long, block binary").parquet(path).select("block")
    return store.mapInArrow(run, "d long, ids array<int>").withColumnRenamed("d", id_col)
