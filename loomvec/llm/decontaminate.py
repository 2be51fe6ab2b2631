"""Operator 5: benchmark decontamination by Wu-Manber multi-pattern search over words.

Items become windows of 13 consecutive words (a shorter, non-empty item is one window).
For each window length there is a block shift table: it says how many words a cursor may
skip because the block of words under it ends no window sooner. Where the shift is zero,
the bucket of the block's suffix hash lists the windows to compare, first by all word
hashes, then by the words' bytes. Cursors of all texts of a batch step together.

Spark cuts the items into windows. While their text and item ids take at most
``block_bytes`` (counted before anything is collected) they travel to the tasks as one block. A larger
benchmark is written once to the shared folder as a table of blocks of about that size, dealt
by a hash of window and item, so neither a long item nor a window of many items makes a
block larger. A task holds ``HELD_BYTES`` of texts, reads block after block past them and
merges the hit spans and items of each. Either way the documents are scanned once, in one
stage without a shuffle, whatever the number of blocks. Workers open the folder with
pyarrow's file systems.

Defined results: null has no words; a text without words has n_hit 0 and is clean; items
without an id or without words take no part; repeated items count once by id; repeated
documents give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm import textscan as ts
from loomvec.llm.common import new_table_path, write

WINDOW = 13
BLOCK_BYTES = 16_000_000
HELD_BYTES = 16_000_000
SLOT_BITS = 20
_ROLL = np.uint64(0xC2B2AE3D27D4EB4F)


class Windows:
    """Shift table and suffix buckets of all windows of one length."""

    def __init__(self, texts: list[bytes], owners: list[list[str]]) -> None:
        self.texts, self.owners = [t.split() for t in texts], owners
        self.m = m = len(self.texts[0])
        self.block = b = min(2, m)
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        self.hashes = ts.Words(raw, np.array([0, len(raw)])).hashes.reshape(len(texts), m)
        self.shift = np.full(1 << SLOT_BITS, m - b + 1, np.uint8)
        for j in range(m - b + 1):
            key = self.key(self.hashes[:, j], self.hashes[:, j + b - 1])
            np.minimum.at(self.shift, self.slot(key), np.uint8(m - b - j))
        suffix = self.key(self.hashes[:, m - b], self.hashes[:, m - 1])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def key(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return ts.mix(one * _ROLL + two)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, words: ts.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in a batch of texts."""
        h, m, b = words.hashes, self.m, self.block
        ends = words.first[1:]
        at = words.first[:-1] + m - 1
        live = at < ends
        at, ends = at[live], ends[live]
        seen = []
        while len(at):
            key = self.key(h[at - b + 1], h[at])
            skip = self.shift[self.slot(key)]
            stop = skip == 0
            if stop.any():
                seen.append(at[stop])
            at = at + np.maximum(skip, 1)
            live = at < ends
            at, ends = at[live], ends[live]
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(seen)
        key = self.key(h[at - b + 1], h[at])
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        n = high - low
        first = np.repeat(at - m + 1, n)
        window = self.order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        for k in range(m):
            same = h[first + k] == self.hashes[window, k]
            first, window = first[same], window[same]
        sure = np.array([words.words(a, a + m) == self.texts[w] for a, w in zip(first.tolist(), window.tolist(), strict=True)], bool)
        return first[sure], window[sure]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, window) of (item, text) rows."""
    for batch in ts.pieces(batches, "t"):
        names, texts = [], []
        for name, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
            words = text.encode().translate(ts.WORD_MAP).split()
            m = min(WINDOW, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                names.append(name)
                texts.append(b" ".join(words[i : i + m]))
                if len(texts) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["i", "w"])
                    names, texts = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["i", "w"])


Pairs = tuple[tuple[str, bytes], ...]  # (item, window)


@lru_cache(maxsize=1)
def matchers(pairs: Pairs) -> list[Windows]:
    """Tables of a block's windows by length; those of the last block stay in the worker."""
    found: dict[int, dict[bytes, list[str]]] = {}
    for name, window in pairs:
        found.setdefault(window.count(b" ") + 1, {}).setdefault(window, []).append(name)
    return [Windows(list(w), list(w.values())) for _, w in sorted(found.items())]


class Blocks:
    """The benchmark's windows: in memory, or as a table in the shared folder with a folder for each block."""

    def __init__(self, pairs: Pairs | None = None, path: str = "", n: int = 1) -> None:
        self.pairs, self.path, self.n = pairs, path, n

    def __iter__(self) -> Iterator[list[Windows]]:
        if self.pairs is not None:
            yield matchers(self.pairs)
            return
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        there = {info.base_name for info in system.get_file_info(fs.FileSelector(root))}
        for b in range(self.n):
            if f"b={b}" in there:  # a hash may leave a block empty
                table = ds.dataset(f"{root}/b={b}", filesystem=system, format="parquet").to_table(columns=["i", "w"])
                yield matchers(tuple(zip(table.column("i").to_pylist(), table.column("w").to_pylist(), strict=True)))


def search(windows: list[Windows], words: ts.Words, found: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after) of every occurrence in a batch; adds the items found in each text."""
    firsts, lasts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in windows:
        at, window = w.find(words)
        firsts.append(at)
        lasts.append(at + w.m)
        doc = np.searchsorted(words.first, at, "right") - 1
        for d, k in set(zip(doc.tolist(), window.tolist(), strict=True)):
            found[d].update(w.owners[k])
    return np.concatenate(firsts), np.concatenate(lasts)


def _spanned(step: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> None:
    """Count each span where it begins and where it has ended."""
    np.add.at(step, firsts, 1)
    np.add.at(step, lasts, -1)


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _verdict(n_words: int, n_hit: int, items: set[str]) -> tuple:
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


def _judged(blocks: Blocks, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bytes = ts.BATCH_BYTES if blocks.n == 1 else HELD_BYTES
        for held in ts.gathered(batches, "t", held_bytes):
            parts = list(ts.pieces(iter([held]), "t", ts.BATCH_BYTES))
            texts = [ts.Words(*ts.text_bytes(x.column("t"))) for x in parts]
            steps = [np.zeros(len(words.hashes) + 1, np.int32) for words in texts]
            found: list[list[set[str]]] = [[set() for _ in range(x.num_rows)] for x in parts]
            for windows in blocks:
                for words, step, items in zip(texts, steps, found, strict=True):
                    _spanned(step, *search(windows, words, items))
            for x, words, step, items in zip(parts, texts, steps, found, strict=True):
                first = words.first
                hit = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
                n_hit = (hit[first[1:]] - hit[first[:-1]]).tolist()
                rows = [_verdict(n, h, f) for n, h, f in zip(np.diff(first).tolist(), n_hit, items, strict=True)]
                yield pa.RecordBatch.from_arrays([x.column(c) for c in carry] + _columns(rows), [*carry, *(c.split()[0] for c in _RESULT.split(", "))])

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Blocks:
    """The distinct (item, window) pairs of a benchmark."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("i is not null and t is not null")
    pairs = items.mapInArrow(_windows, "i string, w binary").distinct()
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("w") + F.octet_length("i")), F.lit(0))).first()[0]
    if size <= block_bytes:
        return Blocks(tuple(sorted((r.i, bytes(r.w)) for r in pairs.collect())))
    n = size // block_bytes + 1
    path = new_table_path(benchmark.sparkSession, "benchmark")
    # one file for each block: a block's rows come from one task
    dealt = pairs.withColumn("b", F.pmod(F.xxhash64("i", "w"), F.lit(n)).cast("int")).repartition(n, "b")
    write(dealt, path, partition_by="b")
    return Blocks(path=path, n=n)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """Per document row: id, ``keep`` columns and the verdict columns, their names after ``prefix``."""
    kept = [id_col, *keep]
    carry = [f"c{i}" for i in range(len(kept))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, carry, strict=True)], F.col(f"`{text_col}`").cast("string").alias("t"))
    kinds = ", ".join(f"{n} {inner.schema[n].dataType.simpleString()}" for n in carry)
    out = inner.mapInArrow(_judged(benchmark_blocks(benchmark, item_col, item_text_col, block_bytes), carry), f"{kinds}, {_RESULT}")
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, carry, strict=True)], *(F.col(x.split()[0]).alias(prefix + x.split()[0]) for x in _RESULT.split(", ")))
