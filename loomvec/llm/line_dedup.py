"""Operator 6: line deduplication by an exact set-similarity join.

A line is the set of its words. In the order (document id, line number), a line is removed
if an earlier line has the same words or a Jaccard similarity of at least ``THRESHOLD``
with it. Steps:

1. Counts of all words in ``2**RANK_BITS`` hash buckets give one rarity order of all words.
2. Lines with equal word sets become one set (the first line stands for it), pre-aggregated
   before the shuffle. A set is known by 128 bits: sums over two independent word hashes.
3. Each set sends its prefix (its ``n - ceil(t n) + 1`` rarest words) to the words' tasks.
   Two similar sets share a word of both prefixes. Pairs inside a word pass a length filter
   (a window over sizes), a positional filter and a bitmap filter (128 parity bits bound
   the symmetric difference from below); none of them loses a similar pair. Sets of under four
   words have no similar set but themselves and are not sent, nor are words that the prefix
   of only one set has.
4. Of the pairs that are left, each set's earliest partner is verified exactly on the words'
   bytes. Sets that it does not decide and that had more partners go through step 3 again,
   and have all their partners verified. Only words of the prefixes of such sets are sent
   then: a bitmap of ``2**SLOT_BITS`` bits tells them, whatever the number of sets.
5. The lines that stay are joined back to the documents.

Step 3 moves packed columns (one row per batch and task), not one row per word. A word that
is in over ``BLOCK`` prefixes is dealt out in pairs of blocks of its sets, so a task holds
about ``POSTINGS`` records, however frequent a word is. At most ``FREQUENT`` words are dealt
out like this: with more than ``BLOCK * FREQUENT`` postings the blocks grow.

Defined results: null text stays null; lines without words stay; a document whose lines
all go has an empty text; rows with equal id and text are one document, each gets the same
result; null ids come last in the order; other columns are kept if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm import textscan as ts
from loomvec.llm.common import Scratch, partitions

THRESHOLD = 0.8
RANK_BITS = 18
SMALLEST = 4
SLOT_BITS, SLOT_CHUNKS = 22, 64
BLOCK, FREQUENT = 1 << 15, 1 << 20
POSTINGS = 500_000
PAIRS = 1_000_000
NO_ID = 2**63 - 1

#: Fields of a posting. ``left``: words of the set from this one on, and the marks below.
RECORD = {"unit": "<u4", "size": "<u4", "left": "<u4", "line": "<i4", "d": "<i8", "set": "<u8", "bits": "<u8", "bits2": "<u8"}
RECORD_BYTES = sum(np.dtype(k).itemsize for k in RECORD.values())
CROSSING, LATER_BLOCK, OPEN = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32(1 << 31)
SET = ["one", "d", "line"]  # tells a set: its first hash sum and its first line
SET_KIND = "one long, d long, line int"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << RANK_BITS, np.int64)
    for batch in ts.gathered(batches, "t", ts.BATCH_BYTES):
        words = ts.Words(*ts.text_bytes(batch.column("t")))
        np.add.at(total, (words.hashes >> np.uint64(64 - RANK_BITS)).astype(np.int64), 1)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])


def rarity(rows: DataFrame) -> np.ndarray:
    """Rank of each bucket of words, the rarest first; counted over all texts."""
    counts = rows.select("t").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(1 << RANK_BITS, np.int64)
    n[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    rank = np.empty(len(n), np.uint32)
    rank[np.lexsort((np.arange(len(n)), n))] = np.arange(len(n), dtype=np.uint32)
    return rank


class LineSets:
    """The distinct words of each line with words, the rarest first.

    ``doc``, ``line``: of each such line; ``tokens`` (word hashes) with offsets ``off``;
    ``low``, ``starts`` and ``ends``: the bytes of each token's word.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, rank: np.ndarray) -> None:
        words = ts.Words(raw, off)
        filled = off[:-1][np.diff(off) > 0]
        begin = np.unique(np.concatenate([filled, np.flatnonzero(raw == 10) + 1]))
        at = np.searchsorted(begin, words.starts, "right") - 1  # line of each word
        h, other = words.hashes, words.second()
        low_bits = 64 - RANK_BITS - max(1, int(len(begin)).bit_length())
        low = h & np.uint64((1 << 64 - RANK_BITS) - 1)
        key = at.astype(np.uint64) << np.uint64(RANK_BITS + low_bits) | rank[(h >> np.uint64(64 - RANK_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(low_bits) | low >> np.uint64(64 - RANK_BITS - low_bits)
        order = np.argsort(key)
        again = np.zeros(len(h), bool)
        again[1:] = key[order][1:] == key[order][:-1]
        differ = (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])
        if (again[1:] & differ).any():  # different words with one short key
            order = np.lexsort((other, h, key))
            again[1:] = (h[order][1:] == h[order][:-1]) & (other[order][1:] == other[order][:-1]) & (at[order][1:] == at[order][:-1])
        order = order[~again]
        at = at[order]
        self.tokens, other = h[order], other[order]
        self.low, self.starts, self.ends = words.low, words.starts[order], words.ends[order]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        first = np.flatnonzero(new)
        self.off = np.append(first, len(at))
        which = at[first]
        self.doc = np.searchsorted(off, begin[which], "right") - 1
        self.line = which - np.searchsorted(begin, off[self.doc])
        self.size = np.diff(self.off)
        if len(first):
            self.one = np.add.reduceat(ts.mix(self.tokens), first) + self.size.astype(np.uint64)
            self.two = np.add.reduceat(ts.mix(other), first)
            bit = np.uint64(1) << (self.tokens & np.uint64(63))
            second = self.tokens & np.uint64(64) != 0
            self.bits = np.bitwise_xor.reduceat(np.where(second, np.uint64(0), bit), first)
            self.bits2 = np.bitwise_xor.reduceat(np.where(second, bit, np.uint64(0)), first)
        else:
            self.one = self.two = self.bits = self.bits2 = np.zeros(0, np.uint64)

    def words(self, lines: np.ndarray) -> pa.Array:
        """The words' bytes of some lines, rarest first, with a space after each."""
        n = self.size[lines]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.off[:-1][lines], n)
        lens = self.ends[at] - self.starts[at] + 1
        end = np.cumsum(lens)
        byte = np.arange(int(lens.sum())) - np.repeat(end - lens, lens) + np.repeat(self.starts[at], lens)
        raw = np.append(self.low, np.uint8(ts.SPACE))[byte]
        raw[end - 1] = ts.SPACE
        ends = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)])]
        return pa.Array.from_buffers(pa.large_binary(), len(lines), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _first_sets(rank: np.ndarray, threshold: float):
    """One row per distinct word set of a batch: its earliest line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.gathered(batches, "t", ts.BATCH_BYTES):
            sets = LineSets(*ts.text_bytes(batch.column("t")), rank)
            d = batch.column("d").to_numpy(zero_copy_only=False)[sets.doc]
            th = batch.column("th").to_numpy(zero_copy_only=False)[sets.doc]
            order = np.lexsort((sets.line, th, d, sets.two, sets.one))
            one, two = sets.one[order], sets.two[order]
            lead = np.ones(len(order), bool)
            lead[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            pick = order[lead]
            size = sets.size[pick]
            n = np.where(size >= SMALLEST, prefix_size(size, threshold), 0)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(sets.off[:-1][pick], n)
            prefix = (sets.tokens[at] >> np.uint64(32)).astype("<u4").tobytes()
            ends = 4 * np.concatenate([[0], np.cumsum(n)])
            packed = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(prefix)])
            cols = [pa.array(sets.one[pick].view(np.int64)), pa.array(sets.two[pick].view(np.int64)), pa.array(d[pick]), pa.array(th[pick]), pa.array(sets.line[pick].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(sets.bits[pick].view(np.int64)), pa.array(sets.bits2[pick].view(np.int64)), packed]
            yield pa.RecordBatch.from_arrays(cols, ["one", "two", "d", "th", "line", "size", "bits", "bits2", "prefix"])

    return run


def _slot(tok: np.ndarray) -> np.ndarray:
    """The slot of each prefix word (the top half of a hash) in tables of ``2**SLOT_BITS``."""
    return (tok >> np.uint32(32 - SLOT_BITS)).astype(np.int64)


def _prefix_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, off = ts.text_bytes(batch.column("prefix"))
    return np.frombuffer(raw.tobytes(), "<u4"), off // 4


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOT_BITS, np.uint32)
    for batch in batches:
        np.add.at(total, _slot(_prefix_words(batch)[0]), np.uint32(1))
    if total.any():
        chunks = total.reshape(SLOT_CHUNKS, -1)
        for k in np.flatnonzero(chunks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunks[k].astype("<u4").tobytes()], pa.binary())], ["chunk", "counts"])


def _slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a chunk of slots: their counts, cut at 2**32 - 1, as a binary, and all postings."""
    total, chunk = np.zeros((1 << SLOT_BITS) // SLOT_CHUNKS, np.int64), None
    for batch in batches:
        for k, data in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            chunk = k
            total += np.frombuffer(data.as_buffer(), "<u4")
    if chunk is not None:
        counts = np.minimum(total, 2**32 - 1).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([counts], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["chunk", "counts", "n"])


def _words_of(slots: np.ndarray):
    """(word, postings) of the prefix words in some slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, _ = _prefix_words(batch)
            found, n = np.unique(tok[np.isin(_slot(tok), slots)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return run


class Frequencies:
    """What the postings of all sets say about their words; its size has a bound that does not depend on the data.

    ``single``: slots with one posting, which meets none. ``hot``: words with over ``block``
    postings, and into how many ``blocks`` the sets of each are dealt. ``total``: records that
    the tasks get in all.
    """

    def __init__(self, sets: DataFrame, block: int) -> None:
        counted = sets.select("prefix").mapInArrow(_slot_counts, "chunk int, counts binary")
        found = counted.repartitionById(SLOT_CHUNKS, F.col("chunk")).mapInArrow(_slot_sums, "chunk int, counts binary, n long").collect()
        count = np.zeros((SLOT_CHUNKS, (1 << SLOT_BITS) // SLOT_CHUNKS), np.uint32)
        for r in found:
            count[r.chunk] = np.frombuffer(r.counts, "<u4")
        self.single, self.total = np.packbits(count.ravel() == 1), sum(r.n for r in found)
        block = max(block, self.total // FREQUENT)
        slots = np.flatnonzero(count.ravel() > block)
        frequent = []
        if len(slots):  # a slot may hold many words; exact counts tell the frequent ones
            words = sets.select("prefix").mapInArrow(_words_of(slots), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
            frequent = words.where(F.col("n") > block).orderBy("word").collect()
        self.hot = np.array([r.word for r in frequent], np.uint32)
        n = np.array([r.n for r in frequent], np.int64)
        self.blocks = -(-n // block)
        self.total += int((n * (self.blocks - 1)).sum())


def open_flags(sets: DataFrame) -> np.ndarray:
    """Packed bits of the slots in the column ``slots``; at most ``2**SLOT_BITS`` numbers come to the driver."""
    seen = sets.select(F.explode("slots").alias("slot")).distinct().toPandas()
    flags = np.zeros(1 << SLOT_BITS, bool)
    flags[seen["slot"].to_numpy(np.int64)] = True
    return np.packbits(flags)


def packed(cols: dict[str, np.ndarray], a: int, b: int) -> bytes:
    """Records a..b-1, field after field and byte plane after byte plane: high bytes, mostly zero, pack well."""
    return b"".join(np.ascontiguousarray(cols[f][a:b].astype(kind).view(np.uint8).reshape(b - a, -1).T).tobytes() for f, kind in RECORD.items())


def unpacked(data: list[bytes]) -> dict[str, np.ndarray]:
    """Fields of the records of packed rows."""
    parts: dict[str, list[np.ndarray]] = {f: [] for f in RECORD}
    for x in data:
        n, at = len(x) // RECORD_BYTES, 0
        for f, kind in RECORD.items():
            size = np.dtype(kind).itemsize
            planes = np.frombuffer(x, np.uint8, n * size, at).reshape(size, n)
            parts[f].append(np.ascontiguousarray(planes.T).view(kind).ravel())
            at += n * size
    return {f: np.concatenate(p) for f, p in parts.items()}


def _postings(n_tasks: int, words: Frequencies, flags: np.ndarray | None = None):
    """Packed records of each prefix word (of those in ``flags``), one row per batch and task."""
    single, hot, blocks = words.single, words.hot, words.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = ~np.unpackbits(single).astype(bool)
        if flags is not None:
            wanted &= np.unpackbits(flags).astype(bool)
        for batch in batches:
            tok, off = _prefix_words(batch)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(off))
            left = batch.column("size").to_numpy(zero_copy_only=False)[owner] - (np.arange(len(tok)) - off[:-1][owner])
            slot = _slot(tok)
            use = np.flatnonzero(wanted[slot])
            tok, owner, left = tok[use], owner[use], left[use].astype(np.uint32)
            unit, key = tok, batch.column("one").to_numpy(zero_copy_only=False).view(np.uint64)
            if len(hot):  # each record of a frequent word goes to every pair of blocks that its own is in
                at = np.minimum(np.searchsorted(hot, tok), len(hot) - 1)
                n = np.where(hot[at] == tok, blocks[at], 1)
                one = np.repeat(np.arange(len(tok)), n)
                own = (ts.mix(key[owner]) % n.astype(np.uint64)).astype(np.int64)[one]
                other = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
                i, j = np.minimum(own, other), np.maximum(own, other)
                tok, owner, left, dealt = tok[one], owner[one], left[one], n[one] > 1
                pair = ts.mix(ts.mix(tok.astype(np.uint64) | i.astype(np.uint64) << np.uint64(32)) + j.astype(np.uint64))
                unit = np.where(dealt, (pair >> np.uint64(32)).astype(np.uint32), tok)
                left |= np.where(i != j, CROSSING, np.uint32(0)) | np.where((i != j) & (own == j), LATER_BLOCK, np.uint32(0))
            task = (ts.mix(unit.astype(np.uint64)) % np.uint64(n_tasks)).astype(np.int64)
            order = np.lexsort((unit, task))
            owner, task = owner[order], task[order]
            cols = {"unit": unit[order], "left": left[order], "set": key[owner]}
            for f in ("size", "line", "d", "bits", "bits2"):
                cols[f] = batch.column(f).to_numpy(zero_copy_only=False)[owner]
            if "open" in batch.schema.names:
                cols["size"] = cols["size"].astype(np.uint32) | np.where(batch.column("open").to_numpy(zero_copy_only=False)[owner], OPEN, np.uint32(0))
            starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(task))[: len(starts)]
            data = [packed(cols, a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(task[starts], pa.int32()), pa.array(data, pa.binary())], ["task", "data"])

    return run


def similar_pairs(rec: dict[str, np.ndarray], threshold: float, earliest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later record, earlier record, had more) of the pairs of sets that pass all filters, from one task's records.

    With ``earliest`` each later set comes once, with its earliest partner. Else the pairs of
    each later set that is marked open come, those found together once.
    """
    key = rec["unit"].astype(np.uint64) << np.uint64(32) | (rec["size"] & ~OPEN).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    size = (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
    left = (rec["left"] & ~(CROSSING | LATER_BLOCK)).astype(np.int32)[order]
    crossing, block = (rec["left"] & CROSSING != 0)[order], (rec["left"] & LATER_BLOCK != 0)[order]
    is_open = (rec["size"] & OPEN != 0)[order]
    bits, bits2 = rec["bits"][order], rec["bits2"][order]
    place = np.lexsort((rec["set"], rec["line"], rec["d"]))
    new = np.ones(len(key), bool)
    new[1:] = np.logical_or.reduce([rec[f][place][1:] != rec[f][place][:-1] for f in ("set", "line", "d")])
    pos = np.empty(len(key), np.int32)
    pos[place] = np.cumsum(new) - 1  # numbers the sets in the order of their lines
    record = place[new]  # one record of each set
    pos = pos[order]
    shortest = np.ceil(threshold * size - 1e-9).astype(np.uint64)
    low = np.searchsorted(key, key >> np.uint64(32) << np.uint64(32) | shortest, "left").astype(np.int32)
    number = np.arange(len(key), dtype=np.int32)
    count = number - low
    reach = np.cumsum(count, dtype=np.int64)
    factor = threshold / (1 + threshold)
    first, last = np.full(len(record), len(record), np.int32), np.full(len(record), -1, np.int32)
    crosses = bool(crossing.any())
    a = 0
    while a < len(key):
        z = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + PAIRS, "right")))
        n = count[a:z]
        i = np.repeat(number[a:z], n)
        j = np.arange(len(i), dtype=np.int32) - np.repeat((np.cumsum(n) - n - low[a:z]).astype(np.int32), n)
        a = z
        if not earliest:
            ok = is_open[i] | is_open[j]
            i, j = i[ok], j[ok]
        if crosses:
            ok = ~crossing[i] | (block[i] != block[j])
            i, j = i[ok], j[ok]
        both = size[i] + size[j]
        need = np.ceil(factor * both - 1e-9).astype(np.int32)
        ok = np.flatnonzero(np.minimum(left[i], left[j]) >= need)
        i, j, spare = i[ok], j[ok], (both - 2 * need)[ok]
        apart = np.bitwise_count(bits[i] ^ bits[j])
        ok = np.flatnonzero(apart <= spare)
        i, j, spare, apart = i[ok], j[ok], spare[ok], apart[ok]
        ok = np.flatnonzero((apart + np.bitwise_count(bits2[i] ^ bits2[j]).astype(np.int32) <= spare) & (pos[i] != pos[j]))
        i, j = i[ok], j[ok]
        later, earlier = np.maximum(pos[i], pos[j]), np.minimum(pos[i], pos[j])
        if earliest:
            np.minimum.at(first, later, earlier)
            np.maximum.at(last, later, earlier)
        else:
            asked = np.where(pos[i] > pos[j], is_open[i], is_open[j])
            pair = np.unique(later[asked].astype(np.int64) << 32 | earlier[asked])
            if len(pair):
                yield record[pair >> 32], record[pair & 0xFFFFFFFF], np.zeros(len(pair), bool)
    if earliest:
        later = np.flatnonzero(last >= 0)
        yield record[later], record[first[later]], first[later] != last[later]


def _candidates(threshold: float, earliest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in batch.column("data").to_pylist()]
        if not held:
            return
        rec = unpacked(held)
        del held
        for later, earlier, more in similar_pairs(rec, threshold, earliest):
            cols = [pa.array(rec[f][k].view(np.int64) if f == "set" else rec[f][k]) for k in (later, earlier) for f in ("set", "d", "line")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(more)], [*SET, "p_one", "p_d", "p_line", "more"])
        ts.give_back()

    return run


def _pairs(sets: DataFrame, words: Frequencies, threshold: float, flags: np.ndarray | None = None) -> DataFrame:
    """(set, its earlier partner p_..., more). Without ``flags`` each set's earliest partner, else all of open sets."""
    n_tasks = max(partitions(sets.sparkSession), words.total // POSTINGS + 1)
    sent = sets.select(*SET, "size", "bits", "bits2", "prefix", *["open"] * (flags is not None)).mapInArrow(_postings(n_tasks, words, flags), "task int, data binary")
    found = sent.repartitionById(n_tasks, F.col("task")).mapInArrow(_candidates(threshold, flags is None), f"{SET_KIND}, p_one long, p_d long, p_line int, more boolean")
    if flags is not None:
        return found.groupBy(*SET, "p_one", "p_d", "p_line").agg(F.lit(True).alias("more"))
    partner = F.struct("p_d", "p_line", "p_one")
    best = found.groupBy(*SET).agg(F.min(partner).alias("p"), F.max(partner).alias("q"), F.max("more").alias("more"))
    return best.select(*SET, "p.*", (F.col("more") | (F.col("p") != F.col("q"))).alias("more"))


def _line_words(rank: np.ndarray):
    """Words of the asked lines: the set and its words, from (t, d, asked lines and sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.gathered(batches, "t", ts.BATCH_BYTES):
            sets = LineSets(*ts.text_bytes(batch.column("t")), rank)
            asked = batch.column("asked").combine_chunks() if isinstance(batch.column("asked"), pa.ChunkedArray) else batch.column("asked")
            doc = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            line, one = flat.field("line"), flat.field("one")
            where = np.searchsorted(sets.doc * (1 << 32) + sets.line, doc * (1 << 32) + line.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([one, batch.column("d").take(pa.array(doc)), line, sets.words(where)], [*SET, "words"])

    return run


def _checked(threshold: float):
    """(set, similar, more, slots) of pairs with the words of both sets; slots: of the prefix of a set that is left undecided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.gathered(ts.gathered(batches, "x", ts.BATCH_BYTES), "y", ts.BATCH_BYTES):
            n = batch.num_rows
            sides = [ts.text_bytes(batch.column(c)) for c in ("x", "y")]
            words = ts.Words(np.concatenate([raw for raw, _ in sides]), np.concatenate([sides[0][1], sides[0][1][-1] + sides[1][1][1:]]), ts.AS_IT_IS)
            rep, number = ts.distinct_spans(words.low, words.starts, words.ends)
            pair = np.repeat(np.arange(2 * n) % n, np.diff(words.first))
            key = np.sort(pair * len(rep) + number)
            shared = np.bincount(key[1:][key[1:] == key[:-1]] // max(1, len(rep)), minlength=n)
            size = np.diff(words.first)
            similar = shared >= threshold * (size[:n] + size[n:] - shared) - 1e-9
            more = batch.column("more").to_numpy(zero_copy_only=False).astype(bool)
            count = np.where(more & ~similar, prefix_size(size[:n], threshold), 0)
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(words.first[:n], count)
            slots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(_slot((words.hashes[at] >> np.uint64(32)).astype(np.uint32)), pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in SET], pa.array(similar), pa.array(more), slots], [*SET, "similar", "more", "slots"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, rank: np.ndarray, threshold: float) -> DataFrame:
    """Each pair's set with whether the pair is similar: (set, similar, more, slots)."""
    partner = [F.col(f"p_{c}").alias(c) for c in SET]
    need = pairs.select(*SET).unionByName(pairs.select(*partner)).distinct()
    asked = sets.select(*SET, "th").join(need, SET, "left_semi").groupBy("d", "th").agg(F.sort_array(F.collect_list(F.struct("line", "one"))).alias("asked"))
    words = rows.join(asked, ["d", "th"]).select("t", "d", "asked").mapInArrow(_line_words(rank), f"{SET_KIND}, words binary")
    both = pairs.join(words.withColumnRenamed("words", "x"), SET).join(words.select(*[F.col(c).alias(f"p_{c}") for c in SET], F.col("words").alias("y")), [f"p_{c}" for c in SET])
    return both.select(*SET, "more", "x", "y").mapInArrow(_checked(threshold), f"{SET_KIND}, similar boolean, more boolean, slots array<int>")


def _applied(carry: list[str], text: str):
    """Texts without the lines that have words and are not listed as staying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.gathered(batches, text, ts.BATCH_BYTES):
            raw, off = ts.text_bytes(batch.column(text))
            starts, _ = ts.spans(np.frombuffer(raw.tobytes().translate(ts.WORD_MAP), np.uint8) != ts.SPACE, off)
            filled = off[:-1][np.diff(off) > 0]
            begin = np.unique(np.concatenate([filled, np.flatnonzero(raw == 10) + 1]))
            wordy = np.unique(np.searchsorted(begin, starts, "right") - 1)
            doc = np.searchsorted(off, begin[wordy], "right") - 1
            line = wordy - np.searchsorted(begin, off[doc])
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            out: list[str | None] = []
            n_lines, n_removed = [], []
            for k, (t, stay) in enumerate(zip(batch.column(text).to_pylist(), batch.column("stay").to_pylist(), strict=True)):
                gone = set(line[first[k] : first[k + 1]].tolist()) - set(stay or ())
                if gone:
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
                    if not t.strip():
                        t = ""
                out.append(t)
                n_lines.append(first[k + 1] - first[k])
                n_removed.append(len(gone))
            cols = [batch.column(c) if c != text else pa.array(out, pa.string()) for c in carry]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*carry, "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD, prefix: str = "", block: int = BLOCK) -> DataFrame:
    """Columns id, ``keep``, text, n_lines (lines with words) and n_removed, the last two after ``prefix``."""
    kept = [id_col, *keep, text_col]
    carry = [f"c{i}" for i in range(len(kept))]
    text = carry[-1]
    told = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept[:-1], carry, strict=False)], F.col(f"`{text_col}`").cast("string").alias(text))
    told = told.withColumns({"d": F.coalesce(F.col("c0").cast("long"), F.lit(NO_ID)), "th": F.xxhash64(text)})
    rows = told.select("d", "th", F.col(text).alias("t"))
    if not told.groupBy("d").count().where("count > 1").isEmpty():  # the usual table has no id twice and pays no shuffle
        rows = rows.dropDuplicates(["d", "th"])
    scratch = Scratch(docs.sparkSession)
    rank = rarity(rows)
    sets = rows.mapInArrow(_first_sets(rank, threshold), "one long, two long, d long, th long, line int, size int, bits long, bits2 long, prefix binary")
    sets = sets.groupBy("one", "two").agg(F.min(F.struct("d", "th", "line")).alias("at"), *[F.first(c).alias(c) for c in ("size", "bits", "bits2", "prefix")])
    sets = scratch.write(sets.select("one", "at.*", "size", "bits", "bits2", "prefix"), "line-sets")
    words = Frequencies(sets, block)
    pairs = scratch.write(_pairs(sets, words, threshold), "line-pairs")
    checked = scratch.write(_verified(pairs, sets, rows, rank, threshold), "line-checks")
    gone = checked.where("similar").select(*SET)
    unsure = checked.where("more and not similar")
    if not unsure.isEmpty():
        flags = open_flags(unsure)
        marked = sets.join(unsure.select(*SET, F.lit(True).alias("open")), SET, "left").withColumn("open", F.coalesce("open", F.lit(False)))
        every = scratch.write(_pairs(marked, words, threshold, flags), "line-pairs")
        rest = scratch.write(_verified(every, sets, rows, rank, threshold).where("similar").select(*SET).distinct(), "line-gone")
        gone = gone.unionByName(rest)
    stay = scratch.write(sets.join(gone, SET, "left_anti").groupBy("d", "th").agg(F.collect_list("line").alias("stay")), "line-stays")
    scratch.drop("line-sets", "line-pairs", "line-checks", "line-gone")
    out = told.join(stay, ["d", "th"], "left").drop("d", "th")
    kinds = ", ".join(f"{n} {told.schema[n].dataType.simpleString()}" for n in carry)
    out = out.mapInArrow(_applied(carry, text), f"{kinds}, n_lines long, n_removed long")
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, carry, strict=True)], F.col("n_lines").alias(f"{prefix}n_lines"), F.col("n_removed").alias(f"{prefix}n_removed"))
