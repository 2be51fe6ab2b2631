"""Whole Arrow text columns as flat numpy arrays: bytes, words, word hashes.

A batch of texts stays one UTF-8 byte array; words are (start, end) byte spans and a
64-bit hash of scrambled 8-byte chunks. No Python object is made per word. A hash only
groups; whatever must be exact compares bytes (``distinct_spans``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = 0x20
BATCH_BYTES = 1_000_000  # text that a worker handles at once; its arrays take up to a hundred times as much
_CHUNK = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k of 8 bytes


def _lowered() -> bytes:
    """Byte map: A-Z to a-z; digits, a-z and bytes of non-ASCII text stay; the rest is a space."""
    out = bytearray([SPACE] * 256)
    for b in range(256):
        if 0x41 <= b <= 0x5A:
            out[b] = b + 32
        elif 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            out[b] = b
    return bytes(out)


WORD_MAP = _lowered()
AS_IT_IS = bytes(range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Return freed memory to the machine; a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """As ``pieces``, but small batches are joined up to about ``most`` bytes first."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in pieces(batches, text, most):
        n = len(text_bytes(piece.column(text))[0])
        if held and size + n > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held = []
    give_back()


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of a byte array on, as one number; zeros after its end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def _later_chunks(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers from 1 of the 8-byte chunks after each span's first, how many each span has)."""
    n = (lens - 1) // 8
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1, n


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: its 8-byte chunks, each scrambled with its number, summed up.

    Hashes of different seeds are independent, so two make a 128-bit key.
    """
    window = eights(raw)
    salt = mix(np.array([seed], np.uint64) + _CHUNK)
    lens = ends - starts
    out = mix((window[starts] & _FIRST_BYTES[np.minimum(lens, 8)]) ^ salt)
    more = np.flatnonzero(lens > 8)
    if len(more):
        k, n = _later_chunks(lens[more])
        at = np.repeat(starts[more], n) + 8 * k
        part = window[at] & _FIRST_BYTES[np.minimum(np.repeat(ends[more], n) - at, 8)]
        out[more] += np.add.reduceat(mix(part ^ mix(k.astype(np.uint64) * _CHUNK + salt)), np.cumsum(n) - n)
    return mix(out + lens.astype(np.uint64) * _LENGTH)


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of True that no text border crosses, as (starts, ends)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | border[1:n]
    end[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Words:
    """Lower-cased words of a batch of texts.

    ``low``: mapped bytes, ``starts``/``ends``: spans, ``hashes``: of each word, and
    ``first``: where each text's words begin (one more entry than texts).
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, table: bytes = WORD_MAP) -> None:
        self.low = np.frombuffer(raw.tobytes().translate(table), np.uint8)
        self.starts, self.ends = spans(self.low != SPACE, off)
        self.first = np.searchsorted(self.starts, off)
        self.hashes = span_hashes(self.low, self.starts, self.ends)

    def second(self) -> np.ndarray:
        """Another hash of each word; with ``hashes`` a 128-bit key."""
        return span_hashes(self.low, self.starts, self.ends, 1)

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of each text with one space between them, and the texts' offsets."""
        lens = self.ends - self.starts + 1
        size = np.concatenate([[0], np.cumsum(lens)])
        at = np.arange(int(size[-1])) - np.repeat(size[:-1], lens) + np.repeat(self.starts, lens)
        raw = np.append(self.low, np.uint8(SPACE))[at]
        raw[size[1:] - 1] = SPACE
        off = size[self.first]  # each text with words ends in one space too many
        filled = np.diff(off) > 0
        keep = np.ones(len(raw), bool)
        keep[off[1:][filled] - 1] = False
        return raw[keep], off - np.concatenate([[0], np.cumsum(filled)])

    def words(self, a: int, b: int) -> list[bytes]:
        """The words a..b-1 of one text."""
        return self.low[self.starts[a] : self.ends[b - 1]].tobytes().split() if b > a else []


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one span of each distinct content, which distinct content each span has).

    Spans are grouped by hash, then compared by all their bytes; if two contents ever share a
    hash, the grouping is done again by the contents themselves.
    """
    hashes = span_hashes(raw, starts, ends)
    _, rep, which = np.unique(hashes, return_index=True, return_inverse=True)
    lens = ends - starts
    same = bool((lens == lens[rep[which]]).all())
    if same and len(starts):  # 8 bytes at once; what lies behind a span's end is masked
        window = eights(raw)
        begin = window[starts] & _FIRST_BYTES[np.minimum(lens, 8)]
        same = bool((begin == begin[rep][which]).all())
        more = np.flatnonzero(lens > 8)
        if same and len(more):
            k, n = _later_chunks(lens[more])
            left = _FIRST_BYTES[np.minimum(np.repeat(lens[more], n) - 8 * k, 8)]
            other = np.repeat(starts[rep[which[more]]], n) + 8 * k
            same = bool(((window[np.repeat(starts[more], n) + 8 * k] ^ window[other]) & left == 0).all())
    if not same:
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(raw[a:b].tobytes(), len(seen)) for a, b in zip(starts, ends, strict=True)])
        rep = np.unique(which, return_index=True)[1]
    return rep, which


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after the other, and the offsets of each."""
    lens = ends - starts
    off = np.concatenate([[0], np.cumsum(lens)])
    at = np.arange(int(off[-1])) - np.repeat(off[:-1], lens) + np.repeat(starts, lens)
    return raw[at], off
