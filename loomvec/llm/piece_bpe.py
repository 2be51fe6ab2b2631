"""Operator 3: piece encoding and decoding by vectorised merge rounds.

A batch's texts are cut where no piece can cross (before a run of spaces that follows
other text), distinct words are kept once, and their symbols lie in one flat array. Each
round finds the minimum pair rank of every word (segmented minimum), merges that pair's
occurrences in the word that do not overlap, the leftmost first, and compacts the array,
until no pair remains.

That keeps the library's order (best score, then leftmost) exactly where no pair that a
merge makes comes before the merge itself. Other pieces (``hasty``, found when the model is
loaded) may at once join a neighbour, but what grows out of one merge is one piece, so
occurrences that lie over twice the longest piece apart cannot meet: of a hasty piece's
occurrences that lie closer, a round merges the leftmost. A word that still has pairs after
``ROUNDS`` rounds (thousands of close hasty occurrences, as in one endless run of spaces)
takes the rest in the same order from a heap.

Defined results: null and empty text give no ids and an empty decoded text; repeated rows
give repeated results; columns other than id and text are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm import textscan as ts

ROUNDS = 2048
NEVER = np.int32(2**31 - 1)
MARK = "▁"
_MARK_BYTES = MARK.encode()


def _each_bad_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("loomvec-each-byte", _each_bad_byte)


class PieceModel:
    """Pieces, ranks and the pair table of a byte-fallback BPE model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_id = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(text[i][3:5], 16)] = i
        if (self.byte_id < 0).any() or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("the model must have byte fallback and no unused pieces")
        if any(MARK in p.lstrip(MARK) for p in (text[i] for i in plain)):
            raise ValueError("a piece with a space inside can't be cut into words")
        self.n = n
        symbol = {text[i]: i for i in plain}
        for c in sorted({c for i in plain for c in text[i]} - symbol.keys()):
            symbol[c] = len(symbol) + n  # a character that only occurs inside pieces
        self.width = max(symbol.values()) + 2
        self.foreign = self.width - 1  # any character that no piece has
        scores = np.array([sp.get_score(i) for i in plain])
        rank_of = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        for i, rank in zip(plain, rank_of, strict=True):
            for k in range(1, len(text[i])):
                left, right = symbol.get(text[i][:k]), symbol.get(text[i][k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (rank, i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        # pieces that once made may join a neighbour at no later a rank than their own
        own = dict(zip(plain, rank_of.tolist(), strict=True))
        self.apart = 2 * max(len(text[i]) for i in plain)
        self.hasty = np.zeros(self.width, bool)
        for key, (rank, _) in pairs.items():
            for side in divmod(key, self.width):
                self.hasty[side] |= rank <= own.get(side, -1)
        # an open-addressed copy of the pair table: one gather for most pairs
        self.bits = 20
        while (1 << self.bits) < 6 * len(self.keys):
            self.bits += 1
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_at = np.zeros(1 << self.bits, np.int32)
        left, step = np.arange(len(self.keys)), 0
        while len(left):
            slot = (self._slot(self.keys[left]) + step) & ((1 << self.bits) - 1)
            free = self.slot_key[slot] < 0
            where, which = np.unique(slot[free], return_index=True)
            put = left[free][which]
            self.slot_key[where], self.slot_at[where] = self.keys[put], put
            left, step = np.setdiff1d(left, put), step + 1
        self.probes = step
        self.char_symbol = np.full(0x110000, self.foreign, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        self.symbol_bytes = {i: s.encode() for s, i in symbol.items()}
        self.out_bytes = [b""] * n
        for i in range(n):
            if self.is_plain(i, sp):
                self.out_bytes[i] = text[i].replace(MARK, " ").encode()
            elif sp.is_byte(i):
                self.out_bytes[i] = bytes([int(text[i][3:5], 16)])
            elif sp.is_unknown(i):
                self.out_bytes[i] = " ⁇ ".encode()
        self.id_text = [str(i) for i in range(n)]

    @staticmethod
    def is_plain(i: int, sp) -> bool:
        return not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; rank NEVER where no piece is made."""
        keys = left.astype(np.int64) * self.width + right
        rank, made = np.full(len(keys), NEVER, np.int32), np.zeros(len(keys), np.int32)
        base, todo = self._slot(keys), np.arange(len(keys))
        for step in range(self.probes):
            slot = (base[todo] + step) & ((1 << self.bits) - 1)
            there = self.slot_key[slot]
            hit = there == keys[todo]
            at = self.slot_at[slot[hit]]
            rank[todo[hit]], made[todo[hit]] = self.ranks[at], self.made[at]
            todo = todo[~hit & (there >= 0)]
            if not len(todo):
                break
        return rank, made

    def merge_rounds(self, symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of each word and their offsets."""
        lens = np.diff(off)
        word = np.flatnonzero(lens)
        lens = lens[word]
        done_symbols: list[np.ndarray] = []
        done_words: list[np.ndarray] = []
        rank = np.full(len(symbols), NEVER, np.int32)
        made = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], made[:-1] = self.pair(symbols[:-1], symbols[1:])
        if len(lens):
            rank[np.cumsum(lens) - 1] = NEVER
        rounds = 0
        while len(word):
            rounds += 1
            start = np.cumsum(lens) - lens
            if rounds > ROUNDS:
                for w, a, n in zip(word.tolist(), start.tolist(), lens.tolist(), strict=True):
                    done_symbols.append(np.array(self.merge_heap(symbols[a : a + n].tolist()), np.int32))
                    done_words.append(np.full(len(done_symbols[-1]), w))
                break
            least = np.minimum.reduceat(rank, start)
            live = least < NEVER
            if not live.all():
                over = ~live
                gone = np.repeat(over, lens)
                done_symbols.append(symbols[gone])
                done_words.append(np.repeat(word[over], lens[over]))
                symbols, rank, made = symbols[~gone], rank[~gone], made[~gone]
                word, lens, least = word[live], lens[live], least[live]
                if not len(word):
                    break
                start = np.cumsum(lens) - lens
            of = np.repeat(np.arange(len(word)), lens)
            hits = np.flatnonzero(rank == least[of])
            owner = of[hits]
            lead = np.ones(len(hits), bool)
            lead[1:] = hits[1:] != hits[:-1] + 1
            run = np.flatnonzero(lead)
            pick = (np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))) % 2 == 0  # of occurrences that overlap every other one
            lead[1:] = (owner[1:] != owner[:-1]) | (hits[1:] - hits[:-1] >= self.apart)
            pick &= lead | ~self.hasty[made[hits]]
            at, owner = hits[pick], owner[pick]
            symbols[at] = made[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, rank, made = symbols[stays], rank[stays], made[stays]
            lens = lens - np.bincount(owner, minlength=len(lens))
            start = np.cumsum(lens) - lens
            at = at - np.arange(len(at))  # one symbol fewer per earlier merge
            last = (start + lens - 1)[owner]
            rank[at[at == last]] = NEVER
            new = np.concatenate([at[at < last], at[at > start[owner]] - 1])
            if len(new):
                rank[new], made[new] = self.pair(symbols[new], symbols[new + 1])
        if not done_words:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        flat, owners = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owners, kind="stable")
        counts = np.bincount(owners, minlength=len(off) - 1)
        return flat[order], np.concatenate([[0], np.cumsum(counts)])

    def merge_heap(self, symbols: list[int]) -> list[int]:
        """The same merges for the symbols of one word, one after the other."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.pair(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r < NEVER]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int) -> None:
            j = after[i]
            if i < 0 or j >= n:
                return
            pair = (symbols[i], symbols[j])
            if pair not in known:
                r, m = self.pair(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = (int(r[0]), int(m[0]))
            if known[pair][0] < NEVER:
                heapq.heappush(heap, (known[pair][0], i, *pair, known[pair][1]))

        while heap:
            _, i, left, right, m = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s >= 0]

    def encode_words(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of words given as UTF-8 spans in which a space stands for the mark."""
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        char_off = lead[off]
        chars = np.where(chars == 32, ord(MARK), chars)
        symbols = self.char_symbol[chars]
        strange = symbols == self.foreign
        if not strange.any():
            out, out_off = self.merge_rounds(symbols, char_off)
            if not len(out) or out.max() < self.n:
                return out.astype(np.int64), out_off
            odd = {}
        else:  # each unknown character has a symbol of its own, which pairs with nothing
            kinds, which = np.unique(chars[strange], return_inverse=True)
            odd = {-2 - k: chr(c).encode() for k, c in enumerate(kinds.tolist())}
            kept = symbols.copy()
            out, out_off = self.merge_rounds(kept, char_off)
            where = np.flatnonzero(out == self.foreign)
            out = out.astype(np.int64)
            out[where] = -2 - which
        ids: list[int] = []
        counts = np.ones(len(out), np.int64)
        for k, s in enumerate(out.tolist()):
            if 0 <= s < self.n:
                ids.append(s)
            else:
                as_bytes = odd[s] if s < 0 else self.symbol_bytes[s]
                ids.extend(int(self.byte_id[b]) for b in as_bytes)
                counts[k] = len(as_bytes)
        reach = np.concatenate([[0], np.cumsum(counts)])
        return np.array(ids, np.int64), reach[out_off]

    def encode_batch(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids and offsets of distinct words, which distinct word each word is, first word of each text)."""
        if _MARK_BYTES in (whole := raw.tobytes()):
            texts = [whole[a:b].replace(_MARK_BYTES, b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
            raw = np.frombuffer(b"".join(texts), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        filled = np.diff(off) > 0
        raw = np.insert(raw, off[:-1][filled], ts.SPACE)  # the mark before each text
        off = off + np.concatenate([[0], np.cumsum(filled)])
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        space = raw == ts.SPACE
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[off[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        rep, which = ts.distinct_spans(raw, starts, ends)
        ids, id_off = self.encode_words(*ts.joined(raw, starts[rep], ends[rep]))
        return ids, id_off, which, np.searchsorted(starts, off)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.out_bytes[i] for i in ids])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        raw, off = ts.text_bytes(pa.array(texts, pa.string()))
        ids, id_off, which, first = self.encode_batch(raw, off)
        return [np.concatenate([ids[id_off[w] : id_off[w + 1]] for w in which[a:b]] or [ids[:0]]).tolist() for a, b in zip(first[:-1], first[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: pieces joined, marks to spaces, the first mark dropped; broken byte runs give U+FFFD for each byte."""
        text = self.decode_bytes(ids)
        drop = bool(ids) and text[:1] == b" " and not 3 <= ids[0] < 259
        return text[int(drop) :].decode("utf-8", "loomvec-each-byte")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of a file, once per Python worker."""
    return PieceModel(path)


def _encoded(path: str, text: str, keep: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in ts.gathered(batches, text, ts.BATCH_BYTES):
            raw, off = ts.text_bytes(batch.column(text))
            ids, id_off, which, first = m.encode_batch(raw, off)
            flat = ids.tolist()
            each = [flat[a:b] for a, b in zip(id_off[:-1].tolist(), id_off[1:].tolist(), strict=True)]
            as_text = np.array([",".join([m.id_text[i] for i in x]) for x in each] + [""], object)
            as_bytes = np.array([m.decode_bytes(x) for x in each] + [b""], object)
            count = np.diff(id_off)[which] if len(which) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(count)])
            n_tokens = total[first[1:]] - total[first[:-1]]
            sha, back = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                mine = which[a:b]
                sha.append(hashlib.sha256(",".join(as_text[mine].tolist()).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(as_bytes[mine].tolist())[1:]).hexdigest())
            out = [batch.column(c) for c in keep] + [pa.array(n_tokens, pa.int64()), pa.array(sha), pa.array(back)]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                lens = np.diff(id_off)[which] if len(which) else np.zeros(0, np.int64)
                at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(id_off[:-1][which], lens)
                out.append(pa.ListArray.from_arrays(pa.array(total[first], pa.int32()), pa.array(ids[at], pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Per row: id, ``keep`` columns, n_tokens, digests of ids and of the decoded text, and the ids if asked for."""
    kept = [id_col, *keep]
    names = [f"c{i}" for i in range(len(kept))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(f"`{text_col}`").cast("string").alias("t"))
    kinds = ", ".join(f"{n} {inner.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = inner.mapInArrow(_encoded(model_path, "t", names, with_ids), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)
