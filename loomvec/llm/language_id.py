"""Operator 4: language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A
text is parsed greedily into the longest phrases that occur in a language's sample; with c
phrases over n characters and a sample of N characters the cross entropy is
``c * log2(N) / n``. The language with the least (fewest normalised phrases) wins, ties to
the smaller name.

The automata run as transition tables over numpy lanes: every (segment, language) pair is
a lane and all lanes step one character at a time; a missing transition ends a phrase.
Texts are parsed whole. A long one is cut into segments of ``SEGMENT`` characters that are
parsed side by side; then the parse of each segment runs on into the next one until both
begin a phrase at the same character, from where they agree. So the phrases are those of
one parse from the text's beginning (a text whose segments never agree gets just that).

Characters: lower-cased; every run of non-letters is one blank; letters outside the
sample's alphabet end a phrase in every language alike.

The sample, the only bounded input, is whole texts in the order of a hash of id and text:
at most ``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters per language (with many
languages, ``ALL_CHARS`` divided by their number). A text that exceeds what is left is passed
over; a language all of whose texts do takes its shortest one. Every language with one
labelled row with letters is learned.

Defined results: null text and text without letters give ``und`` and score 0, as does
every text when nothing was learned; a null id is not held out (it has no remainder); repeated
rows give repeated rows; other columns are ignored. The score is
``1 - least / second least`` (1 with a single language).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomvec.llm import textscan as ts

SAMPLE_CHARS = 24_000
SAMPLE_ROWS = 400
ALL_CHARS = 240_000
SEGMENT = 1024
LANES = 32  # languages that are parsed at once
BLANK = 0


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or 0 for anything that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one 0 for each run of other characters, and each text's offsets."""
    text = raw.tobytes().decode("utf-8", "replace").encode("utf-32-le")
    chars = fold_table()[np.frombuffer(text, np.uint32)]
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    at = lead[off]
    keep = chars != 0
    if len(keep):
        keep[1:] |= chars[:-1] != 0  # the first of a run of others
        starts = at[:-1][np.diff(at) > 0]
        keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return chars[keep], kept[at]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class CrossParser:
    """One table of all languages' automata: row = state, column = character class."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.names = [n for n, _ in samples]
        coded = []
        for _, s in samples:
            chars, _ = folded(*ts.text_bytes(pa.array([s])))
            coded.append(chars)
        letters = np.unique(np.concatenate([*coded, np.zeros(1, np.uint32)]))  # letters[0] is the blank
        self.classes = len(letters) + 1  # the last class: letters that no sample has
        self.class_of = np.full(0x110000, self.classes - 1, np.int32)
        self.class_of[letters] = np.arange(len(letters))
        self.root, self.bits, rows = [], [], []
        for chars in coded:
            moves = suffix_automaton(self.class_of[chars].tolist())
            base = sum(map(len, rows))
            table = np.full((len(moves), self.classes), -1, np.int32)
            for s, m in enumerate(moves):
                table[s, list(m)] = [x + base for x in m.values()]
            self.root.append(base)
            self.bits.append(np.log2(max(2, len(chars))))
            rows.append(table)
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int32)
        # after a phrase ends at a character, the next one starts with it
        self.again = np.stack([np.where(self.table.reshape(-1, self.classes)[r] < 0, r, self.table.reshape(-1, self.classes)[r]) for r in self.root]) if rows else np.zeros((0, self.classes), np.int32)

    def phrases(self, chars: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of phrases of each text (row) in each language (column)."""
        coded = self.class_of[chars]
        parts = [self._phrases(coded, off, slice(j, j + LANES)) for j in range(0, len(self.names), LANES)]
        return np.concatenate([np.zeros((len(off) - 1, 0)), *parts], axis=1)

    def _phrases(self, coded: np.ndarray, off: np.ndarray, langs: slice) -> np.ndarray:
        root, again = np.array(self.root[langs], np.int32), self.again[langs]
        lens = np.diff(off)
        n_seg = -(-lens // SEGMENT)
        owner = np.repeat(np.arange(len(lens)), n_seg)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        begin = off[:-1][owner] + SEGMENT * within
        size = np.minimum(SEGMENT, off[1:][owner] - begin)
        count, stops, state, rank = self._parse(coded, begin, size, root, again)
        total = np.stack([np.bincount(owner, c, len(lens)) for c in count], axis=1) + (lens > 0)[:, None]
        # the parse before each border runs on until it stops where the parse after the border stops
        border = np.flatnonzero(within > 0)
        lane, lang = (x.ravel() for x in np.meshgrid(border, np.arange(len(root))))
        now = state[lang, lane - 1]
        alone = np.zeros((len(lens), len(root)), bool)
        for t in range(SEGMENT):
            if not len(lane):
                break
            c = coded[begin[lane] + t]
            new = self.table[now * self.classes + c]
            ends, there = new < 0, stops[t][lang, rank[lane]]
            np.add.at(total, (owner[lane], lang), ends.astype(float) - there)
            met = ends & there
            now = np.where(ends, again[lang, c], new)
            over = ~met & (size[lane] == t + 1)
            lost = over & (begin[lane] + t + 1 < off[1:][owner[lane]])
            alone[owner[lane[lost]], lang[lost]] = True
            live = ~(met | over)
            lane, lang, now = lane[live], lang[live], now[live]
        for j in np.flatnonzero(alone.any(axis=0)).tolist():  # segments that never agree
            texts = np.flatnonzero(alone[:, j])
            total[texts, j] = 1 + self._parse(coded, off[texts], lens[texts], root[j : j + 1], again[j : j + 1])[0][0]
        return total

    def _parse(self, coded: np.ndarray, begin: np.ndarray, size: np.ndarray, root: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Spans that each start a phrase, parsed side by side, longest first.

        (phrase ends of each language and span, for each step where phrases end in the order of
        length, the states that are left, each span's place in that order).
        """
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        most = int(size.max(initial=0))
        live = np.searchsorted(-size, -np.arange(most), "left")  # spans longer than t
        state = np.tile(root[:, None], (1, len(begin)))
        count = np.zeros((len(root), len(begin)), np.int32)
        stops = []
        for t in range(most):
            k = live[t]
            c = coded[begin[:k] + t]
            new = self.table[state[:, :k] * self.classes + c]
            stop = new < 0
            count[:, :k] += stop
            state[:, :k] = np.where(stop, again[:, c], new)
            if t < SEGMENT:
                stops.append(stop)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return count[:, rank], stops, state[:, rank], rank

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        chars, at = folded(raw, off)
        has = np.concatenate([[0], np.cumsum(chars != 0)])
        letters = has[at[1:]] - has[at[:-1]]
        if not self.names:
            return ["und"] * len(letters), np.zeros(len(letters))
        cost = self.phrases(chars, at) * np.array(self.bits)
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(best)), best]
        second = np.partition(cost, 1, axis=1)[:, 1] if len(self.names) > 1 else np.full(len(best), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(letters > 0, np.clip(1 - least / second, 0, 1), 0.0)
        return [self.names[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    """Built once per Python worker."""
    return CrossParser(samples)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, sample text), sorted by name, from rows with a language and letters.

    A hash of (id, text) orders the rows. Each language's share of rows that is looked at
    follows its count, so that about ``sample_rows`` come to the sort; of a language with few
    rows all do. The driver gets the languages' counts and the sample.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return ()
    sample_chars = max(1, min(sample_chars, ALL_CHARS // len(sizes)))
    # twice the rows that are wanted, so that chance does not leave a language short
    share = spark.createDataFrame([(r.lang, min(1.0, 2.0 * sample_rows / r["count"])) for r in sizes], "lang string, share double")
    near = rows.join(F.broadcast(share), "lang").where((F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)) | (F.col("share") >= 1))
    near = near.groupBy("lang", "h").agg(F.min("t").alias("t"))  # repeated rows teach once
    fits = F.length("t") <= sample_chars
    order = W.partitionBy("lang").orderBy(F.desc(fits), F.when(~fits, F.length("t")), "h", "t")
    top = near.withColumn("at", F.row_number().over(order)).where((F.col("at") <= sample_rows) & (fits | (F.col("at") == 1)))
    got: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for r in top.orderBy("lang", "at").toLocalIterator():
        if r.lang not in got or len(r.t) <= room[r.lang]:
            got.setdefault(r.lang, []).append(r.t)
            room[r.lang] = room.get(r.lang, sample_chars) - len(r.t)
    return tuple((k, "\n".join(v)) for k, v in sorted(got.items()))


def _predicted(samples: tuple[tuple[str, str], ...], carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(samples)
        for batch in ts.gathered(batches, "t", 2 * ts.BATCH_BYTES):
            names, score = model.predict(*ts.text_bytes(batch.column("t")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*carry, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Columns id, held_out, lang_pred, score."""
    inner = docs.select(F.col(f"`{id_col}`").alias("c0"), (F.lit(False) if held_out is None else held_out).alias("c1"), F.col(f"`{text_col}`").cast("string").alias("t"))
    out = inner.mapInArrow(_predicted(samples, ["c0", "c1"]), f"c0 {inner.schema['c0'].dataType.simpleString()}, c1 boolean, lang_pred string, score double")
    return out.select(F.col("c0").alias(id_col), F.col("c1").alias("held_out"), "lang_pred", "score")
