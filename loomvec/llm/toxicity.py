"""Operator 9: toxicity by gradient-boosted trees over dense features, isotonically calibrated.

Features of a whole text: lexicon densities (words, word beginnings, and words read with
digits and symbols as letters), the share of lexicon words near a second-person pronoun,
capitals, punctuation and obfuscation rates. The lexicon (hashes of words and of word
beginnings that mark toxic texts), the trees and the calibration are learned from labelled
rows.

Training takes at most ``MAX_ROWS`` labelled ids, those with the smallest hash; this bound is
a parameter. Their texts are written once to the shared folder. Statistics of the lexicon are gathered by Spark; the driver
receives the lexicon (at most ``LEXICON`` hashes) and one feature row per training text.

Defined results: null text is empty; an empty text is scored from its features; a text
with several labels counts as toxic if one says so; null labels, and labels without a text,
teach nothing; without labels of both kinds the score is the share of toxic labels (0 if
there are none); repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.llm import textscan as ts
from loomvec.llm.common import Scratch

MAX_ROWS = 20_000
LEXICON = 2_000
MIN_TEXTS = 5
MIN_ODDS = 2.0
BEGINNINGS = (4, 5)
NEAR = 6
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
FEATURES = 15

SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos usted ustedes vosotros tus ti contigo".split()


def _symbols_as_letters() -> bytes:
    """The word map, but with look-alike digits and symbols read as letters."""
    out = bytearray(ts.WORD_MAP)
    for a, b in zip("013457@$!*", "oieastasi*", strict=True):
        out[ord(a)] = ord(b)
    return bytes(out)


LOOK_ALIKE = _symbols_as_letters()


def hashes_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return ts.Words(raw, np.array([0, len(raw)])).hashes


def keyed(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of whole words (kind 0) or of beginnings of ``kind`` bytes, kept apart."""
    return ts.mix(hashes + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64)))


def beginnings(words: ts.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, key) of words longer than n bytes."""
    at = np.flatnonzero(words.ends - words.starts > n)
    return at, keyed(ts.span_hashes(words.low, words.starts[at], words.starts[at] + n), n)


class Lexicon:
    """Sorted keys and the log odds of each."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], odds[order]

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Log odds of each key; 0 where it is not listed."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.odds[at], 0.0)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def features(raw: np.ndarray, off: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of dense features for each text."""
    words = ts.Words(raw, off)
    odds = lexicon.look(keyed(words.hashes, 0))
    starts_odds = np.zeros(len(odds))
    for n in BEGINNINGS:
        at, keys = beginnings(words, n)
        starts_odds[at] = np.maximum(starts_odds[at], lexicon.look(keys))
    masked = ts.Words(raw, off, LOOK_ALIKE)
    masked_odds = lexicon.look(keyed(masked.hashes, 0))
    hit = (odds > 0) | (starts_odds > 0)
    you = np.isin(words.hashes, hashes_of(SECOND_PERSON))
    number = np.cumsum(you)  # pronouns up to each word; windows stay inside a text
    index = np.arange(len(hit))
    doc = np.searchsorted(words.first, index, "right") - 1
    low, high = np.maximum(index - NEAR, words.first[doc]), np.minimum(index + NEAR, words.first[doc + 1] - 1)
    near = hit & (number[high] - number[low] + you[low] > 0) if len(hit) else hit
    n_words = np.maximum(np.diff(words.first), 1)
    hits = _per_text(hit, words.first)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        return _per_text(mask, off)

    size = np.maximum(np.diff(off), 1)
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    letter = upper | lower | (raw >= 128)
    mark = (raw > 32) & ~letter & ~((raw >= 48) & (raw <= 57)) & (raw < 127)
    odd = np.isin(raw, np.frombuffer(b"0134579@$*!#%&_", np.uint8))
    inside = np.zeros(len(raw), bool)
    same = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inside[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
        same[2:] = letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
        first, end = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0]
        inside[first] = inside[end - 1] = same[first] = False  # neighbours are of the same text
        same[np.minimum(first + 1, end - 1)] = False
    letters = np.maximum(bytes_in(letter), 1)
    return np.stack(
        [
            hits / n_words,
            np.log1p(hits),
            _per_text(odds, words.first) / n_words,
            _per_text(starts_odds, words.first) / n_words,
            np.log1p(_per_text(starts_odds > 0, words.first)),
            np.maximum(_per_text(masked_odds > 0, masked.first) - _per_text(odds > 0, words.first), 0),
            _per_text(near, words.first) / np.maximum(hits, 1),
            _per_text(you, words.first) / n_words,
            bytes_in(upper) / letters,
            bytes_in(raw == ord("!")) / size,
            bytes_in(raw == ord("?")) / size,
            bytes_in(mark) / size,
            bytes_in(inside) / letters,
            bytes_in(same) / letters,
            np.log1p(n_words),
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on binned features, with calibration steps."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))  # a row per tree, heap order
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    steps_x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps_y: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(b), self.base), np.arange(len(b))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.margin(self.binned(x)), self.steps_x, self.steps_y), 0, 1)


def _tree(b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, cuts, leaf values, each row's leaf) of one tree fitted to gradients."""
    inner = 2**DEPTH - 1
    feature, cut, node = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(len(b), np.int64)
    for n in range(inner):
        mine = np.flatnonzero(node == n)
        best = 1e-6
        g_all, h_all = grad[mine].sum(), hess[mine].sum()
        for j in range(b.shape[1]):
            g = np.cumsum(np.bincount(b[mine, j], grad[mine], BINS + 1))[:-1]
            h = np.cumsum(np.bincount(b[mine, j], hess[mine], BINS + 1))[:-1]
            ok = (h > 1) & (h_all - h > 1)
            gain = np.where(ok, g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1), 0)
            if gain.max(initial=0) > best:
                best, feature[n], cut[n] = gain.max(), j, int(gain.argmax())
        node[mine] = 2 * n + 1 + (b[mine, feature[n]] > cut[n])
    at = node - inner
    g, h = np.bincount(at, grad, 2**DEPTH), np.bincount(at, hess, 2**DEPTH)
    return feature, cut, RATE * g / (h + 1), at


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit (pool adjacent violators)."""
    at, which = np.unique(x, return_inverse=True)  # equal values are one knot, whatever their labels
    pools: list[list[float]] = []  # sum, count, first x, last x
    for a, total, n in zip(at.tolist(), np.bincount(which, y).tolist(), np.bincount(which).tolist(), strict=True):
        pools.append([total, n, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    knots = [(at, s / n) for s, n, first, last in pools for at in ((first, last) if last > first else (first,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees:
    """Trees from the rows not held, calibration from the held ones."""
    if len(y) == 0 or y.min() == y.max():
        return Trees(constant=float(y.mean()) if len(y) else 0.0)
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        held = np.zeros(len(y), bool)  # too few rows to hold some back
    model, tx, ty = Trees(), x[~held], y[~held]
    model.edges = [np.unique(np.quantile(tx[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.binned(tx)
    model.base = float(np.log(ty.mean() / (1 - ty.mean())))
    margin, trees = np.full(len(ty), model.base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        f, c, leaf, at = _tree(b, ty - p, p * (1 - p))
        margin += leaf[at]
        trees.append((f, c, leaf))
    model.feature, model.cut, model.leaf = (np.stack([t[k] for t in trees]) for k in range(3))
    cx, cy = (x[held], y[held]) if held.any() else (tx, ty)
    model.steps_x, model.steps_y = isotonic(model.margin(model.binned(cx)), cy.astype(float))
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic texts, other texts), summed per batch."""
    for batch in ts.gathered(batches, "t", ts.BATCH_BYTES):
        toxic = batch.column("y").to_numpy(zero_copy_only=False)
        words = ts.Words(*ts.text_bytes(batch.column("t")))
        doc = np.searchsorted(words.first, np.arange(len(words.hashes)), "right") - 1
        keys, docs = [keyed(words.hashes, 0)], [doc]
        for n in BEGINNINGS:
            at, own = beginnings(words, n)
            keys.append(own)
            docs.append(doc[at])
        pair = np.unique(np.rec.fromarrays([np.concatenate(keys), np.concatenate(docs)], names="k,d"))
        found, which = np.unique(pair["k"], return_inverse=True)
        bad = np.bincount(which, toxic[pair["d"]], len(found)).astype(np.int64) if len(found) else np.zeros(0, np.int64)
        seen = np.bincount(which, minlength=len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(bad), pa.array(seen - bad)], ["k", "bad", "good"])


def training_rows(docs: DataFrame, labels: DataFrame, learn_from: Column | None, id_col: str, text_col: str, label_id: str, label_col: str, max_rows: int) -> DataFrame:
    """(d, t, y) of at most ``max_rows`` labelled documents, by the smallest hash of the id."""
    known = labels.where(F.lit(True) if learn_from is None else learn_from)
    known = known.select(F.col(f"`{label_id}`").alias("d"), F.col(f"`{label_col}`").alias("y")).where("d is not null and y is not null")
    known = known.groupBy("d").agg(F.max((F.col("y") > 0).cast("int")).alias("y")).orderBy(F.xxhash64("d"), "d").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("d"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    return texts.join(F.broadcast(known), "d")  # at most max_rows pairs of numbers


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[Lexicon, Trees]:
    """Lexicon and calibrated trees. ``learn_from``: condition on the labels' columns."""
    scratch = Scratch(docs.sparkSession)  # the documents are scanned once, the bounded sample several times
    rows = scratch.write(training_rows(docs, labels, learn_from, id_col, text_col, label_id, label_col, max_rows), "toxicity-sample")
    size = rows.groupBy("y").count().collect()
    n = {r.y: r["count"] for r in size}
    bad, good = n.get(1, 0), n.get(0, 0)
    # half of the rows choose the lexicon, so that the trees learn how far to trust it
    half = F.pmod(F.xxhash64("d", F.lit(7)), F.lit(2)) == 0
    counts = rows.where(half).mapInArrow(_counted, "k long, bad long, good long").groupBy("k").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad / 2 + 1)) - F.log((F.col("good") + 0.5) / (good / 2 + 1))
    marked = counts.where(F.col("bad") >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    top = marked.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "k").limit(LEXICON).toPandas()
    lexicon = Lexicon(top["k"].to_numpy(np.int64).view(np.uint64), top["odds"].to_numpy(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.gathered(batches, "t", ts.BATCH_BYTES):
            x = features(*ts.text_bytes(batch.column("t")), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["d", "y", "x"])

    table = rows.where(~half if bad + good > 200 else F.lit(True)).mapInArrow(run, f"d {rows.schema['d'].dataType.simpleString()}, y int, x array<double>").withColumn("held", F.pmod(F.xxhash64("d", F.lit(11)), F.lit(4)) == 0)
    got = table.orderBy("d", "y", "x").toPandas()
    scratch.drop("toxicity-sample")
    x = np.array(got["x"].tolist(), float).reshape(len(got), FEATURES)
    return lexicon, fit(x, got["y"].to_numpy(int), got["held"].to_numpy(bool))


def _scored(lexicon: Lexicon, trees: Trees, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.gathered(batches, "t", ts.BATCH_BYTES):
            score = trees.score(features(*ts.text_bytes(batch.column("t")), lexicon))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(score, pa.float64())], [*carry, "score"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, trees: Trees, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, score_name: str = "score") -> DataFrame:
    """Columns id, ``keep`` (and the text), and the score under ``score_name``."""
    kept = [id_col, *keep]
    carry = [f"c{i}" for i in range(len(kept))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, carry, strict=True)], F.col(f"`{text_col}`").cast("string").alias("t"))
    carry = carry + ["t"] * with_text
    kinds = ", ".join(f"{n} {inner.schema[n].dataType.simpleString()}" for n in carry)
    out = inner.mapInArrow(_scored(lexicon, trees, carry), f"{kinds}, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, carry, strict=False)], *[F.col("t").alias(text_col)] * with_text, F.col("score").alias(score_name))
