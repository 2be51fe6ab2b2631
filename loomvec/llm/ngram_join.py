"""Operator 8: n-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a text of one to four words is one shingle). Rows
with the same words (a 128-bit digest of their bytes) are one class. Steps:

1. ``HASHES`` MinHash values per class; ``HASHES / ROWS`` bands of ``ROWS`` values. Classes
   that share a band meet (a pair at similarity 0.8 misses all bands with probability
   under 1e-6).
2. In a band's group, pairs are compared MinHash by MinHash; a pair is dropped once the
   posterior probability of reaching the threshold (uniform prior) is under ``TOLERANCE``.
   Only connectivity is kept: a class is compared with those not yet reached.
3. Connected candidates form groups. Inside a group every pair is pruned the same way and
   the rest is verified exactly: words are numbered by their bytes, shingles by their words.
   Links are counted, not listed.

Groups over ``BLOCK`` classes (``CHECKED`` where texts are compared) are split into pairs of
blocks, so no task holds an unbounded group; nothing emits all pairs.

Result per row: id, class_id (the least id of the connected component of exact links) and
n_links (other rows with similarity >= threshold; copies count each).

Defined results: texts without words (and nulls) link to nothing and are their own class;
rows with a null id take part, null ids come last for class_id; repeated rows are linked
copies; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.llm import textscan as ts
from loomvec.llm.common import Scratch, partitions
from loomvec.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
HASHES, ROWS = 72, 3
TOLERANCE = 1e-6
STEP = 8
BLOCK, CHECKED = 4096, 1024
BLOCK_BYTES = 4_000_000


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seed = ts.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:HASHES] | np.uint64(1), seed[HASHES:]


@lru_cache(maxsize=4)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = 0..HASHES compared values, the fewest equal ones that a pair may have.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1), and
    P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(HASHES + 1):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def shingles(words: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the first of each text."""
    parts, off = _windows(words.hashes, words.first)
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = ts.mix(out + part * np.uint64(0xA24BAED4963EE407))
    return out, off


def _windows(values: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The k-th word's value of every shingle, for each k, and the first shingle of each text; 0 where a text ends."""
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(int(off[-1])) - np.repeat(off[:-1], count) + np.repeat(first[:-1], count)
    end = np.repeat(first[1:], count)
    padded = np.concatenate([values, np.zeros(SHINGLE, values.dtype)])
    return [np.where(at + k < end, padded[at + k], 0).astype(values.dtype) for k in range(SHINGLE)], off


def signatures(shingle: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MinHash values, a row per text; texts without shingles have the largest value."""
    out = np.full((len(off) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        a, b = _multipliers()
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(((shingle * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), off[:-1][full])
    return out


def _digests(words: ts.Words) -> list[bytes | None]:
    raw, off = words.plain()
    data, first = raw.tobytes(), off.tolist()
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ts.gathered(batches, "t", ts.BATCH_BYTES):
        words = ts.Words(*ts.text_bytes(batch.column("t")))
        sig = signatures(*shingles(words))
        rows = [s.tobytes() for s in sig]
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(_digests(words), pa.binary()), pa.array(rows, pa.binary()), pa.array(np.diff(words.first), pa.int32())], ["d", "class", "sig", "size"])


def _digested(carry: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.gathered(batches, text, ts.BATCH_BYTES):
            words = ts.Words(*ts.text_bytes(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(_digests(words), pa.binary())], [*carry, "class"])

    return run


def split_groups(rows: DataFrame, key: str, block: int, weight: str | None = None) -> DataFrame:
    """Deal the rows of each ``key`` to tasks (key, i, j): pairs of blocks of about ``block`` rows.

    With ``weight`` (bytes of a row) a block also holds about ``BLOCK_BYTES`` at most.

    Adds i, j and ``own``, the row's block. A group of one block has the task (key, 0, 0).
    Keys with one row are dropped. ``rows`` has a column ``class`` that is distinct in a group.
    """
    blocks = F.ceil(F.count("*") / block)
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / BLOCK_BYTES))
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"), blocks.alias("__b")).where("__n > 1")
    many = rows.join(counts, key)
    many = many.withColumn("own", F.pmod(F.xxhash64("class"), F.col("__b")).cast("int"))
    tasks = many.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b").cast("int") - 1)))
    return tasks.select("*", F.least("own", "__o").alias("i"), F.greatest("own", "__o").alias("j")).drop("__n", "__b", "__o")


def by_task(rows: DataFrame, key: str) -> DataFrame:
    n = 4 * partitions(rows.sparkSession)
    return rows.repartition(n, key, "i", "j").sortWithinPartitions(key, "i", "j", "class")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole consecutive groups; a batch's last group waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = [held.column(c)[held.num_rows - 1].as_py() for c in (key, "i", "j")]
        head = [held.column(c)[0].as_py() for c in (key, "i", "j")]
        if head == last:
            continue
        cut = group_starts(held, key)[-1]
        yield held.slice(0, cut).combine_chunks()
        held = held.slice(cut).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def group_starts(table: pa.Table, key: str) -> np.ndarray:
    import pyarrow.compute as pc

    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in (key, "i", "j"):
        col = table.column(c).combine_chunks()
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def fixed_rows(col: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(ts.text_bytes(col)[0].tobytes(), dtype).reshape(-1, width)


def probable(one: np.ndarray, many: np.ndarray, floor: tuple[int, ...]) -> np.ndarray:
    """Which rows of ``many`` may reach the threshold with ``one`` (a row, or a row for each)."""
    alive = np.arange(len(many))
    same = np.zeros(len(many), np.int32)
    each = one.ndim == 2
    for a in range(0, HASHES, STEP):
        z = min(a + STEP, HASHES)
        same += ((one[alive, a:z] if each else one[a:z]) == many[alive, a:z]).sum(axis=1, dtype=np.int32)
        stay = same >= floor[z]
        alive, same = alive[stay], same[stay]
        if not len(alive):
            break
    return alive


def reach(sig: np.ndarray, floor: tuple[int, ...]) -> list[tuple[int, int]]:
    """Edges that connect every probable pair's ends: each row is compared with rows not reached yet."""
    left = np.arange(len(sig))
    edges = []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            hit = probable(sig[x], sig[left], floor)
            edges += [(x, int(y)) for y in left[hit]]
            front += left[hit].tolist()
            left = np.delete(left, hit)
    return edges


def _candidate_edges(floor: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "key"):
            sig = fixed_rows(table.column("sig"), np.uint32, HASHES)
            names = table.column("class").combine_chunks()
            start = group_starts(table, "key")
            size = np.diff(np.append(start, table.num_rows))
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            for n in np.unique(size[size <= 8]):  # all small groups of one size at once
                base = start[size == n]
                for x in range(n):
                    for y in range(x + 1, n):
                        hit = probable(sig[base + x], sig[base + y], floor)
                        pairs.append((base[hit] + x, base[hit] + y))
            for a, n in zip(start[size > 8].tolist(), size[size > 8].tolist(), strict=True):
                edges = np.array(reach(sig[a : a + n], floor), np.int64).reshape(-1, 2) + a
                pairs.append((edges[:, 0], edges[:, 1]))
            if pairs:
                a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], ["a", "b"])

    return run


class Forest:
    """Union by least member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, numbered by what their words' bytes are, and their offsets."""
    words = ts.Words(raw, off)
    rep, number = ts.distinct_spans(words.low, words.starts, words.ends)
    parts, at = _windows(number.astype(np.int64) + 1, words.first)
    n = len(rep) + 1
    if not len(parts[0]):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    front, back = (np.unique(parts[k] * n + parts[k + 1], return_inverse=True)[1] for k in (0, 2))
    four = np.unique(front * (int(back.max()) + 1) + back, return_inverse=True)[1]
    shingle = np.unique(four * n + parts[4], return_inverse=True)[1]
    most = int(shingle.max()) + 1
    doc, shingle = np.divmod(np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) * most + shingle), most)
    return shingle, np.searchsorted(doc, np.arange(len(at)))


def _verified(threshold: float, floor: tuple[int, ...]):
    """Per class of a task: rows linked to it and the least class it is connected with here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "comp"):
            sig = fixed_rows(table.column("sig"), np.uint32, HASHES)
            copies, own = table.column("n").to_numpy(), table.column("own").to_numpy()
            crossing = table.column("i").to_numpy() != table.column("j").to_numpy()
            number, at = _sets(*ts.text_bytes(table.column("t")))
            size = np.diff(at)
            links, forest = np.zeros(table.num_rows, np.int64), Forest(table.num_rows)
            flag = np.zeros(int(number.max(initial=0)) + 1, bool)
            start = group_starts(table, "comp")
            last = np.repeat(np.append(start[1:], table.num_rows), np.diff(np.append(start, table.num_rows))).tolist()
            for x in range(table.num_rows):
                later = np.arange(x + 1, last[x])
                if crossing[x]:
                    later = later[own[later] != own[x]]
                later = later[probable(sig[x], sig[later], floor)]
                if not len(later):
                    continue
                flag[number[at[x] : at[x + 1]]] = True
                lens = size[later]
                first = np.cumsum(lens) - lens
                index = np.arange(int(lens.sum())) - np.repeat(first, lens) + np.repeat(at[:-1][later], lens)
                shared = np.add.reduceat(flag[number[index]].astype(np.int64), first)
                flag[number[at[x] : at[x + 1]]] = False
                later = later[shared >= threshold * (size[x] + lens - shared) - 1e-9]
                links[x] += copies[later].sum()
                links[later] += copies[x]
                for y in later.tolist():
                    forest.join(x, y)
            names = table.column("class").combine_chunks()
            roots = [forest.find(x) for x in range(table.num_rows)]
            yield pa.RecordBatch.from_arrays([names, names.take(pa.array(roots, pa.int64())), pa.array(links)], ["class", "root", "links"])

    return run


def _inner(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))


def _linked(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Tables (d, class) of rows, and (class, root, rep, n, links) of classes with words."""
    floor, scratch = least_matches(threshold, TOLERANCE), Scratch(docs.sparkSession)
    rows = _inner(docs, id_col, text_col)
    sketched = scratch.write(rows.mapInArrow(_sketched, "d long, class binary, sig binary, size int"), "sketches")
    classes = sketched.where("class is not null").groupBy("class").agg(F.min("d").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    classes = scratch.write(classes, "classes")
    named = scratch.write(sketched.select("d", "class"), "named")
    scratch.drop("sketches")
    width = 4 * ROWS
    bands = F.array(*[F.xxhash64(F.substring("sig", width * b + 1, width), F.lit(b)) for b in range(HASHES // ROWS)])
    met = split_groups(classes.select(F.explode(bands).alias("key"), "class"), "key", BLOCK)
    met = by_task(met.join(classes.select("class", "sig"), "class").select("key", "i", "j", "class", "sig"), "key")
    edges = met.mapInArrow(_candidate_edges(floor), "a binary, b binary")
    comps = components(edges, scratch, "candidates")
    members = classes.join(comps.select(F.col("node").alias("class"), F.col("root").alias("comp")), "class")
    members = split_groups(members.withColumn("bytes", 8 * F.col("size").cast("long")), "comp", CHECKED, "bytes")
    # the text of each class, from one of its rows: those of the least id, told apart by digest
    reps = members.select("rep", "class").distinct()
    texts = rows.join(reps.select("rep").distinct(), F.col("d").eqNullSafe(F.col("rep")), "left_semi")
    texts = texts.mapInArrow(_digested(["d", "t"], "t"), "d long, t string, class binary").groupBy("class").agg(F.first("t").alias("t"))
    tasks = by_task(members.join(texts, "class").select("comp", "i", "j", "own", "class", "n", "sig", "t"), "comp")
    parts = scratch.write(tasks.mapInArrow(_verified(threshold, floor), "class binary, root binary, links long"), "links")
    scratch.drop("candidates")
    roots = components(parts.select(F.col("class").alias("a"), F.col("root").alias("b")), scratch, "roots")
    links = parts.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("class", "rep", "n").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    known = known.select("class", F.coalesce("root", "class").alias("root"), "rep", "n", F.coalesce("links", F.lit(0)).alias("links"))
    known = scratch.write(known, "joined")
    scratch.drop("classes", "links", "roots")
    return named, known


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, class_id, n_links."""
    rows, classes = _linked(docs, id_col, text_col, threshold)
    ids = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = classes.join(ids, "root").select("class", "class_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    out = rows.join(known, "class", "left")
    return out.select(F.col("d").alias(id_col), F.when(F.col("class").isNull(), F.col("d")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each group of linked rows: that of the least id (then class).

    Rows without words all stay. All columns are kept.
    """
    _, classes = _linked(docs, id_col, text_col, threshold)
    first = F.struct(F.col("rep").isNull(), "rep", "class")
    best = classes.groupBy("root").agg(F.min(first).alias("best")).select(F.col("best.rep").alias("__lv_d"), F.col("best.class").alias("__lv_class"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    kinds = ", ".join(f"{n} {inner.schema[n].dataType.simpleString()}" for n in names)
    told = inner.mapInArrow(_digested(names, names[docs.columns.index(text_col)]), f"{kinds}, class binary")
    d: Column = F.col(names[docs.columns.index(id_col)])
    blank = told.where("class is null")
    stay = told.where("class is not null").join(best, d.cast("long").eqNullSafe(F.col("__lv_d")) & (F.col("class") == F.col("__lv_class")), "left_semi")
    stay = stay.dropDuplicates([names[docs.columns.index(id_col)], "class"])
    out = stay.unionByName(blank)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
