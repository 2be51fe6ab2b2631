"""Operator 1: exact top-k by inner product, columnar branch and bound.

Vectors lie dimension by dimension (one row of the array per dimension). For a query, the
scores of a block of candidates are accumulated over blocks of dimensions; after each
block a candidate survives only if its score so far plus the largest value the remaining
dimensions can add (the product of the remaining norms) reaches the query's k-th best.
Survivors are compacted before the next block.

Queries and candidates meet in a grid of tasks: a task holds the queries of one group (about
``query_group`` of them) and reads the candidates of one stripe (about ``stripe`` of them)
past them; it keeps k+1 rows per query. A query goes to each stripe's task and a candidate
to each group's, so the plan has the same few scans however many queries there are, no task
grows with the table, and the driver gets two counts.

Defined results: a vector that is null or holds a null or non-finite component takes no
part; vectors of different lengths do not meet; an empty vector scores 0; a query never
finds its own row, but does find other rows that repeat its id; repeated query rows give
repeated results; rows with a null id take no part; a score beyond 64 bits is held at the
largest or smallest long; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomvec.llm.common import partitions

SCALE = 1024
DIMS = 8
QUERY_GROUP = 8192
STRIPE = 200_000
CANDIDATES = 4096
_LONG = 2**63


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    out = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return out.where(F.col("id").isNotNull() & v.isNotNull() & sound)


def by_length(col: pa.ListArray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(SCALE * x) as doubles with a row per vector) for each vector length."""
    lens = np.diff(col.offsets.to_numpy())
    flat = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False))
    first = np.cumsum(lens) - lens
    for n in np.unique(lens):
        rows = np.flatnonzero(lens == n)
        yield ids[rows], flat[(first[rows][:, None] + np.arange(n)).astype(np.int64)]


def _clamped(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Exact inner products of one vector with the columns of b, in Python integers."""
    q = [int(x) for x in a]
    return [max(-_LONG, min(_LONG - 1, sum(x * int(y) for x, y in zip(q, col, strict=True)))) for col in b.T]


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def floor(self, q: int) -> int:
        return int(self.score[q][-1]) if len(self.score[q]) == self.k else -_LONG

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        order = np.lexsort((ids, ~score))[: self.k]  # ~score: descending without overflow
        self.score[q], self.id[q] = score[order], ids[order]


def scan(queries: np.ndarray, where: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
    """Offer the candidate rows to each query (row of ``queries``, number ``where``)."""
    dims = rows.shape[1]
    columns = np.ascontiguousarray(rows.T)
    bound = (np.abs(rows).max(initial=0) + 1) * (np.abs(queries).max(initial=0) + 1) * max(dims, 1)
    if bound >= 2.0**52:  # sums of doubles would not be exact
        for q, w in zip(queries, where, strict=True):
            best.add(w, np.array(_clamped(q, columns), np.int64).reshape(-1), ids)
        return
    cuts = list(range(0, dims, DIMS)) + [dims]
    square = np.vstack([np.cumsum((columns**2)[::-1], axis=0)[::-1], np.zeros((1, len(ids)))])
    left = np.sqrt(square[cuts])  # norm of the dimensions from each cut on
    q_square = np.hstack([np.cumsum((queries**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1))])
    q_left = np.sqrt(q_square[:, cuts])
    for q, w, mass in zip(queries, where, q_left, strict=True):
        least = best.floor(w)
        alive = np.flatnonzero(mass[0] * left[0] + 1 >= least)
        score = np.zeros(len(alive))
        for b in range(len(cuts) - 1):
            a, z = cuts[b], cuts[b + 1]
            score = score + q[a:z] @ columns[a:z, alive]
            stay = score + mass[b + 1] * left[b + 1][alive] * (1 + 1e-9) + 1e-6 >= least
            alive, score = alive[stay], score[stay]
            if not len(alive):
                break
        if len(alive):
            if len(alive) > best.k:  # ties at the k-th score all stay for the id to decide
                edge = np.partition(score, len(score) - best.k)[len(score) - best.k]
                alive, score = alive[score >= edge], score[score >= edge]
            best.add(w, score.astype(np.int64), ids[alive])


def _searched(k: int):
    """The best rows of a task's queries, which come first, among its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[np.ndarray] = []
        names: list[np.ndarray] = []
        own: list[int] = []
        found: dict[int, list[np.ndarray]] = {}
        seats: dict[int, list[np.ndarray]] = {}
        queries: dict[int, tuple[np.ndarray, np.ndarray]] | None = None
        best = Best(0, k)
        for batch in batches:
            number = batch.column("q")
            for part in (batch.filter(number.is_valid()), batch.filter(number.is_null())):
                if not part.num_rows:
                    continue
                ids = part.column("id").to_numpy(zero_copy_only=False)
                if part.column("q").null_count == 0:
                    place = np.arange(part.num_rows) + sum(map(len, names))
                    numbers.append(part.column("q").to_numpy(zero_copy_only=False))
                    names.append(ids)
                    own += [0] * part.num_rows
                    for seat, rows in by_length(part.column("v"), place):
                        found.setdefault(rows.shape[1], []).append(rows)
                        seats.setdefault(rows.shape[1], []).append(seat)
                        for w, r in zip(seat.tolist(), rows, strict=True):
                            own[w] = _clamped(r, r[:, None])[0]
                    continue
                if queries is None:
                    queries = {n: (np.concatenate(found[n]), np.concatenate(seats[n])) for n in found}
                    best = Best(len(own), k)
                for mine, rows in by_length(part.column("v"), ids):
                    if rows.shape[1] in queries:
                        for a in range(0, len(mine), CANDIDATES):
                            scan(*queries[rows.shape[1]], mine[a : a + CANDIDATES], rows[a : a + CANDIDATES], best)
        counts = np.array([len(s) for s in best.score], np.int64)
        if not counts.sum():
            return
        cols = [np.repeat(np.concatenate(numbers), counts), np.repeat(np.concatenate(names), counts), np.repeat(np.array(own, np.int64), counts), np.concatenate(best.id), np.concatenate(best.score)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q", "query_id", "own", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, query_rows: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", query_group: int = QUERY_GROUP, stripe: int = STRIPE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row where ``query_rows`` holds."""
    rows = whole_vectors(vectors, id_col, vec_col)
    asked = whole_vectors(vectors.where(query_rows), id_col, vec_col)
    n_groups = asked.count() // query_group + 1
    n_stripes = max(partitions(vectors.sparkSession), vectors.count() // stripe + 1)
    # rows are numbered, so that copies of one row are queries of their own and do not crowd into one stripe
    number = F.monotonically_increasing_id()
    asked = asked.withColumn("q", number).withColumn("group", F.pmod(F.xxhash64("q"), F.lit(n_groups)).cast("int"))
    asked = asked.select("id", "v", "q", "group", F.explode(F.sequence(F.lit(0), F.lit(n_stripes - 1))).alias("stripe"))
    rows = rows.withColumn("stripe", F.pmod(F.xxhash64(number), F.lit(n_stripes)).cast("int"))
    rows = rows.select("id", "v", F.lit(None).cast("long").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"), "stripe")
    cell = (F.col("group") * n_stripes + F.col("stripe")).cast("int")
    dealt = asked.unionByName(rows).repartitionById(n_groups * n_stripes, cell).sortWithinPartitions(F.col("q").isNull())
    found = dealt.select("id", "v", "q").mapInArrow(_searched(k + 1), "q long, query_id long, own long, vec_id long, score long")
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    # the query's own row is one of those with its id and its self-score; one of them goes
    self_row = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    best = best.withColumn("self_at", F.min(F.when(self_row, F.col("at"))).over(W.partitionBy("q")))
    best = best.where("self_at is null or at != self_at").withColumn("rank", F.col("at") - F.when(F.col("self_at") < F.col("at"), 1).otherwise(0))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
