"""Count-or-timeout micro-batches over an event log, and round-robin dispatch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class Window:
    """A window that its first arrival opens; it closes at ``max_batch`` arrivals or ``timeout_us``.

    Later arrivals do not extend it; an arrival exactly at the timeout opens a new one.
    """

    def __init__(self, timeout_us: int, max_batch: int) -> None:
        self.timeout, self.most = timeout_us, max(1, max_batch)
        self.number, self.start, self.count = 0, None, 0

    def add(self, at: int) -> tuple[int, int]:
        """(window number, place in it) of an arrival."""
        if self.start is None or self.count >= self.most or at - self.start >= self.timeout:
            self.number, self.start, self.count = self.number + 1, at, 0
        self.count += 1
        return self.number, self.count


def microbatch_windows(log: DataFrame, key: str, seq: str, at_us: str, timeout_us: int, max_batch: int) -> DataFrame:
    """Adds ``window`` and ``place`` per row; windows of each key follow ``at_us``, then ``seq``.

    Rows stream through each task in sorted order; a window's state is two numbers.
    """
    cols = log.select(key, seq, at_us)
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = None, Window(timeout_us, max_batch)
        for batch in batches:
            found = []
            for k, at in zip(batch[key], batch[at_us], strict=True):
                if k != now:
                    now, window = k, Window(timeout_us, max_batch)
                found.append(window.add(int(at)))
            yield batch.assign(window=[f[0] for f in found], place=[f[1] for f in found])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema)
    return cols.repartition(n, key).sortWithinPartitions(key, at_us, seq).mapInPandas(run, f"{kinds}, window long, place long")


def cuts_below(col: Column, cuts: list) -> Column:
    """How many of some distinct, sorted values are smaller than a column's; a few comparisons per row. 0 for null."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(col > F.lit(cuts[middle]), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(cuts))


def numbered(df: DataFrame, key: str, seq: str, out: str = "number", slices: int = 64) -> DataFrame:
    """Adds the place from 0 of each row among its key's, in the order of ``seq`` (a number without ties within a key).

    Rows are sorted within (key, slice), where slices lie between quantiles of ``seq``; the counts
    of a key's earlier slices are added. So a key with a third of all rows is spread over the
    slices, and only one row per key and slice meets in one place.
    """
    cuts = df.agg(F.percentile_approx(seq, [k / slices for k in range(1, slices)], 100 * slices).alias("cuts")).first().cuts or []
    rows = df.withColumn("__slice", cuts_below(F.col(seq), sorted(set(cuts))))
    here = F.row_number().over(W.partitionBy(key, "__slice").orderBy(seq)) - 1
    earlier = W.partitionBy("__key").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(F.col(key).alias("__key"), "__slice").agg(F.count("*").alias("__n"))
    before = before.select("__key", F.col("__slice").alias("__of"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    met = rows.withColumn("__here", here).join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__of")))
    return met.withColumn(out, F.col("__before") + F.col("__here")).drop("__slice", "__here", "__key", "__of", "__before")


def execution(settings: DataFrame) -> DataFrame:
    """Adds ``mode`` and ``sessions``: a model with a batch timeout has one batcher with one session, any other ``workers`` with one each.

    ``settings``: batch_timeout_ms, workers (null or non-positive: one).
    """
    batched = F.coalesce(F.col("batch_timeout_ms") > 0, F.lit(False))
    each = F.greatest(F.coalesce("workers", F.lit(1)), F.lit(1))
    return settings.withColumns({"mode": F.when(batched, "batcher").otherwise("workers"), "sessions": F.when(batched, 1).otherwise(each).cast("long")})


def round_robin(log: DataFrame, key: str, seq: str, workers: int) -> DataFrame:
    """Adds ``worker``: requests of each key in turn, in ``seq`` order."""
    out = numbered(log, key, seq, "__turn")
    return out.withColumn("worker", F.pmod("__turn", F.lit(workers)).cast("int")).drop("__turn")
