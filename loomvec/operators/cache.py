"""Exact-match result reuse: lookups, hit counts, a byte-budget LRU, sizes."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomvec.operators.embed import text_key

# Bytes that each cache entry costs beside key and value, and cache size limits.
ENTRY_COST = 48
MIN_CACHE, MAX_CACHE, UNKNOWN_RAM_CACHE = 64 * 1024**2, 500 * 1024**2, 100 * 1024**2


def cache_key(model: Column, text: Column) -> Column:
    return F.concat(model, F.lit(":"), text)


def entry_bytes(key: Column, value_bytes: Column) -> Column:
    return F.octet_length(key) + value_bytes + ENTRY_COST


def split_by_cache(df: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``hit``: whether the cache table holds the row's key (strings); digests of keys meet, not texts."""
    key = text_key(*map(F.col, keys)).alias("__key")
    known = cache.select(key).distinct().withColumn("hit", F.lit(True))
    return df.withColumn("__key", key).join(known, "__key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("__key")


def unbounded_hits(log: DataFrame, keys: list[str], command: str) -> DataFrame:
    """Adds ``hit`` for a cache that never evicts: the key was in an earlier command.

    Lookups of one command precede its inserts, so a repeat inside a command is a miss.
    """
    return log.withColumn("hit", F.min(command).over(W.partitionBy(*keys)) < F.col(command))


def hit_rate(hits: Column, total: Column) -> Column:
    """Percentage with one decimal; 0.0% without lookups."""
    return F.format_string("%.1f%%", F.coalesce(F.try_divide(hits * 100, total), F.lit(0.0)).cast("double"))


class ByteLru:
    """Recency list with a byte budget, evicting from the old end before an insert.

    Overwriting a key adjusts the bytes without evicting; an entry over the budget empties
    the cache and is stored anyway.
    """

    def __init__(self, budget: int) -> None:
        self.budget, self.used, self.evictions = budget, 0, 0
        self.entries: OrderedDict[str, int] = OrderedDict()

    def get(self, key: str) -> bool:
        if key in self.entries:
            self.entries.move_to_end(key)
            return True
        return False

    def put(self, key: str, value_bytes: int) -> None:
        cost = len(key.encode()) + value_bytes + ENTRY_COST
        if key in self.entries:
            self.used += cost - self.entries[key]
            self.entries[key] = cost
            self.entries.move_to_end(key)
            return
        while self.entries and self.used + cost > self.budget:
            self.used -= self.entries.popitem(last=False)[1]
            self.evictions += 1
        self.entries[key] = cost
        self.used += cost


def simulate_lru(log: DataFrame, shard: str, seq: str, key: str, value_bytes: str, budget: int) -> DataFrame:
    """Adds ``hit``, and ``evictions``, ``entries`` and ``used`` bytes after each row; one cache per shard, rows in ``seq`` order.

    The log streams through each task in sorted batches; memory is bounded by the budget.
    """
    cols = log.select(shard, seq, key, value_bytes)
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, lru = None, ByteLru(budget)
        for batch in batches:
            hits, after = [], []
            for s, k, v in zip(batch[shard], batch[key], batch[value_bytes], strict=True):
                if s != now:
                    now, lru = s, ByteLru(budget)
                hits.append(lru.get(k))
                if not hits[-1]:
                    lru.put(k, int(v))
                after.append((lru.evictions, len(lru.entries), lru.used))
            yield batch.assign(hit=hits, evictions=[a[0] for a in after], entries=[a[1] for a in after], used=[a[2] for a in after])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema)
    return cols.repartition(n, shard).sortWithinPartitions(shard, seq).mapInPandas(run, f"{kinds}, hit boolean, evictions long, entries long, used long")


def cache_totals(log: DataFrame, key: str, seq: str, value_bytes: Column, budget: int) -> DataFrame:
    """One row of a server's cache after a log: hits, misses, evictions, entries, max_bytes, memory_bytes.

    While all keys together fit the budget nothing is ever evicted, and sums over the keys
    say it all. Else the log streams through the simulator, in one task by its nature.
    """
    rows = log.select(F.col(key).alias("key"), F.col(seq).alias("seq"), value_bytes.cast("long").alias("bytes"))
    seen = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    sums = seen.agg(F.sum("n").alias("n"), F.count("*").alias("entries"), F.sum(entry_bytes(F.col("key"), F.col("bytes"))).alias("used"))
    limit = F.lit(budget).cast("long").alias("max_bytes")
    if (sums.first().used or 0) <= budget:
        zero = F.lit(0).cast("long")
        return sums.select(F.coalesce(F.col("n") - F.col("entries"), zero).alias("hits"), F.col("entries").alias("misses"), zero.alias("evictions"), "entries", limit, F.coalesce("used", zero).alias("memory_bytes"))
    ran = simulate_lru(rows.withColumn("cache", F.lit(0)), "cache", "seq", "key", "bytes", budget)
    last = F.max_by(F.struct("evictions", "entries", "used"), "seq")
    ended = ran.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), last.alias("last"))
    return ended.select("hits", "misses", "last.evictions", "last.entries", limit, F.col("last.used").alias("memory_bytes"))


# Decimal units of a human-readable size.
UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15}


def parse_size(size: Column, auto: Column) -> Column:
    """Bytes of ``512MB``, ``64KiB`` and the like, all in decimal units; empty is 0 (off), ``auto`` is ``auto``, anything else null."""
    s = F.lower(F.trim(size))
    pattern = r"^([0-9]+(?:\.[0-9]+)?) ?(?:([kmgtp])(?:ib|b)?|b)?$"
    unit = F.regexp_extract(s, pattern, 2)
    factor = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    number = F.regexp_extract(s, pattern, 1).try_cast("double")
    parsed = (number * F.try_element_at(factor, unit)).cast("long")
    return F.when(s == "", F.lit(0).cast("long")).when(s == "auto", auto.cast("long")).otherwise(F.when(parsed > 0, parsed))


def autotune_cache(memory: Column) -> Column:
    """A fifth of what a tenth for safety and a quarter for models leave, within limits."""
    rest = memory - F.floor(memory / 10) - F.floor(memory / 4)
    budget = F.floor(rest * F.lit(0.2))
    sized = F.least(F.greatest(budget, F.lit(MIN_CACHE)), F.lit(MAX_CACHE)).cast("long")
    return F.when(F.coalesce(memory, F.lit(0)) == 0, F.lit(UNKNOWN_RAM_CACHE).cast("long")).otherwise(sized)


def autotune_workers(memory: Column, model_bytes: Column, cores: Column) -> Column:
    """Sessions that half of the memory holds (a fifth over the model's size each), at least 1, at most the cores."""
    each = model_bytes + F.floor(model_bytes / 5)
    by_memory = F.greatest(F.floor(F.try_divide(F.floor(memory / 2), each)), F.lit(1))
    known = (F.coalesce(memory, F.lit(0)) > 0) & model_bytes.isNotNull()
    return F.when(known, F.least(by_memory, cores)).otherwise(cores).cast("long")
