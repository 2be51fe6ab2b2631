"""Counters over a request log: per model, per batch, server totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.operators.cache import hit_rate


def average(total: Column, count: Column) -> Column:
    """Whole part of total / count; 0 without requests."""
    return F.floor(F.coalesce(F.try_divide(total, count), F.lit(0.0))).cast("long")


def per_model(log: DataFrame, model: str = "model", latency: str = "latency_us", tokens: str = "tokens", failed: str = "failed") -> DataFrame:
    """requests, tokens, errors and avg_latency_us of each model."""
    out = log.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"), F.count_if(failed).alias("errors"), F.sum(latency).alias("__latency"))
    return out.withColumn("avg_latency_us", average(F.col("__latency"), F.col("requests"))).drop("__latency")


def per_model_batched(log: DataFrame, model: str = "model", batch: str = "batch", latency: str = "latency_us", failed: str = "failed") -> DataFrame:
    """As ``per_model`` for batches: a batch's latency counts once, a failed batch is one error."""
    batches = log.groupBy(F.col(model).alias("model"), batch).agg(F.count("*").alias("n"), F.max(latency).alias("took"), F.max(failed).alias("failed"))
    out = batches.groupBy("model").agg(F.sum("n").alias("requests"), F.count("*").alias("batches"), F.count_if("failed").alias("errors"), F.sum("took").alias("__took"))
    return out.withColumn("avg_latency_us", average(F.col("__took"), F.col("requests"))).drop("__took")


def stats_line(pooling: Column, normalize: Column, batch_timeout_ms: Column | None = None, max_batch: Column | None = None) -> Column:
    """Fixed value: the line of one model; memory is not tracked and reads 0. Batching is named where it is on."""
    timeout = F.lit(0) if batch_timeout_ms is None else batch_timeout_ms
    batching = F.when(timeout > 0, F.concat(F.lit(" batch="), timeout, F.lit("/"), F.lit(0) if max_batch is None else max_batch)).otherwise("")
    return F.concat(
        F.col("model"), F.lit(": req="), F.col("requests"), F.lit(" avg="), F.col("avg_latency_us"), F.lit("us tok="), F.col("tokens"),
        F.lit(" err="), F.col("errors"), F.lit(" mem=0mb pool="), pooling, F.lit(" norm="), normalize, batching,
    )


def uptime_secs(log: DataFrame, at: str, now: Column | None = None) -> DataFrame:
    """One row: whole seconds from a log's first record to ``now`` (else its last record)."""
    until = F.max(at) if now is None else now
    return log.agg(F.floor((F.unix_micros(until) - F.unix_micros(F.min(at))) / 1_000_000).alias("uptime_secs"))


def server_stats(models: DataFrame, uptime: DataFrame, cached: DataFrame) -> DataFrame:
    """(key, value) rows of the server's totals from ``per_model`` rows with a ``line``, and one-row tables of uptime and cache.

    Active requests are not tracked and read 0.
    """
    total = models.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.count("*").alias("models"), F.concat_ws(" | ", F.array_sort(F.collect_list("line"))).alias("lines"),
    )
    up, cache = (one.select(F.struct("*")).scalar() for one in (uptime, cached))
    pairs = [
        ("uptime_secs", up["uptime_secs"]), ("total_requests", F.col("requests")), ("active_requests", F.lit(0)), ("total_tokens", F.col("tokens")), ("total_errors", F.col("errors")),
        ("models_loaded", F.col("models")), ("per_model", F.col("lines")), ("cache_hits", cache["hits"]), ("cache_misses", cache["misses"]), ("cache_evictions", cache["evictions"]),
    ]
    entry = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])).alias("e")
    return total.select(entry).select("e.key", "e.value")


#: Keys of a model's settings and counters, in their order, and those of the cache.
INFO = ["dim", "max_length", "workers", "requests", "avg_latency_us", "tokens", "errors", "pooling", "normalize", "batching_timeout_ms", "batching_max_batch"]
CACHE_INFO = {"cache_hits": "hits", "cache_misses": "misses", "cache_hit_rate": "hit_rate", "cache_evictions": "evictions", "cache_entries": "entries", "cache_max_bytes": "max_bytes", "cache_memory_bytes": "memory_bytes"}


def model_info(models: DataFrame, counters: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """(model, key, value) rows of each model: its settings, its ``per_model`` counters, and the cache's if there is one.

    ``models``: name, dim, max_length, workers, pooling, normalize, batch_timeout_ms, max_batch. A model
    that served nothing has zeros.
    """
    settings = models.withColumnsRenamed({"name": "model", "batch_timeout_ms": "batching_timeout_ms", "max_batch": "batching_max_batch"})
    rows = settings.join(counters, "model", "left").fillna(0, ["requests", "avg_latency_us", "tokens", "errors"])
    values = {k: F.col(k) for k in INFO}
    if cached is not None:
        rate = hit_rate(F.col("hits"), F.col("hits") + F.col("misses"))
        one = cached.withColumn("hit_rate", rate).select(F.struct("*")).scalar()
        values |= {k: one[v] for k, v in CACHE_INFO.items()}
    entry = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])).alias("e")
    return rows.select("model", entry).select("model", "e.key", "e.value")
