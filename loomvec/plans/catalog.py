"""Model catalog: settings that follow from a model's files where they are not configured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Settings where neither configuration nor files say anything.
DEFAULTS = {"max_length": 512, "output_tensor": "last_hidden_state", "pooling": "mean", "normalize": False, "max_batch": 32}


def pooling_for_rank(rank: Column) -> Column:
    return F.when(rank == 2, "none").otherwise("mean")


def max_length_of(config_json: Column) -> Column:
    """``max_position_embeddings`` of a model's JSON, if it is a positive number."""
    value = F.get_json_object(config_json, "$.max_position_embeddings").try_cast("long")
    return F.when(value > 0, value)


def select_output(outputs: DataFrame) -> DataFrame:
    """(model, name, rank, dim) of each model's output: rank 2, then rank 3, then any; then the least name."""
    first = W.partitionBy("model").orderBy(F.when(F.col("rank") == 2, 0).when(F.col("rank") == 3, 1).otherwise(2), "name")
    return outputs.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")


def resolve(configs: DataFrame, outputs: DataFrame, strict: bool = False) -> DataFrame:
    """One row per model: configured settings, else those of its files, else the defaults.

    ``configs``: name, max_length, dim, output_tensor, pooling, normalize, batch_timeout_ms,
    max_batch, config_json; nulls and non-positive numbers are unset. A configured output
    that the file lacks is replaced by the chosen one, or is an error if ``strict``.
    """
    auto = select_output(outputs).select(F.col("model").alias("name"), F.col("name").alias("auto_name"), F.col("rank").alias("auto_rank"), F.col("dim").alias("auto_dim"))
    named = outputs.select(F.col("model").alias("name"), F.col("name").alias("output_tensor"), F.col("rank").alias("own_rank"), F.col("dim").alias("own_dim"))
    out = configs.join(F.broadcast(auto), "name", "left").join(F.broadcast(named), ["name", "output_tensor"], "left")
    own = F.col("own_rank").isNotNull()
    chosen = F.coalesce("auto_name", F.lit(DEFAULTS["output_tensor"]))
    if strict:
        chosen = F.when(F.col("output_tensor").isNull(), chosen).otherwise(F.raise_error(F.concat(F.lit("no output "), "output_tensor")))
    rank = F.when(own, F.col("own_rank")).otherwise(F.col("auto_rank"))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    pooling = F.coalesce(F.col("pooling"), F.when(rank.isNotNull(), pooling_for_rank(rank)), F.lit(DEFAULTS["pooling"]))
    fits = rank.isNull() | (pooling == pooling_for_rank(rank))
    return out.select(
        "name",
        F.coalesce(positive("max_length"), max_length_of(F.col("config_json")), F.lit(DEFAULTS["max_length"])).cast("long").alias("max_length"),
        F.coalesce(positive("dim"), F.when(own, F.col("own_dim")).otherwise(F.col("auto_dim")), F.lit(0)).cast("long").alias("dim"),
        F.when(own, F.col("output_tensor")).otherwise(chosen).alias("output_tensor"),
        F.when(fits, pooling).otherwise(F.raise_error(F.lit("pooling does not fit the output's rank"))).alias("pooling") if strict else pooling.alias("pooling"),
        F.coalesce("normalize", F.lit(DEFAULTS["normalize"])).alias("normalize"),
        F.when(F.col("batch_timeout_ms") < 0, 1).otherwise(F.coalesce("batch_timeout_ms", F.lit(0))).cast("long").alias("batch_timeout_ms"),
        F.coalesce(positive("max_batch"), F.lit(DEFAULTS["max_batch"])).cast("long").alias("max_batch"),
    )


def upsert(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog with rows added, or put in place of those of the same name; one row of each name in ``changes``."""
    return catalog.join(F.broadcast(changes.select("name")), "name", "left_anti").unionByName(changes)


def with_status(catalog: DataFrame, log: DataFrame, model: str = "model") -> DataFrame:
    """Adds ``status``: ready once a request has loaded the model, else registered."""
    used = log.select(F.col(model).alias("name")).distinct().withColumn("status", F.lit("ready"))
    return catalog.join(used, "name", "left").withColumn("status", F.coalesce("status", F.lit("registered")))


def loaded_counts(catalog: DataFrame) -> DataFrame:
    """One row: models in all and loaded ones, of a catalog with a status."""
    return catalog.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ready").alias("loaded"))
