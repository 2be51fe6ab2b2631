"""Embedding projections over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomvec.functions.models import Model, embed_texts


def embedding(model: Model):
    """A column function: text to float vector; null text is an empty text."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embed_texts(model, texts.tolist())))

    return run


def embed(df: DataFrame, model: Model, text: str = "text", out: str = "embedding") -> DataFrame:
    """``df`` with one vector per text."""
    return df.withColumn(out, embedding(model)(F.col(text)))


def text_key(*parts: Column) -> Column:
    """32 bytes that stand for some strings in joins and groupings, so that no text is shuffled as a key; null is not empty."""
    marked = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*marked), 256))


def dedup_then_embed(df: DataFrame, model: Model, text: str = "text", out: str = "embedding") -> DataFrame:
    """As ``embed``, but each distinct text is encoded once; worth its shuffle for costly models.

    Repeated texts meet by a digest, after each task has kept one of each.
    """
    keyed = df.withColumn("__key", text_key(F.col(text)))
    known = embed(keyed.groupBy("__key").agg(F.first(text).alias("__text")), model, "__text", out).drop("__text")
    return keyed.join(known, "__key", "left").drop("__key")


def embed_wanted(model: Model):
    """A column function of (text, wanted): the vector where it is wanted, else null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            result = np.full(len(texts), None, object)
            rows = np.flatnonzero(wanted.to_numpy(bool))
            if len(rows):
                result[rows] = list(embed_texts(model, texts.iloc[rows].tolist()))
            yield pd.Series(result)

    return run


def embed_cached(df: DataFrame, cached: DataFrame, model: Model, text: str = "text", out: str = "embedding") -> DataFrame:
    """``df`` with a vector per text and ``hit``: vectors of the cache table (model, text, embedding) are used again.

    The misses of a batch are encoded together and fill the places that the hits leave; the
    cache's value counts even where the model would give another.
    """
    mine = cached.where(F.col("model") == model.name).groupBy(text_key(F.col("text")).alias("__key")).agg(F.first("embedding").alias("__old"))
    merged = df.withColumn("__key", text_key(F.col(text))).join(mine, "__key", "left")
    merged = merged.withColumn("hit", F.col("__old").isNotNull())
    return merged.withColumn(out, F.coalesce("__old", embed_wanted(model)(F.col(text), ~F.col("hit")))).drop("__key", "__old")


def misses_for_cache(df: DataFrame, model: Model, text: str = "text", out: str = "embedding") -> DataFrame:
    """The rows that a run of ``embed_cached`` adds to its cache table, one for each text."""
    fresh = df.where(~F.col("hit")).groupBy(text_key(F.col(text)).alias("__key")).agg(F.first(text).alias("text"), F.first(out).alias("embedding"))
    return fresh.select(F.lit(model.name).alias("model"), "text", "embedding")


def not_found(model: Column) -> Column:
    """Fixed value: the error of a name that the catalog lacks."""
    return F.concat(F.lit("ERR model '"), F.coalesce(model, F.lit("")), F.lit("' not found"))


def embed_commands(df: DataFrame, models: list[Model], command: str, position: str, model: str = "model", text: str = "text", out: str = "embedding") -> DataFrame:
    """Adds a vector and ``error``. A command is all or nothing: its first bad row's error is that of all its rows.

    Bad is a row of an unknown model and a null text. Bad rows are known before anything is encoded.
    """
    bad = F.when(~F.coalesce(F.col(model).isin([m.name for m in models]), F.lit(False)), not_found(F.col(model))).when(F.col(text).isNull(), F.lit("ERR text is null"))
    judged = df.withColumn("__bad", F.when(bad.isNotNull(), F.struct(F.col(position).alias("at"), bad.alias("error"))))
    judged = judged.withColumn("error", F.min("__bad").over(W.partitionBy(command))["error"]).drop("__bad")
    known = judged.withColumn("__model", F.when(F.col("error").isNull(), F.col(model)))
    return embed_multi(known, models, "__model", text, out).drop("__model")


def lookup(df: DataFrame, catalog: DataFrame, model: str = "model") -> DataFrame:
    """Adds ``registered``: whether the catalog knows the row's model. The catalog is one row per model."""
    names = catalog.select(F.col("name").alias("__name")).distinct().withColumn("registered", F.lit(True))
    out = df.join(F.broadcast(names), F.col(model) == F.col("__name"), "left").drop("__name")
    return out.withColumn("registered", F.coalesce("registered", F.lit(False)))


def embed_multi(df: DataFrame, models: list[Model], model: str = "model", text: str = "text", out: str = "embedding") -> DataFrame:
    """Each (model, text) row by its own model; an unknown model gives null, not an error.

    One pass over the data: each batch is dealt to the models that its rows name.
    """
    by_name = {m.name: m for m in models}

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, texts in batches:
            result = np.full(len(names), None, object)
            for name, rows in names.groupby(names).indices.items():
                if name in by_name:
                    result[rows] = list(embed_texts(by_name[name], texts.iloc[rows].tolist()))
            yield pd.Series(result)

    return df.withColumn(out, run(F.col(model), F.col(text)))


def exploded(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """One row per vector component: keys, dim, value (double); a null vector keeps one row of nulls."""
    return df.select(*keys, F.posexplode_outer(vector).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def collected(df: DataFrame, command: str, position: str, vector: str) -> DataFrame:
    """Vectors of each command in the order of their positions."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(vector).alias("v"))))
    return df.groupBy(command).agg(F.transform(rows, lambda x: x["v"]).alias("vectors"))
