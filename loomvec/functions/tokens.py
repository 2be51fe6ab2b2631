"""Token columns: code-point tokenizer, truncation and padding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Ids around a code-point encoding, and the default longest sequence.
FIRST_ID, LAST_ID, MAX_LENGTH = 101, 102, 128


def truncate(ids: Column, max_length: int) -> Column:
    """The first ``max_length`` ids; a special last id may be cut off."""
    return F.slice(ids, 1, max_length)


def encoded(texts: list[str | None], max_length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets): first id, each character's code point, last id, cut at ``max_length``."""
    cut = [t or "" for t in texts] if max_length is None else [(t or "")[: max(0, max_length - 1)] for t in texts]
    chars = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = np.fromiter(map(len, cut), np.int64, len(cut))
    lens = size + 2 if max_length is None else np.minimum(size + 2, max_length)
    off = np.concatenate([[0], np.cumsum(lens)])
    ids = np.full(int(off[-1]), LAST_ID, np.int64)
    ids[off[:-1][lens > 0]] = FIRST_ID
    at = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
    ids[np.repeat(off[:-1] + 1, size) + at] = chars
    return ids, off


def codepoint_ids(text: Column, max_length: int | None = MAX_LENGTH) -> Column:
    """First id, each character's code point, last id; null text is empty.

    One Arrow call for each batch of texts: an expression over characters makes a string of each.
    """

    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        ids, off = encoded(texts.to_pylist(), max_length)
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))

    return run(text)


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1).cast("long"), F.size(ids))


def strip_padding(ids: Column, mask: Column) -> Column:
    """Ids whose mask is not 0, wherever the padding is."""
    kept = F.filter(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda x: x["m"] != 0)
    return F.transform(kept, lambda x: x["i"])


def pad(values: Column, width: Column) -> Column:
    """Zeros after the values, up to ``width``."""
    return F.concat(values, F.array_repeat(F.lit(0).cast("long"), F.greatest(width - F.size(values), F.lit(0))))


def pad_batches(df: DataFrame, batch: str, ids: str) -> DataFrame:
    """Adds width, input_ids and attention_mask, padded to the longest sequence of each batch."""
    width = F.max(F.size(ids)).over(W.partitionBy(batch))
    out = df.withColumn("width", width)
    return out.withColumns({"input_ids": pad(F.col(ids), F.col("width")), "attention_mask": pad(attention_mask(F.col(ids)), F.col("width"))})


def pad_output(ids: Column, max_length: int) -> tuple[Column, Column]:
    """Ids padded to ``max_length``, with a mask of ones throughout."""
    return pad(truncate(ids, max_length), F.lit(max_length)), F.array_repeat(F.lit(1).cast("long"), max_length)
