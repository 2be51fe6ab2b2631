"""Vector columns: masked mean pooling, L2 normalization, cosine, float32 bytes.

Float columns keep single precision: sums in token order, a product with the reciprocal
of the count, a norm summed in double and rounded once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0; all zeros if there are none."""
    pairs = F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda x: x["m"] != 0)
    rows = F.transform(pairs, lambda x: x["h"])
    blank = F.transform(F.get(hidden, F.lit(0)), lambda _: F.lit(0.0).cast("float"))
    total = F.aggregate(rows, blank, lambda a, h: F.zip_with(a, h, lambda x, y: (x + y).cast("float")))
    scale = F.when(F.size(rows) > 0, (F.lit(1.0).cast("float") / F.size(rows).cast("float")).cast("float")).otherwise(F.lit(0.0).cast("float"))
    return F.transform(total, lambda x: (x * scale).cast("float"))


def l2_normalize(vector: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = F.sqrt(squares).cast("float")
    return F.when(norm == 0, vector).otherwise(F.transform(vector, lambda x: (x / norm).cast("float")))


def pre_pooled(vector: Column, normalize: bool = False) -> Column:
    """A model's rank-2 output as it is, or normalized."""
    return l2_normalize(vector) if normalize else vector


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))


def same_bytes(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


@F.arrow_udf(T.BinaryType())
def to_f32_bytes(vectors: pa.Array) -> pa.Array:
    """Little-endian float32 bytes: the vectors' own values, cut at other offsets."""
    lens = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    data = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
    off = np.concatenate([[0], 4 * np.cumsum(lens)]).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])
    return pc.if_else(vectors.is_valid(), out, None)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def from_f32_bytes(data: pa.Array) -> pa.Array:
    lens = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = b"".join(x for x in data.to_pylist() if x) if data.offset or data.null_count else data.buffers()[2]
    values = np.frombuffer(raw, "<f4", int(lens.sum()) // 4) if raw is not None and lens.sum() else np.zeros(0, "<f4")
    off = np.concatenate([[0], np.cumsum(lens // 4)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values), mask=data.is_null())
