"""The two plug points: tokenizers (texts to ids) and encoders (ids to hidden values).

A tokenizer has ``encode(texts) -> (flat ids, offsets)``. An encoder has either
``token_vectors(ids)`` (one vector per token, whatever its neighbours) or
``run(ids, mask)`` on a padded batch, returning rank 3 (batch, token, dim) or rank 2.
Objects are built once per Python worker by a factory that Spark pickles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np

from loomvec.functions.tokens import encoded


class CodepointTokenizer:
    """First id, code points, last id, cut at ``max_length``."""

    def __init__(self, max_length: int) -> None:
        self.max_length = max_length

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return encoded(texts, self.max_length)


class FileTokenizer:
    """A tokenizer file of the tokenizers library; padding is dropped by its mask, then ids are cut."""

    def __init__(self, path: str, max_length: int, pad_output: bool = False) -> None:
        from tokenizers import Tokenizer

        self.inner, self.max_length, self.pad_output = Tokenizer.from_file(path), max_length, pad_output

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found = self.inner.encode_batch([t or "" for t in texts], add_special_tokens=True)
        size = np.fromiter((len(e) for e in found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64, int(size.sum()))
        real = np.fromiter(chain.from_iterable(e.attention_mask for e in found), np.int64, len(ids)) != 0
        row = np.repeat(np.arange(len(found)), size)[real]
        ids, size = ids[real], np.bincount(row, minlength=len(found))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        ids, row, place = ids[place < self.max_length], row[place < self.max_length], place[place < self.max_length]
        lens = np.full(len(found), self.max_length) if self.pad_output else np.minimum(size, self.max_length)
        off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        out = np.zeros(int(off[-1]), np.int64)
        out[off[row] + place] = ids
        return out, off


class ResidueEncoder:
    """A deterministic stand-in for a model: value d of a token is ``id * (2d + 1) mod 31 - 15``."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def token_vectors(self, ids: np.ndarray) -> np.ndarray:
        return (ids[:, None] * (2 * np.arange(self.dim) + 1) % 31 - 15).astype(np.float32)


class OnnxEncoder:
    """A model file run by onnxruntime; inputs are bound by name, type ids are zeros.

    All graph optimizations; the thread counts are at least 1, as Spark's tasks share the cores.
    """

    def __init__(self, path: str, output: str, intra_threads: int = 1, inter_threads: int = 1) -> None:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads, options.inter_op_num_threads = max(1, intra_threads), max(1, inter_threads)
        options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
        options.execution_mode = onnxruntime.ExecutionMode.ORT_PARALLEL if inter_threads > 1 else onnxruntime.ExecutionMode.ORT_SEQUENTIAL
        options.log_severity_level = 4
        self.session, self.output = onnxruntime.InferenceSession(path, options), output
        self.inputs = {i.name for i in self.session.get_inputs()}

    def run(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        known = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return self.session.run([self.output], {k: v for k, v in known.items() if k in self.inputs})[0]


@dataclass(frozen=True)
class Model:
    """What a catalog row resolves to."""

    name: str
    dim: int = 8
    max_length: int = 128
    pooling: str = "mean"
    normalize: bool = True
    tokenizer_path: str | None = None
    onnx_path: str | None = None
    output_tensor: str = "last_hidden_state"
    pad_output: bool = False
    intra_threads: int = 1
    inter_threads: int = 1


@lru_cache(maxsize=8)
def loaded(model: Model) -> tuple[object, object]:
    """Tokenizer and encoder of a model, opened on first use in a worker."""
    tokenizer = FileTokenizer(model.tokenizer_path, model.max_length, model.pad_output) if model.tokenizer_path else CodepointTokenizer(model.max_length)
    encoder = OnnxEncoder(model.onnx_path, model.output_tensor, model.intra_threads, model.inter_threads) if model.onnx_path else ResidueEncoder(model.dim)
    return tokenizer, encoder


def _normalized(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
    return np.where(norm[:, None] == 0, v, v / np.where(norm == 0, np.float32(1), norm)[:, None]).astype(np.float32)


def embed_texts(model: Model, texts: list[str | None], batch: int = 32) -> np.ndarray:
    """One float32 vector per text: tokenize, pad, encode, pool, normalize."""
    tokenizer, encoder = loaded(model)
    ids, off = tokenizer.encode(texts)
    lens = np.diff(off)
    if hasattr(encoder, "token_vectors"):
        if model.pooling != "mean":
            raise ValueError("token vectors need mean pooling")
        values = encoder.token_vectors(ids)
        out = np.zeros((len(texts), values.shape[1] if len(values) else model.dim), np.float32)
        full = np.flatnonzero(lens)
        if len(full):  # the next full text begins where this one ends
            out[full] = np.add.reduceat(values, off[:-1][full], axis=0) * (np.float32(1) / lens[full].astype(np.float32))[:, None]
    else:
        parts = []
        order = np.argsort(lens, kind="stable")  # like lengths together, less padding
        for a in range(0, len(order), batch):
            mine = order[a : a + batch]
            width = int(lens[mine].max(initial=0))
            padded = np.zeros((len(mine), width), np.int64)
            mask = np.arange(width) < lens[mine][:, None]
            padded[mask] = np.concatenate([ids[off[k] : off[k + 1]] for k in mine])
            hidden = encoder.run(padded, mask.astype(np.int64))
            if (hidden.ndim == 2) != (model.pooling == "none"):
                raise ValueError(f"pooling {model.pooling} does not fit an output of rank {hidden.ndim}")
            if hidden.ndim == 3:
                scale = np.float32(1) / np.maximum(mask.sum(axis=1), 1).astype(np.float32)
                hidden = (hidden * mask[:, :, None]).sum(axis=1, dtype=np.float32) * scale[:, None]
            parts.append(hidden.astype(np.float32))
        out = np.concatenate(parts)[np.argsort(order)] if parts else np.zeros((0, model.dim), np.float32)
    return _normalized(out) if model.normalize else out
