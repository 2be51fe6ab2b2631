"""Configuration, repository listings, verification sets and wire replies."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def load_config(path: str) -> dict:
    """Server settings from a JSON or YAML file (YAML if its parser is installed)."""
    text = Path(path).read_text()
    try:
        config = json.loads(text)
    except ValueError:
        import yaml

        config = yaml.safe_load(text)
    return checked_config({"listen": ":6379", "models": {}, **(config or {})})


def checked_config(config: dict) -> dict:
    """The settings, if a certificate has its key (and a key its certificate) and each model a file or a repository."""
    if bool(config.get("tls_cert")) != bool(config.get("tls_key")):
        raise ValueError("tls_cert and tls_key go together")
    for name, model in config["models"].items():
        if not (model.get("onnx") or model.get("model_repo")):
            raise ValueError(f"model {name} needs onnx or model_repo")
    return config


_SETTINGS = {
    "onnx": str, "model-repo": str, "tokenizer": str, "pooling": str, "normalize": bool, "output-tensor": str, "pad-output": bool, "dim": int,
    "max-length": int, "workers": int, "intra-op-threads": int, "inter-op-threads": int,
}
_SERVER = {"listen": str, "password": str, "cache": str, "tls-cert": str, "tls-key": str, "ort-lib": str}


def parse_flags(args: list[str]) -> dict:
    """Server settings from command-line flags.

    ``-model NAME`` begins a model, whose settings follow as ``-model-onnx PATH``, ``-model-repo``
    and the like (or without ``model-``, as ``-dim 8``); settings before any name are those of
    a model called ``model``. ``-config FILE`` replaces all before it. An unknown flag, and
    one that lacks its value, is an error.
    """
    config: dict = {"listen": ":6379", "models": {}}
    name, rest = None, list(args)

    def value(flag: str) -> str:
        if not rest:
            raise ValueError(f"{flag} needs a value")
        return rest.pop(0)

    while rest:
        flag = rest.pop(0)
        key = flag.removeprefix("-")
        if key == "config":
            config = load_config(value(flag))
        elif key in _SERVER:
            config[key.replace("-", "_")] = value(flag)
        elif key == "model":
            name = value(flag)
            config["models"][name] = {}
        else:
            short = key if key in _SETTINGS else key.removeprefix("model-")
            if not flag.startswith("-") or short not in _SETTINGS:
                raise ValueError(f"unknown flag {flag}")
            name = name or "model"
            kind = _SETTINGS[short]
            config["models"].setdefault(name, {})[short.replace("-", "_")] = True if kind is bool else kind(value(flag))
    if not config["models"]:
        raise ValueError("no models: use -config, or -model with a file or a repository")
    return checked_config(config)


def missing_files(config: dict) -> list[str]:
    """Errors of model and tokenizer files that do not exist; a model from a repository has none yet."""
    out = []
    for name, m in sorted(config["models"].items()):
        if m.get("model_repo"):
            continue
        tokenizer = m.get("tokenizer") or str(Path(m["onnx"]).parent / "tokenizer.json")
        out += [f"model {name}: {kind} file {p} does not exist" for kind, p in (("onnx", m["onnx"]), ("tokenizer", tokenizer)) if not Path(p).is_file()]
    return out


def config_frame(spark: SparkSession, config: dict) -> DataFrame:
    """The models of a configuration as ``catalog.resolve`` takes them; ``config.json`` beside a model's file is read."""
    rows = []
    for name, m in sorted(config["models"].items()):
        batching = m.get("batching") or {}
        beside = Path(m["onnx"]).parent / "config.json" if m.get("onnx") else None
        rows.append((name, m.get("max_length"), m.get("dim"), m.get("output_tensor"), m.get("pooling"), m.get("normalize"), batching.get("timeout"), batching.get("max_batch"), beside.read_text() if beside and beside.is_file() else None))
    return spark.createDataFrame(rows, "name string, max_length long, dim long, output_tensor string, pooling string, normalize boolean, batch_timeout_ms long, max_batch long, config_json string")


def model_tensors(path: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Input names, and (name, rank, last dimension or 0) of the outputs, of a model file."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path)
    last = lambda shape: shape[-1] if len(shape) > 1 and isinstance(shape[-1], int) else 0
    return [i.name for i in session.get_inputs()], [(o.name, len(o.shape), last(o.shape)) for o in session.get_outputs()]


def outputs_frame(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(model, name, rank, dim) of the outputs of model files, as ``catalog.select_output`` takes them."""
    rows = [(model, *out) for model, path in sorted(paths.items()) for out in model_tensors(path)[1]]
    return spark.createDataFrame(rows, "model string, name string, rank int, dim long")


def total_memory() -> int:
    """Bytes of this machine's memory; 0 where it can't be told."""
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return 0


def pick_model_file(listing: DataFrame) -> DataFrame:
    """(repo, path) of each repository's model: model.onnx, onnx/model.onnx, else the first .onnx by name.

    ``listing``: repo, json with ``siblings``.
    """
    files = listing.select("repo", F.explode(F.from_json("json", "siblings array<struct<rfilename string, size long>>")["siblings"]).alias("f"))
    files = files.select("repo", F.col("f.rfilename").alias("path")).where(F.col("path").endswith(".onnx"))
    rank = F.when(F.col("path") == "model.onnx", 0).when(F.col("path") == "onnx/model.onnx", 1).otherwise(2)
    return files.withColumn("__at", F.row_number().over(W.partitionBy("repo").orderBy(rank, "path"))).where("__at = 1").drop("__at")


def command_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(connection, seq, args) of a folder of JSON lines, as a table or as a stream of new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("connection long, seq long, args array<string>").json(path)


def verification_set(spark: SparkSession, path: str) -> DataFrame:
    """(pos, sentence, embedding) of a JSON file with ``sentences`` and ``embeddings``."""
    doc = spark.read.schema("model string, dim int, sentences array<string>, embeddings array<array<double>>").json(path, multiLine=True)
    return doc.select(F.posexplode(F.arrays_zip("sentences", "embeddings")).alias("pos", "z")).select("pos", "z.sentences", "z.embeddings").toDF("pos", "sentence", "embedding")


def wire_reply(kind: Column, text: Column) -> Column:
    """A reply in the serialization protocol of the wire: status, error, integer, bulk or null."""
    crlf = F.lit("\r\n")
    bulk = F.concat(F.lit("$"), F.octet_length(text).cast("string"), crlf, text, crlf)
    return (
        F.when(text.isNull(), F.lit("$-1\r\n"))
        .when(kind == "status", F.concat(F.lit("+"), text, crlf))
        .when(kind == "error", F.concat(F.lit("-"), text, crlf))
        .when(kind == "integer", F.concat(F.lit(":"), text, crlf))
        .otherwise(bulk)
    )


def wire_texts(texts: Column) -> Column:
    """The reply of a command with an array of results: one bulk for one, else an array of bulks."""
    bulks = F.transform(texts, lambda t: wire_reply(F.lit("bulk"), t))
    many = F.concat(F.lit("*"), F.size(texts).cast("string"), F.lit("\r\n"), F.array_join(bulks, ""))
    return F.when(F.size(texts) == 1, F.get(bulks, F.lit(0))).otherwise(many)


def wire_bytes(values: list[bytes | None]) -> bytes:
    """The same of binary results, as a server sends them; null where one is missing."""
    parts = [b"$-1\r\n" if v is None else b"$%d\r\n%s\r\n" % (len(v), v) for v in values]
    return parts[0] if len(parts) == 1 else b"*%d\r\n" % len(parts) + b"".join(parts)


class WireError(Exception):
    """An error reply."""


def read_reply(data: bytes, at: int = 0) -> tuple[object, int]:
    """(value, next position) of a reply: str status, int, bytes, None, list, or a WireError object."""
    end = data.index(b"\r\n", at)
    kind, head, after = data[at : at + 1], data[at + 1 : end], end + 2
    if kind == b"+":
        return head.decode(), after
    if kind == b"-":
        return WireError(head.decode()), after
    if kind == b":":
        return int(head), after
    if kind not in b"$*" or not kind:
        raise ValueError(f"unknown reply {kind!r}")
    n = int(head)
    if n < 0:
        return None, after
    if kind == b"$":
        return data[after : after + n], after + n + 2
    out = []
    for _ in range(n):
        value, after = read_reply(data, after)
        out.append(value)
    return out, after


def write_command(*args: str | bytes) -> bytes:
    """A command as an array of bulk strings."""
    parts = [a.encode() if isinstance(a, str) else a for a in args]
    return b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts)
