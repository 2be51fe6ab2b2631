"""A session-level façade: named models, embeddings of lists or DataFrames, status tables."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.functions.models import Model
from loomvec.operators.commands import HELP
from loomvec.operators.embed import embed, embed_multi


class Proxy:
    """One model of a client; ``proxy[text]`` is a vector, ``proxy[a, b]`` a list of them."""

    def __init__(self, client: Client, model: Model) -> None:
        self.client, self.model = client, model

    def __getitem__(self, texts: str | tuple[str, ...]) -> list:
        many, began = texts if isinstance(texts, tuple) else (texts,), time.monotonic()
        rows = self.client.spark.createDataFrame(list(enumerate(many)), "pos int, text string")
        out = [list(r.embedding) for r in embed(rows, self.model).orderBy("pos").select("embedding").collect()]
        self.client.served(self.model.name, len(many), began)
        return out if isinstance(texts, tuple) else out[0]

    def frame(self, df: DataFrame, text: str = "text") -> DataFrame:
        return embed(df, self.model, text)


class Client:
    """Models by name on a Spark session, and counters of what it served."""

    def __init__(self, spark: SparkSession, models: list[Model], debug: bool = False) -> None:
        self.spark, self.debug, self.started = spark, debug, time.monotonic()
        self._models, self._proxies, self._served = {m.name: m for m in models}, {}, {m.name: [0, 0] for m in models}

    @classmethod
    def connect(cls, models: list[Model], url: str | None = None, debug: bool = False) -> Client:
        """A client on the session of a Spark master: the given one, that of ``LOOMVEC_MASTER``, else this machine."""
        master = url or os.environ.get("LOOMVEC_MASTER") or "local[*]"
        return cls(SparkSession.builder.master(master).getOrCreate(), models, debug)

    def __getitem__(self, name: str) -> Proxy:
        if name not in self._proxies:
            self._proxies[name] = Proxy(self, self._models[name])
        return self._proxies[name]

    def reset(self) -> None:
        """Forget the proxies."""
        self._proxies = {}

    def served(self, name: str, texts: int, began: float) -> None:
        """Count a request; with ``debug`` print it and its milliseconds."""
        took = time.monotonic() - began
        self._served[name][0] += 1
        self._served[name][1] += int(took * 1e6)
        if self.debug:
            print(f"embed {name} ({texts} texts, {took * 1000:.2f}ms)")

    def multi(self, pairs: list[tuple[str, str]]) -> list[list[float] | None]:
        """A vector per (model, text); null where the model is unknown."""
        rows = self.spark.createDataFrame([(i, m, t) for i, (m, t) in enumerate(pairs)], "pos int, model string, text string")
        out = embed_multi(rows, list(self._models.values())).orderBy("pos").select("embedding").collect()
        return [None if r.embedding is None else list(r.embedding) for r in out]

    def models(self) -> DataFrame:
        """Names, dimensions and states: ready once a model has served a request, else registered."""
        rows = [(m.name, m.dim, "ready" if self._served[m.name][0] else "registered") for m in self._models.values()]
        return self.spark.createDataFrame(rows, "name string, dim int, status string").orderBy("name")

    def info(self, name: str) -> dict[str, object]:
        """A model's settings and counters; empty for an unknown one."""
        if name not in self._models:
            return {}
        m, (n, us) = self._models[name], self._served[name]
        return {"dim": m.dim, "max_length": m.max_length, "pooling": m.pooling, "normalize": m.normalize, "requests": n, "avg_latency_us": us // n if n else 0}

    def stats(self) -> dict[str, int]:
        return {"uptime_secs": int(time.monotonic() - self.started), "total_requests": sum(n for n, _ in self._served.values()), "models_loaded": sum(n > 0 for n, _ in self._served.values())}

    def help(self) -> list[str]:
        return list(HELP.values())

    def ping(self) -> str:
        return self.spark.range(1).select(F.lit("PONG")).first()[0]

    def ready(self) -> str:
        """``ready``, or why not."""
        return "ready" if self._models else "no models"

    def is_ready(self) -> bool:
        return self.ready() == "ready"

    def command(self, *args: str) -> object:
        """The reply to a raw command: its name in any case, then its arguments; errors are text that begins with ERR."""
        name, rest = (args[0].lower() if args else ""), list(args[1:])
        wrong = f"ERR wrong number of arguments for '{name.upper()}' command"
        if name == "embed":
            if len(rest) < 2:
                return wrong
            return self[rest[0]][tuple(rest[1:])] if rest[0] in self._models else f"ERR model '{rest[0]}' not found"
        if name == "embed.multi":
            return self.multi(list(zip(rest[::2], rest[1::2], strict=True))) if rest and len(rest) % 2 == 0 else wrong
        if name == "info":
            return (self.info(rest[0]) or f"ERR model '{rest[0]}' not found") if rest else wrong
        plain = {"models": lambda: [tuple(r) for r in self.models().collect()], "stats": self.stats, "ready": self.ready, "help": self.help, "ping": self.ping}
        return plain[name]() if name in plain else f"ERR unknown command '{args[0] if args else ''}'"
