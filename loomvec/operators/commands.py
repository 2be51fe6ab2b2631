"""Checks of a command log: parsing, arity, authentication, readiness, constants.

Commands: embed, embed.multi, info, models, stats, ready, help, auth, ping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EXEMPT = ["auth", "ping", "ready"]

HELP = {
    "embed": "embed MODEL TEXT...: one vector per text",
    "embed.multi": "embed.multi MODEL TEXT [MODEL TEXT]...: each pair by its own model, null where that fails",
    "models": "models: names, dimensions and states",
    "info": "info MODEL: settings and counters",
    "stats": "stats: totals of all models",
    "ready": "ready: OK, loading or draining",
    "help": "help: these lines",
    "auth": "auth PASSWORD: authenticate a connection",
    "ping": "ping: PONG",
}


def parsed(log: DataFrame, args: str = "args") -> DataFrame:
    """Adds ``command`` (lower-cased first argument), ``known`` and ``n_args``."""
    name = F.lower(F.get(F.col(args), F.lit(0)))
    return log.withColumns({"command": name, "known": F.coalesce(name.isin(*HELP), F.lit(False)), "n_args": F.size(args)})


def arity_error(command: Column, n_args: Column) -> Column:
    """Error text of a wrong number of arguments (the command counts as one), else null."""
    bad = (
        ((command == "embed") & (n_args < 3))
        | ((command == "info") & (n_args < 2))
        | ((command == "auth") & (n_args != 2))
        | ((command == "embed.multi") & ((n_args < 3) | (n_args % 2 == 0)))
    )
    return F.when(bad, F.concat(F.lit("ERR wrong number of arguments for '"), F.upper(command), F.lit("' command")))


def auth_reply(given: Column, n_args: Column, password: str) -> Column:
    if not password:
        return F.lit("ERR Client sent AUTH, but no password is set")
    wrong = F.when(given != password, "ERR invalid password").otherwise("OK")
    return F.when(n_args != 2, "ERR wrong number of arguments for 'AUTH' command").otherwise(wrong)


def auth_gate(log: DataFrame, connection: str, seq: str, password: str, args: str = "args") -> DataFrame:
    """Adds ``reply``: an AUTH command's answer, NOAUTH before a connection has one that is OK, else null."""
    given = F.get(F.col(args), F.lit(1))
    out = parsed(log, args)
    mine = F.when(F.col("command") == "auth", auth_reply(given, F.col("n_args"), password))
    out = out.withColumn("__auth", mine)
    before = W.partitionBy(connection).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    opened = F.coalesce(F.max(F.col("__auth") == "OK").over(before), F.lit(False))
    closed = F.lit(bool(password)) & ~F.coalesce(F.col("command").isin(*EXEMPT), F.lit(False)) & ~opened
    return out.withColumn("reply", F.when(closed, "NOAUTH Authentication required.").otherwise(F.col("__auth"))).drop("__auth")


def drained(command: Column, draining: Column) -> Column:
    """Whether a draining server rejects the command."""
    return draining & command.isin("embed", "embed.multi")


def readiness(state: Column, n_models: Column) -> Column:
    """Answer of the ready command: OK, or the bare reason why not."""
    return F.when((state == "loading") & (n_models == 0), "no models").when(state == "ready", "OK").otherwise(state)
