"""Operator 10: URL verdicts from rules and a blocked Bloom filter of listed URLs.

Native column expressions only. A rule (host, path) fits its host and every subdomain when
the URL's path starts with the rule's; the longest rule decides. A URL without a rule is
blocked when its canonical form, or its host's root, is listed, else allowed: the listed
URLs' blocked Bloom filter lets possible hits through to an exact hash join, which removes
its false positives.

Filter: block ``pmod(hash, blocks)`` holds four 64-bit words, each with one bit set per
listed URL. The number of blocks follows the list up to ``max_blocks``; that bounds what
is broadcast (48 bytes a block). A longer list only makes the filter less sharp, as the
join is exact. Its rows are salted, so one URL or host with a third of all rows is spread
over ``SALTS`` tasks; the listed URLs go to each of them.

Canonical: ``urls.canonical_url``, the form of operator 2.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and
is allowed; repeated rows give repeated rows; an empty list allows; other columns are
ignored. Equally long rules: the longer host, then ``block``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.llm.urls import canonical_host, canonical_url, host_of, path_of

SALTS = 8
MAX_BLOCKS = 1 << 15
URLS_PER_BLOCK = 16
MAX_RULES = 10_000


def _words(key: Column) -> list[Column]:
    """The four 64-bit words, one bit each, of a URL in its block."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(k)), F.lit(64)).cast("int")) for k in range(1, 5)]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w1..w4) of a table with column ``listed_url``."""
    key = F.col("listed_url")
    rows = listed.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *[w.alias(f"w{k}") for k, w in enumerate(_words(key), 1)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(1, 5)])


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(size, host size, verdict, rule) of the longest fitting rule, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules; list URLs instead")
    if not rules:
        return F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string>")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host.lower(), []).append((rule_path, verdict))
    of_host = F.create_map(
        *[
            x
            for h, own in by_host.items()
            for x in (F.lit(h), F.array(*[F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"), F.lit(p).alias("path")) for p, v in own]))
        ]
    )
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.filter(F.transform(suffixes, lambda s: F.try_element_at(of_host, s)), lambda x: x.isNotNull())
    fits = F.filter(F.flatten(known), lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["host_size"], r["verdict"], r["rule"])))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Columns id, host, path, rule, verdict.

    ``rules``: (allow | block, host, path). ``listed``: canonical URLs (or host roots) to block.
    """
    listed = listed.select(F.col(f"`{listed_col}`").alias("listed_url")).where("listed_url is not null").distinct()
    n_blocks = int(min(max_blocks, max(1, listed.count() // URLS_PER_BLOCK + 1)))
    blocks = F.broadcast(bloom_blocks(listed, n_blocks))  # at most max_blocks rows of 40 bytes
    url = F.col(f"`{url_col}`").cast("string")
    judged = pages.select(F.col(f"`{id_col}`").alias("__id"), url.alias("__url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("__rule", _rule(F.col("host"), F.col("path"), rules))
    probe = judged.withColumns({"__page": F.coalesce(canonical_url(F.col("__url")), F.lit("")), "__root": F.coalesce(canonical_host(F.col("__url")), F.lit(""))}).drop("__url")
    for name in ("page", "root"):
        key, table = F.col(f"__{name}"), blocks.select(F.col("block").alias(f"__{name}_block"), *[F.col(f"w{k}").alias(f"__{name}{k}") for k in range(1, 5)])
        probe = probe.join(table, F.pmod(F.xxhash64(key), F.lit(n_blocks)) == F.col(f"__{name}_block"), "left")
        hit = F.lit(True)
        for k, w in enumerate(_words(key), 1):
            hit = hit & (F.col(f"__{name}{k}").bitwiseAND(w) != 0)
        probe = probe.withColumn(f"__{name}_maybe", F.coalesce(hit, F.lit(False)) & F.col("__rule").isNull())
    out = [F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule")]
    clear = probe.where("not (__page_maybe or __root_maybe)").select(*out, F.coalesce("__rule.verdict", F.lit("allow")).alias("verdict"))
    maybe = probe.where("__page_maybe or __root_maybe")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    on_page = listed.select(F.col("listed_url").alias("__page"), F.lit(True).alias("__page_hit"), salts)
    on_root = listed.where(~F.contains("listed_url", F.lit("/"))).select(F.col("listed_url").alias("__root"), F.lit(True).alias("__root_hit"), salts)
    maybe = maybe.withColumn("__salt", F.pmod(F.xxhash64("__id", "path"), F.lit(SALTS)).cast("int"))
    sure = maybe.join(on_page, ["__page", "__salt"], "left").join(on_root, ["__root", "__salt"], "left")
    sure = sure.select(*out, F.when(F.coalesce("__page_hit", "__root_hit", F.lit(False)), "block").otherwise("allow").alias("verdict"))
    return clear.unionByName(sure)
