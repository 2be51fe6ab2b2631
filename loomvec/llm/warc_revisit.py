"""Operator 2: not-modified revisit records resolved to earlier full responses.

For each revisit record, an as-of join by canonical URL finds the latest earlier full
response (earlier: a smaller capture time, ties by record id). The revisit counts as
resolved if its validators agree with that response: the entity tag if both have one
(weak comparison), else the last-modified value, else the payload digest; with nothing to
compare it stays ``unverified``. Header fields that a not-modified answer may update are
then merged over the stored response's fields.

The as-of join splits time into about ``slices`` slices at quantiles of all records' times.
A time that spans several quantiles is a slice of its own, split at quantiles of the record
ids if those are numbers. Inside one (URL, slice) a window carries the last response
forward; across slices only each slice's last response travels (one row per URL and slice).
So a URL that holds a third of all records is spread over a third of the slices, whenever
its records were taken, and no payload is shuffled: rows carry ids, validators and headers.

Defined results: a record without a URL, time or id matches nothing (``no_response``);
several records with one id and time are ordered by all their values; header names are
lower-cased, and of names that differ in case only the last in byte order counts; null
headers are empty; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomvec.llm.urls import canonical_url
from loomvec.operators.batching import cuts_below

SLICES = 64

# Header fields that a 304 answer carries and that update the stored response.
PERMITTED_HEADERS = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def _opaque(tag: Column) -> Column:
    """An entity tag without its weakness mark."""
    return F.regexp_replace(tag, "^W/", "")


def _entries(headers: Column) -> Column:
    """Sorted (name, value) entries with lower-case names; a map does not sort, its entries do."""
    known = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    named = F.array_sort(F.transform(F.map_entries(known), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("own"), e["value"].alias("value"))))
    last = F.filter(named, lambda e, i: ~F.coalesce(F.get(named, i + 1)["key"] == e["key"], F.lit(False)))
    return F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def _cuts(rows: DataFrame, column: str, slices: int) -> list:
    found = rows.agg(F.percentile_approx(column, [k / slices for k in range(1, slices)], 100 * slices).alias("cuts")).first().cuts
    return found or []


def _slice(rows: DataFrame, slices: int) -> Column:
    """A slice number that never falls as (time, id) rises."""
    cuts = _cuts(rows, "ts", slices) if slices > 1 else []
    often = sorted({c for c in cuts if cuts.count(c) > 1})
    number = 2 * cuts_below(F.col("ts"), sorted(set(cuts)))
    if not often:
        return number.cast("long")
    ids = dict(rows.dtypes)["record_id"] in ("tinyint", "smallint", "int", "bigint")
    inside = cuts_below(F.col("record_id"), sorted(set(_cuts(rows, "record_id", slices)))) if ids else F.lit(0)
    at = F.col("ts").isin(*often)  # such a time comes after the smaller ones of its slice
    return (number + F.when(at, 1).otherwise(0)).cast("long") * slices + F.when(at, inside).otherwise(0)


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Resolve revisits.

    ``records``: record_id, url, ts (long), kind (response | revisit), etag, last_modified,
    digest, headers (map). Result, one row per revisit: record_id,
    canonical_url, response_id (null if none), status (resolved | mismatch | unverified |
    no_response) and headers (merged if resolved or unverified, else the revisit's own).
    """
    need = ["record_id", "ts", "kind", "etag", "last_modified", "digest", "headers"]
    rows = records.select(*need, canonical_url(F.col("url")).alias("url"))
    rows = rows.withColumns({"headers": _entries(F.col("headers")), "ts": F.col("ts").cast("long")})
    whole = F.col("url").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    alone = rows.where(~whole & (F.col("kind") == "revisit"))
    rows = rows.where(whole & F.col("kind").isin("response", "revisit"))
    rows = rows.withColumn("slice", _slice(rows, slices))
    order = [F.col(c) for c in ("ts", "record_id", "kind", "etag", "last_modified", "digest", "headers")]
    response = F.when(F.col("kind") == "response", F.struct(*[F.col(c) for c in ("ts", "record_id", "etag", "last_modified", "digest", "headers")]))
    here = W.partitionBy("url", "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("found", F.last(response, ignorenulls=True).over(here)).where("kind = 'revisit'")
    # the last response of each slice, carried over the (at most ``slices``) later ones
    ends = rows.groupBy("url", "slice").agg(F.max(response).alias("last"))
    past = W.partitionBy("url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(past)).where("carried is not null").select("url", "slice", "carried")
    matched = near.join(carried, ["url", "slice"], "left").withColumn("found", F.coalesce("found", "carried")).drop("carried", "slice")
    out = matched.unionByName(alone, allowMissingColumns=True)
    old, mine = F.col("found"), F.col("headers")
    checks = [(_opaque(F.col("etag")), _opaque(old["etag"])), (F.col("last_modified"), old["last_modified"]), (F.col("digest"), old["digest"])]
    agrees = F.lit(None).cast("boolean")
    for a, b in reversed(checks):
        agrees = F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(agrees)
    status = F.when(old.isNull(), "no_response").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    allowed = F.filter(mine, lambda e: e["key"].isin(*PERMITTED_HEADERS))
    names = F.transform(allowed, lambda e: e["key"])
    merged = F.array_sort(F.concat(F.filter(old["headers"], lambda e: ~F.array_contains(names, e["key"])), allowed))
    out = out.withColumn("status", status)
    headers = F.when(F.col("status").isin("resolved", "unverified"), merged).otherwise(mine)
    return out.select("record_id", F.col("url").alias("canonical_url"), old["record_id"].alias("response_id"), "status", F.map_from_entries(headers).alias("headers"))
