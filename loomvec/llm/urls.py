"""URL parts and the canonical form that operators 2 and 10 share, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?s)^(.*?)://(?:[wW]{3}\.)?([^/?#]*)([^?#]*)(\?[^#]*)?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(url: Column) -> Column:
    """The host without ``www.`` and without its scheme's default port, A-Z lower-cased."""
    scheme, host = (F.translate(F.regexp_extract(url, _PARTS, k), _UPPER, _LOWER) for k in (1, 2))
    return F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def canonical_url(url: Column) -> Column:
    """Canonical host, path without its final slash, and the query without tracking fields; no scheme, no fragment.

    A URL without ``://`` stays as it is.
    """
    path, query = (F.regexp_extract(url, _PARTS, k) for k in (3, 4))
    query = F.regexp_replace(F.regexp_replace(query, r"(^\?|&)(utm_[a-z]+|ref)=[^&]*", ""), "^&", "?")
    return F.when(F.contains(url, F.lit("://")), F.concat(canonical_host(url), F.regexp_replace(path, "/$", ""), query)).otherwise(url)
