"""The ten registered queries over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.llm import decontaminate, language_id, line_dedup, ngram_join, piece_bpe, token_store, topk, toxicity, url_filter, warc_revisit
from loomvec.llm.common import crc32_of_id, new_table_path, read
from loomvec.llm.urls import canonical_url

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
TOXIC_AT = 0.3

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

LISTED_HOSTS = ["spam-farm.example.org", "spam-farm.example.com", "spam-farm.example.net", "cheap-pills.example.com"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl of the pages' sections (host and first path segment): a response and a revisit for each page.

    Capture times are scattered over the crawl by the page id, so a section's revisits follow
    responses of other pages, some long before, and some come before any. A section has three
    versions of its content; URLs vary in scheme, tracking field, fragment and final slash.
    """
    at = F.col("page_id")
    section = F.regexp_extract("url", r"^(https?://[^/?#]+(?:/[^/?#]+)?)", 1)
    ends = F.when(at % 3 == 0, "/").when(at % 3 == 1, "?utm_source=feed").otherwise("#top")
    url = F.when(section != "", F.concat(section, ends))
    version = lambda n: F.md5(F.concat_ws("|", section, n.cast("string")))
    tag, other = version(at % 3), version(F.floor(at / 3) % 3)
    none = F.lit(None).cast("string")
    full_at, seen_at = at * 7919 % 1_000_003, (at * 40_503 + 12_345) % 1_000_003
    header = F.create_map(F.lit("ETag"), tag, F.lit("date"), full_at.cast("string"), F.lit("Content-Type"), F.lit("text/html"))
    full = pages.select((at * 2).alias("record_id"), url.alias("url"), full_at.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.when(at % 4 != 0, (at % 2).cast("string")).alias("last_modified"), tag.alias("digest"), header.alias("headers"))
    update = F.create_map(F.lit("Date"), seen_at.cast("string"), F.lit("server"), F.lit("crawl"), F.lit("Vary"), F.lit("accept"))
    revisit = pages.select(
        (at * 2 + 1).alias("record_id"), url.alias("url"), seen_at.alias("ts"), F.lit("revisit").alias("kind"), F.when(at % 7 != 0, F.concat(F.lit("W/"), other)).alias("etag"),
        F.when(at % 7 == 0, F.when(at % 2 == 0, F.lit("1"))).alias("last_modified"), F.when(at % 21 == 0, tag).otherwise(none).alias("digest"), update.alias("headers")
    )
    return full.unionByName(revisit)


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisit.resolve_revisits(page_captures(read(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("record_id", "canonical_url", "response_id", "status", F.array_join(lines, ";").alias("headers"))


def op3_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_pieces(read(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = crc32_of_id(F.col("doc_id")) % 5 == 0
    samples = language_id.learn(docs.where(~held))
    return language_id.identify(docs, samples, held_out=F.coalesce(held, F.lit(False)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "token-store")
    token_store.write_store(read(spark, sf_dir, "documents"), tokenizer_path(BYTE_MODEL), path)
    return token_store.read_store(spark, path)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    lexicon, trees = toxicity.learn(docs, labels, crc32_of_id(F.col("doc_id")) % 4 != 2)
    out = toxicity.score_toxicity(docs, lexicon, trees)
    held = F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs to block: some hosts, about one in sixteen of the pages' URLs, and as many that no page has."""
    known = pages.select(canonical_url(F.col("url")).alias("url")).where("url is not null")
    mark = F.substring(F.md5("url"), 1, 1)
    listed = known.where(mark == "0").unionByName(known.where(mark == "1").select(F.concat("url", F.lit("/absent")).alias("url")))
    return listed.unionByName(pages.sparkSession.createDataFrame([(h,) for h in LISTED_HOSTS], "url string"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, listed_urls(pages), RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_warc_revisit": op2_warc_revisit,
    "op3_piece_encoding": op3_piece_encoding,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_store": op7_token_store,
    "op8_ngram_join": op8_ngram_join,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_REVISIT_SQL = r"""
WITH p AS (SELECT page_id AS i, nullif(regexp_extract(url, '^(https?://[^/?#]+(?:/[^/?#]+)?)', 1), '') AS section FROM pages),
c AS (
  SELECT i, section, lower(regexp_extract(section, '://(?:[wW]{3}\.)?([^/]+)', 1)) || regexp_extract(section, '://[^/]+(/.*)', 1) AS cu
  FROM p
),
f AS (
  SELECT cu, i * 2 AS id, i * 7919 % 1000003 AS ts, md5(section || '|' || i % 3) AS tag, CASE WHEN i % 4 <> 0 THEN (i % 2)::VARCHAR END AS modified FROM c
),
r AS (
  SELECT cu, i * 2 + 1 AS id, (i * 40503 + 12345) % 1000003 AS ts, CASE WHEN i % 7 <> 0 THEN md5(section || '|' || (i // 3) % 3) END AS tag,
         CASE WHEN i % 14 = 0 THEN '1' END AS modified, CASE WHEN i % 21 = 0 THEN md5(coalesce(section, '') || '|' || i % 3) END AS digest
  FROM c
),
m AS (
  SELECT r.*, f.id AS found, f.tag AS f_tag, f.modified AS f_modified
  FROM (SELECT *, ts::HUGEINT * 1000000000000 + id AS k FROM r) r
  ASOF LEFT JOIN (SELECT *, ts::HUGEINT * 1000000000000 + id AS k FROM f WHERE cu IS NOT NULL) f ON r.cu = f.cu AND r.k > f.k
),
s AS (
  SELECT *, CASE WHEN found IS NULL THEN 'no_response' WHEN tag IS NOT NULL THEN CASE WHEN tag = f_tag THEN 'resolved' ELSE 'mismatch' END
                 WHEN modified IS NOT NULL AND f_modified IS NOT NULL THEN CASE WHEN modified = f_modified THEN 'resolved' ELSE 'mismatch' END
                 WHEN digest IS NOT NULL THEN CASE WHEN digest = f_tag THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS status
  FROM m
)
SELECT id AS record_id, cu AS canonical_url, found AS response_id, status,
       CASE WHEN status IN ('resolved', 'unverified') THEN 'content-type=text/html;date=' || ts || ';etag=' || f_tag || ';vary=accept'
            ELSE 'date=' || ts || ';server=crawl;vary=accept' END AS headers
FROM s
"""

_DECONTAMINATION_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
iw AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
),
pos AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
hit AS (
  SELECT p.k, p.i, win.m, win.item
  FROM (SELECT k, i, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM pos, (SELECT DISTINCT m FROM win) WHERE i + m - 1 <= len(w)) p
  JOIN win ON win.m = p.m AND win.s = p.s
),
n AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + m)) AS j FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n USING (k) LEFT JOIN items USING (k)
"""

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_LISTED_ROWS = ", ".join(f"('{h}')" for h in LISTED_HOSTS)
_URL_SQL = rf"""
WITH r(verdict, h, p) AS (VALUES {_RULE_ROWS}),
g AS (
  SELECT row_number() OVER () AS k, page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages
),
n AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), CASE WHEN url ILIKE 'http://%' THEN ':80$' WHEN url ILIKE 'https://%' THEN ':443$' ELSE '^$' END, '') AS root FROM g
),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN root || regexp_replace(path, '/$', '')
                 || regexp_replace(regexp_replace(query, '(^\?|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '?') ELSE url END AS cu FROM n
),
listed(u) AS (
  SELECT * FROM (VALUES {_LISTED_ROWS}) UNION SELECT cu FROM c WHERE starts_with(md5(cu), '0') UNION SELECT cu || '/absent' FROM c WHERE starts_with(md5(cu), '1')
),
best AS (
  SELECT k, r.verdict, r.h || r.p AS rule,
         row_number() OVER (PARTITION BY k ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.verdict DESC) AS n
  FROM g JOIN r ON (g.host = r.h OR ends_with(g.host, '.' || r.h)) AND starts_with(g.path, r.p)
)
SELECT page_id, host, path, rule,
       coalesce(best.verdict, CASE WHEN root IN (SELECT u FROM listed) OR cu IN (SELECT u FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON best.k = c.k AND n = 1
"""

_JOIN_SQL = f"""
WITH RECURSIVE dw AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
sh AS (
  SELECT DISTINCT k, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)
),
n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
met AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE c * 10 >= 8 * (p.n + q.n - c)),
reach(k, r) AS (SELECT k, k FROM dw UNION SELECT reach.k, link.y FROM reach JOIN link ON link.x = reach.r),
ids AS (SELECT reach.k, min(dw.doc_id) AS class_id FROM reach JOIN dw ON dw.k = reach.r GROUP BY reach.k),
deg AS (SELECT x AS k, count(*) AS n_links FROM link GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM dw JOIN ids USING (k) LEFT JOIN deg USING (k)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": _TOPK_SQL,
    "op2_warc_revisit": _REVISIT_SQL,
    "op5_decontamination": _DECONTAMINATION_SQL,
    "op8_ngram_join": _JOIN_SQL,
    "op10_url_filter": _URL_SQL,
}
