"""Registered queries of the embedding library, each beside its SQL.

Vectors come out as one row per component; sequences of ids as their length and the md5
of the comma-joined ids. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.functions import tokens as T
from loomvec.functions import vectors as V
from loomvec.functions.models import Model, ResidueEncoder, loaded
from loomvec.operators import batching, cache, commands, stats
from loomvec.operators.embed import collected, dedup_then_embed, embed, embed_cached, embed_commands, embed_multi, exploded, lookup, not_found
from loomvec.plans import catalog
from loomvec.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODEL = Model("residue", dim=8, max_length=128, pooling="mean", normalize=True)
RAW = Model("raw", dim=8, max_length=128, pooling="mean", normalize=False)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def digest(ids: Column) -> Column:
    return F.md5(F.concat_ws(",", ids.cast("array<string>")))


# --- tokens

_IDS = "list_concat([101::BIGINT], list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT), [102::BIGINT])"
_DIGEST = "md5(array_to_string({0}, ','))"


@query(f"SELECT doc_id, len(i)::BIGINT AS n_ids, {_DIGEST.format('i')} AS ids_md5 FROM (SELECT doc_id, {_IDS} AS i FROM documents)")
def tokenize_codepoint(spark, sf_dir):
    ids = T.codepoint_ids(F.col("text"), None)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(ids).cast("long").alias("n_ids"), digest(ids).alias("ids_md5"))


@query(f"SELECT doc_id, len(i)::BIGINT AS n_ids, {_DIGEST.format('i')} AS ids_md5 FROM (SELECT doc_id, ({_IDS})[1:128] AS i FROM documents)")
def truncate(spark, sf_dir):
    ids = T.codepoint_ids(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(ids).cast("long").alias("n_ids"), digest(ids).alias("ids_md5"))


@query(f"SELECT source, sum(len(({_IDS})[1:128]))::BIGINT AS tokens FROM documents GROUP BY source")
def token_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.size(T.codepoint_ids(F.col("text")))).alias("tokens"))


@query(f"""
WITH t AS (SELECT doc_id, doc_id // 32 AS batch, ({_IDS})[1:128] AS i FROM documents),
w AS (SELECT *, max(len(i)) OVER (PARTITION BY batch)::BIGINT AS width FROM t)
SELECT doc_id, width, {_DIGEST.format("list_resize(i, width, 0)")} AS ids_md5, len(i)::BIGINT AS mask_sum FROM w
""")
def pad_batch(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 32").alias("batch"), T.codepoint_ids(F.col("text")).alias("ids"))
    out = T.pad_batches(docs, "batch", "ids")
    mask_sum = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", F.col("width").cast("long").alias("width"), digest(F.col("input_ids")).alias("ids_md5"), mask_sum.alias("mask_sum"))


@query(f"SELECT doc_id, 128::BIGINT AS width, {_DIGEST.format('list_resize(i, 128, 0)')} AS ids_md5, 128::BIGINT AS mask_sum FROM (SELECT doc_id, ({_IDS})[1:128] AS i FROM documents)")
def pad_output(spark, sf_dir):
    ids, mask = T.pad_output(T.codepoint_ids(F.col("text")), 128)
    total = F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(ids).cast("long").alias("width"), digest(ids).alias("ids_md5"), total.alias("mask_sum"))


@query()
def tokenize_file(spark, sf_dir):
    """Ids of a tokenizer file; a test holds them against the tokenizers library."""
    import public_tokenizers

    model = Model("file", tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), max_length=128)

    @F.arrow_udf("array<long>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            flat, off = loaded(model)[0].encode(texts.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))

    return read(spark, sf_dir, "documents").select("doc_id", ids("text").alias("ids")).select("doc_id", F.size("ids").alias("n_ids"), digest(F.col("ids")).alias("ids_md5"))


# --- vectors

_SUM = "list_sum(list_transform(i, lambda x: (x * (2 * d + 1)) % 31 - 15))"
_MEAN = f"({_SUM}::FLOAT * (1::FLOAT / len(i)::FLOAT)::FLOAT)::FLOAT"


def _pooled(table: str, key: str) -> str:
    return f"SELECT {key}, list_transform(range(8), lambda d: {_MEAN}) AS v FROM (SELECT {key}, ({_IDS})[1:128] AS i FROM {table})"


def _rows(keys: str, vector: str, source: str) -> str:
    return f"SELECT {keys}, unnest(range(len(v)))::INT AS dim, unnest({vector})::DOUBLE AS value FROM ({source})"


_NORM = "(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))))::FLOAT"
_UNIT = f"list_transform(v, lambda x: CASE WHEN {_NORM} = 0 THEN x ELSE (x / {_NORM})::FLOAT END)"


@query(f"SELECT doc_id, d::INT AS dim, {_SUM}::BIGINT AS total FROM (SELECT doc_id, ({_IDS})[1:128] AS i FROM documents), range(8) r(d)")
def encode_mock(spark, sf_dir):
    """Totals of the stand-in model's token values, per dimension."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.codepoint_ids(F.col("text")).alias("ids"))

    @F.arrow_udf("array<long>")
    def totals(ids: pa.Array) -> pa.Array:
        off = ids.offsets.to_numpy()
        values = ResidueEncoder(8).token_vectors(ids.values.to_numpy()[: off[-1]]).astype(np.int64)
        sums = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(values, axis=0)])
        rows = sums[off[1:]] - sums[off[:-1]]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * 8, pa.int32()), pa.array(rows.ravel()))

    return docs.select("doc_id", F.posexplode(totals("ids")).alias("dim", "total"))


@query(_rows("doc_id", "v", _pooled("documents", "doc_id")))
def mean_pool(spark, sf_dir):
    return exploded(embed(read(spark, sf_dir, "documents"), RAW), ["doc_id"])


@query(_rows("doc_id", "v", _pooled("documents", "doc_id")))
def mean_pool_rows(spark, sf_dir):
    """The same from one row per token, without Python: partial sums of small whole numbers are exact."""
    tokens = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.codepoint_ids(F.col("text"))).alias("i"))
    sums = [F.sum((F.col("i") * (2 * d + 1)) % 31 - 15).cast("float") for d in range(8)]
    scale = (F.lit(1.0).cast("float") / F.count("*").cast("float")).cast("float")
    out = tokens.groupBy("doc_id").agg(F.array(*[(x * scale).cast("float") for x in sums]).alias("embedding"))
    return exploded(out, ["doc_id"])


@query(_rows("doc_id", _UNIT, _pooled("documents", "doc_id")))
def embed_batch(spark, sf_dir):
    """The flagship: tokenize, cut, encode, pool and normalize every document."""
    return exploded(embed(read(spark, sf_dir, "documents"), MODEL), ["doc_id"])


@query(_rows("doc_id", _UNIT, _pooled("documents", "doc_id")))
def embed_distinct(spark, sf_dir):
    """The same vectors, each distinct text encoded once."""
    return exploded(dedup_then_embed(read(spark, sf_dir, "documents").select("doc_id", "text"), MODEL), ["doc_id"])


@query(_rows("item_id", _UNIT, _pooled("benchmark", "item_id")))
def embed_single(spark, sf_dir):
    return exploded(embed(read(spark, sf_dir, "benchmark"), MODEL), ["item_id"])


_SCALED = "SELECT vec_id, list_transform(embedding, lambda x: (x * 3.7::FLOAT)::FLOAT) AS v FROM embeddings"


def _scaled(spark, sf_dir) -> DataFrame:
    scaled = F.transform("embedding", lambda x: (x * F.lit(3.7).cast("float")).cast("float"))
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", scaled.alias("scaled"))


@query(_rows("vec_id", _UNIT, _SCALED))
def l2_normalize(spark, sf_dir):
    return exploded(_scaled(spark, sf_dir).select("vec_id", V.l2_normalize(F.col("scaled")).alias("embedding")), ["vec_id"])


@query(_rows("vec_id", "v", _SCALED))
def prepooled_extract(spark, sf_dir):
    return exploded(_scaled(spark, sf_dir).select("vec_id", V.pre_pooled(F.col("scaled")).alias("embedding")), ["vec_id"])


@query()
def f32_encode(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.hex(V.to_f32_bytes("embedding")).alias("bytes_hex"))


@query(_rows("vec_id", "v", "SELECT vec_id, embedding AS v FROM embeddings"))
def f32_roundtrip(spark, sf_dir):
    out = read(spark, sf_dir, "embeddings").select("vec_id", V.from_f32_bytes(V.to_f32_bytes("embedding")).alias("embedding"))
    return exploded(out, ["vec_id"])


_PAIRS = "SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query(f"SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS cosine FROM ({_PAIRS})")
def verify_cosine(spark, sf_dir):
    """Cosine of each vector with the next."""
    v = read(spark, sf_dir, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(f"SELECT count(*) AS n, count_if(list_cosine_similarity(x, y) >= 0.999) AS n_pass FROM (SELECT v::DOUBLE[] AS x, e.embedding::DOUBLE[] AS y FROM ({_SCALED}) s JOIN embeddings e USING (vec_id))")
def verify_tally(spark, sf_dir):
    ok = V.cosine(F.col("scaled"), F.col("embedding")) >= 0.999
    return _scaled(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_pass"))


# --- several models

ROLES = [Model("user", 8, 128), Model("assistant", 8, 64, normalize=False)]
_ROLE_IDS = f"SELECT conv_id, turn, role, ({_IDS})[1:CASE role WHEN 'assistant' THEN 64 ELSE 128 END] AS i FROM conversations"
_ROLE_V = f"SELECT conv_id, turn, role, CASE WHEN role IN ('user', 'assistant') THEN list_transform(range(8), lambda d: {_MEAN}) END AS v FROM ({_ROLE_IDS})"
_ROLE_E = f"SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {_UNIT} ELSE v END AS v FROM ({_ROLE_V})"


def _multi(spark, sf_dir) -> DataFrame:
    return embed_multi(read(spark, sf_dir, "conversations"), ROLES, "role")


def _catalog(spark) -> DataFrame:
    return spark.createDataFrame([(m.name, m.dim, m.max_length, m.pooling, m.normalize) for m in ROLES], "name string, dim int, max_length int, pooling string, normalize boolean")


@query(f"""SELECT conv_id, turn, unnest(CASE WHEN v IS NULL THEN [NULL] ELSE range(8) END)::INT AS dim,
unnest(CASE WHEN v IS NULL THEN [NULL] ELSE v END)::DOUBLE AS value FROM ({_ROLE_E})""")
def embed_pairs(spark, sf_dir):
    """Each turn by the model of its role; turns of roles without a model get null."""
    return exploded(_multi(spark, sf_dir), ["conv_id", "turn"])


@query("SELECT role, count(*) AS n, count_if(role NOT IN ('user', 'assistant') OR role IS NULL) AS n_null FROM conversations GROUP BY role")
def embed_pairs_unknown(spark, sf_dir):
    return _multi(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("n_null"))


@query("SELECT count_if(role IN ('user', 'assistant')) AS n, count_if(role IN ('user', 'assistant')) AS n_same FROM conversations")
def pairs_equal_single(spark, sf_dir):
    """Vectors of mixed rows are byte-identical to those of each model's rows alone."""
    both = _multi(spark, sf_dir).where("embedding is not null")
    single = None
    for m in ROLES:
        mine = embed(both.where(F.col("role") == m.name), m, out="alone")
        single = mine if single is None else single.unionByName(mine)
    return single.agg(F.count("*").alias("n"), F.count_if(V.same_bytes(V.to_f32_bytes("embedding"), V.to_f32_bytes("alone"))).alias("n_same"))


@query("SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN 'ok' ELSE 'ERR model ''' || coalesce(role, '') || ''' not found' END AS status FROM conversations")
def model_lookup(spark, sf_dir):
    out = lookup(read(spark, sf_dir, "conversations"), _catalog(spark), "role")
    return out.select("conv_id", "turn", F.when(F.col("registered"), "ok").otherwise(not_found(F.col("role"))).alias("status"))


# --- commands


_COMMAND_ROWS = """
SELECT doc_id, doc_id // 32 AS command, CASE WHEN doc_id // 32 % 5 = 0 THEN 'missing' ELSE 'raw' END AS model, CASE WHEN doc_id % 320 <> 70 THEN text END AS text FROM documents
"""


def _command_rows(spark, sf_dir) -> DataFrame:
    """Documents as commands of 32 texts; every fifth names a model that is not there, some have a null text."""
    command = F.expr("doc_id div 32")
    return read(spark, sf_dir, "documents").select("doc_id", command.alias("command"), F.when(command % 5 == 0, "missing").otherwise("raw").alias("model"), F.when(F.col("doc_id") % 320 != 70, F.col("text")).alias("text"))


@query(f"""
WITH r AS ({_COMMAND_ROWS}),
e AS (SELECT command, count(*) AS n, arg_min(CASE WHEN model = 'missing' THEN 'ERR model ''missing'' not found' WHEN text IS NULL THEN 'ERR text is null' END, doc_id)
      FILTER (WHERE model = 'missing' OR text IS NULL) AS error FROM r GROUP BY command)
SELECT command, n, error, CASE WHEN error IS NULL THEN n ELSE 0 END AS n_vectors FROM e
""")
def command_errors(spark, sf_dir):
    """A command is all or nothing: one bad row's error is the command's."""
    out = embed_commands(_command_rows(spark, sf_dir), [RAW], "command", "doc_id")
    return out.groupBy("command").agg(F.count("*").alias("n"), F.first("error").alias("error"), F.count("embedding").alias("n_vectors"))


@query(f"""
WITH e AS (SELECT doc_id, doc_id // 32 AS command, v FROM ({_pooled('documents', 'doc_id')}))
SELECT command, (row_number() OVER (PARTITION BY command ORDER BY doc_id) - 1)::INT AS pos, v[1]::DOUBLE AS first_value FROM e
""")
def command_vectors(spark, sf_dir):
    """Each command's vectors back in the order of its texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 32").alias("command"), "text")
    out = collected(embed(docs, RAW), "command", "doc_id", "embedding")
    return out.select("command", F.posexplode("vectors").alias("pos", "v")).select("command", "pos", F.get("v", F.lit(0)).cast("double").alias("first_value"))


# --- cache


_OLD = "SELECT text, any_value(v) AS v FROM (SELECT text, list_transform(v, lambda x: (x * 2::FLOAT)::FLOAT) AS v FROM documents JOIN (" + _pooled("documents", "doc_id") + ") USING (doc_id) WHERE source = 'src0') GROUP BY text"


@query(_rows("doc_id, hit", "v", f"SELECT doc_id, o.v IS NOT NULL AS hit, coalesce(o.v, p.v) AS v FROM documents d JOIN ({_pooled('documents', 'doc_id')}) p USING (doc_id) LEFT JOIN ({_OLD}) o ON o.text = d.text"))
def embed_with_cache(spark, sf_dir):
    """Texts of one source come from the cache (marked by doubled values), the rest is encoded; places are kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    old = embed(docs.where("source = 'src0'"), RAW).withColumns({"model": F.lit(RAW.name), "embedding": F.transform("embedding", lambda x: (x * F.lit(2.0).cast("float")).cast("float"))})
    return exploded(embed_cached(docs, old, RAW), ["doc_id", "hit"])


@query("""
WITH h AS (SELECT event_type, min(event_id) OVER (PARTITION BY event_type, user_id) < event_id AS hit FROM events)
SELECT event_type, count_if(hit) AS hits, count_if(NOT hit) AS misses FROM h GROUP BY event_type
""")
def cache_hits_unbounded(spark, sf_dir):
    log = cache.unbounded_hits(read(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], "event_id")
    return log.groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("""
WITH c AS (SELECT DISTINCT text FROM documents WHERE source = 'src0')
SELECT doc_id // 32 AS command, count_if(c.text IS NOT NULL) AS hits, count_if(c.text IS NULL) AS misses
FROM documents d LEFT JOIN c USING (text) GROUP BY 1
""")
def cache_partial_hit(spark, sf_dir):
    """Commands of 32 texts against a cache that holds one source's texts."""
    docs = read(spark, sf_dir, "documents")
    out = cache.split_by_cache(docs.select("doc_id", "text"), docs.where("source = 'src0'"), ["text"])
    return out.groupBy(F.expr("doc_id div 32").alias("command")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("""
SELECT count(*) AS entries, sum(octet_length(encode(k)) + 32 + 48)::BIGINT AS bytes
FROM (SELECT DISTINCT source || ':' || text AS k FROM documents)
""")
def cache_bytes(spark, sf_dir):
    keys = read(spark, sf_dir, "documents").select(cache.cache_key(F.col("source"), F.col("text")).alias("k")).distinct()
    return keys.agg(F.count("*").alias("entries"), F.sum(cache.entry_bytes(F.col("k"), F.lit(4 * MODEL.dim))).cast("long").alias("bytes"))


@query("""
WITH h AS (SELECT event_type, min(event_id) OVER (PARTITION BY event_type, user_id) < event_id AS hit FROM events)
SELECT event_type, printf('%.1f%%', count_if(hit) * 100 / count(*)) AS hit_rate FROM h GROUP BY event_type
""")
def cache_hit_rate(spark, sf_dir):
    log = cache.unbounded_hits(read(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], "event_id")
    return log.groupBy("event_type").agg(cache.hit_rate(F.count_if("hit"), F.count("*")).alias("hit_rate"))


@query("SELECT doc_id, md5(source || ':' || text) AS key_md5 FROM documents")
def cache_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(cache.cache_key(F.col("source"), F.col("text"))).alias("key_md5"))


LRU_ENTRIES = 40


@query(f"""
WITH e AS (SELECT event_type, event_id, user_id, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS prev FROM events),
d AS (
  SELECT a.event_type, a.event_id, count(DISTINCT b.user_id) AS between_
  FROM e a JOIN events b ON b.event_type = a.event_type AND b.event_id > a.prev AND b.event_id < a.event_id GROUP BY ALL
)
SELECT e.event_type, e.event_id, e.prev IS NOT NULL AND coalesce(between_, 0) < {LRU_ENTRIES} AS hit
FROM e LEFT JOIN d USING (event_type, event_id)
""")
def lru_simulate(spark, sf_dir):
    """One cache per event type with room for 40 entries of equal size."""
    log = read(spark, sf_dir, "events").select("event_type", "event_id", F.lpad(F.col("user_id").cast("string"), 9, "0").alias("key"), F.lit(32).alias("bytes"))
    out = cache.simulate_lru(log, "event_type", "event_id", "key", "bytes", LRU_ENTRIES * (9 + 32 + cache.ENTRY_COST))
    return out.select("event_type", "event_id", "hit")


SIZES = ["", "512MB", "1.5gb", "64 KB", "invalid", "auto", "0", "12", "-5MB", "7tb", "64KiB", "1GiB", "2 m", "12ib", "3p", "9 B"]
_SIZES = ", ".join(f"('{s}')" for s in SIZES)


@query(f"""
WITH t(s) AS (VALUES {_SIZES}),
p AS (SELECT s, regexp_extract(lower(trim(s)), '^([0-9]+(?:\\.[0-9]+)?) ?(b|[kmgtp](?:b|ib)?)?$', ['n', 'u']) AS x FROM t),
v AS (SELECT s, (try_cast(x.n AS DOUBLE) * CASE left(x.u, 1) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'g' THEN 1e9 WHEN 't' THEN 1e12 WHEN 'p' THEN 1e15 ELSE 1 END)::BIGINT AS b FROM p)
SELECT s AS size, CASE WHEN s = '' THEN 0 WHEN s = 'auto' THEN 524288000 WHEN b > 0 THEN b END::BIGINT AS bytes FROM v
""")
def parse_size(spark, sf_dir):
    sizes = spark.createDataFrame([(s,) for s in SIZES], "size string")
    return sizes.select("size", cache.parse_size(F.col("size"), cache.autotune_cache(F.lit(32 * 1024**3))).alias("bytes"))


MEMORIES = [0, 256 * 1024**2, 1024**3, 4 * 1024**3, 64 * 1024**3]
_MEMORIES = ", ".join(f"({m}::BIGINT)" for m in MEMORIES)


@query(f"""
SELECT m AS memory, CASE WHEN m = 0 THEN 104857600
ELSE least(greatest(floor((m - m // 10 - m // 4) * 0.2::DOUBLE), 67108864), 524288000) END::BIGINT AS bytes FROM (VALUES {_MEMORIES}) t(m)
""")
def autotune_cache(spark, sf_dir):
    return spark.createDataFrame([(m,) for m in MEMORIES], "memory long").select("memory", cache.autotune_cache(F.col("memory")).alias("bytes"))


@query(f"""
SELECT m AS memory, s AS model_bytes, CASE WHEN m = 0 OR s IS NULL THEN 8 ELSE least(greatest((m // 2) // (s + s // 5), 1), 8) END::BIGINT AS workers
FROM (VALUES {_MEMORIES}) t(m), (VALUES (90000000::BIGINT), (1100000000), (NULL)) u(s)
""")
def autotune_workers(spark, sf_dir):
    rows = spark.createDataFrame([(m, s) for m in MEMORIES for s in (90_000_000, 1_100_000_000, None)], "memory long, model_bytes long")
    return rows.select("memory", "model_bytes", cache.autotune_workers(F.col("memory"), F.col("model_bytes"), F.lit(8)).alias("workers"))


# --- batches and statistics over the event log

TIMEOUT_US, MAX_BATCH = 3 * 3600 * 10**6, 8


def _timed(spark, sf_dir) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_type", "event_id", at.alias("at"))


@query(f"""
WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
w AS (
  SELECT event_type, event_id, n, t AS start, 1 AS place, 1 AS win FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_type, e.event_id, e.n,
         CASE WHEN w.place >= {MAX_BATCH} OR e.t - w.start >= {TIMEOUT_US} THEN e.t ELSE w.start END,
         CASE WHEN w.place >= {MAX_BATCH} OR e.t - w.start >= {TIMEOUT_US} THEN 1 ELSE w.place + 1 END,
         CASE WHEN w.place >= {MAX_BATCH} OR e.t - w.start >= {TIMEOUT_US} THEN w.win + 1 ELSE w.win END
  FROM w JOIN e ON e.event_type = w.event_type AND e.n = w.n + 1
)
SELECT event_type, win::BIGINT AS window_id, count(*) AS n, min(event_id) AS first_event, max(place)::BIGINT = {MAX_BATCH} AS by_count FROM w GROUP BY event_type, win
""")
def microbatch_windows(spark, sf_dir):
    out = batching.microbatch_windows(_timed(spark, sf_dir), "event_type", "event_id", "at", TIMEOUT_US, MAX_BATCH)
    return out.groupBy("event_type", F.col("window").alias("window_id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), (F.max("place") == MAX_BATCH).alias("by_count"))


@query("SELECT event_type, event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 4)::INT AS worker FROM events")
def round_robin(spark, sf_dir):
    return batching.round_robin(read(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 4)


_LOG = "SELECT event_type AS model, event_id, user_id, floor(abs(value) * 1000)::BIGINT AS latency_us, length(props)::BIGINT AS tokens, event_id % 97 = 0 AS failed FROM events"


def _log(spark, sf_dir) -> DataFrame:
    """The event log as requests: type as model, value as latency, every 97th failed."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), "event_id", "user_id", F.floor(F.abs("value") * 1000).cast("long").alias("latency_us"),
        F.length("props").cast("long").alias("tokens"), (F.col("event_id") % 97 == 0).alias("failed"),
    )


_PER_MODEL = f"SELECT model, count(*) AS requests, sum(tokens)::BIGINT AS tokens, count_if(failed) AS errors, floor(sum(latency_us) / count(*))::BIGINT AS avg_latency_us FROM ({{0}}) GROUP BY model"


@query(_PER_MODEL.format(_LOG))
def stats_per_model(spark, sf_dir):
    return stats.per_model(_log(spark, sf_dir))


@query(f"""
WITH l AS (SELECT *, (row_number() OVER (PARTITION BY model ORDER BY event_id) - 1) // {MAX_BATCH} AS batch FROM ({_LOG})),
b AS (SELECT model, batch, count(*) AS n, max(latency_us) AS took, bool_or(failed) AS failed FROM l GROUP BY ALL)
SELECT model, sum(n)::BIGINT AS requests, count(*) AS batches, count_if(failed) AS errors, floor(sum(took) / sum(n))::BIGINT AS avg_latency_us FROM b GROUP BY model
""")
def stats_batched_latency(spark, sf_dir):
    log = batching.numbered(_log(spark, sf_dir), "model", "event_id", "place").withColumn("batch", F.floor(F.col("place") / MAX_BATCH))
    return stats.per_model_batched(log)


_MISSES = f"SELECT * FROM (SELECT *, min(event_id) OVER (PARTITION BY model, user_id) < event_id AS hit FROM ({_LOG})) WHERE NOT hit"


@query(_PER_MODEL.format(_MISSES))
def stats_with_cache(spark, sf_dir):
    """Hits reach no model and count nowhere."""
    return stats.per_model(cache.unbounded_hits(_log(spark, sf_dir), ["model", "user_id"], "event_id").where(~F.col("hit")))


BUDGET = 500 * 10**6
_HIT_LOG = f"SELECT *, min(event_id) OVER (PARTITION BY model, user_id) < event_id AS hit FROM ({_LOG})"
_TOTALS = f"""SELECT count_if(hit) AS hits, count_if(NOT hit) AS misses, sum(CASE WHEN NOT hit THEN octet_length(encode(model || ':' || user_id)) + 32 + 48 END)::BIGINT AS used FROM ({_HIT_LOG})"""
_SERVED = "SELECT DISTINCT event_type AS name, 8 * length(event_type) AS dim, 128 AS max_length, 4 AS workers, 'mean' AS pooling, event_type < 'k' AS normalize, length(event_type) % 3 AS timeout, 32 AS max_batch FROM events"


def _cache_totals(spark, sf_dir) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("key", cache.cache_key(F.col("model"), F.col("user_id").cast("string")))
    return cache.cache_totals(log, "key", "event_id", F.lit(4 * MODEL.dim), BUDGET)


def _served(spark, sf_dir) -> DataFrame:
    """The event log's models with settings that follow from their names."""
    name = F.col("event_type")
    out = read(spark, sf_dir, "events").select(name.alias("name")).distinct()
    return out.select("name", (8 * F.length("name")).alias("dim"), F.lit(128).alias("max_length"), F.lit(4).alias("workers"), F.lit("mean").alias("pooling"), (F.col("name") < "k").alias("normalize"), (F.length("name") % 3).alias("batch_timeout_ms"), F.lit(32).alias("max_batch"))


def _counters(spark, sf_dir) -> DataFrame:
    return stats.per_model(cache.unbounded_hits(_log(spark, sf_dir), ["model", "user_id"], "event_id").where(~F.col("hit")))


@query(f"SELECT hits, misses, 0::BIGINT AS evictions, misses AS entries, {BUDGET}::BIGINT AS max_bytes, used AS memory_bytes FROM ({_TOTALS})")
def cache_totals(spark, sf_dir):
    return _cache_totals(spark, sf_dir)


@query(f"""
WITH m AS ({_PER_MODEL.format(_MISSES)}),
l AS (SELECT m.*, model || ': req=' || requests || ' avg=' || avg_latency_us || 'us tok=' || tokens || ' err=' || errors || ' mem=0mb pool=mean norm=' || normalize
             || CASE WHEN timeout > 0 THEN ' batch=' || timeout || '/' || max_batch ELSE '' END AS line FROM m JOIN ({_SERVED}) s ON s.name = m.model),
t AS (SELECT sum(requests) AS r, sum(tokens) AS k, sum(errors) AS e, count(*) AS n, string_agg(line, ' | ' ORDER BY line) AS s FROM l),
u AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS up FROM events)
SELECT unnest(['uptime_secs', 'total_requests', 'active_requests', 'total_tokens', 'total_errors', 'models_loaded', 'per_model', 'cache_hits', 'cache_misses', 'cache_evictions']) AS key,
       unnest([up::VARCHAR, r::VARCHAR, '0', k::VARCHAR, e::VARCHAR, n::VARCHAR, s, c.hits::VARCHAR, c.misses::VARCHAR, '0']) AS value FROM t, u, ({_TOTALS}) c
""")
def server_stats(spark, sf_dir):
    """Totals of the models that the log's misses reached, the log's span as uptime, and the cache's counters."""
    settings = _served(spark, sf_dir).withColumnRenamed("name", "model")
    line = stats.stats_line(F.col("pooling"), F.col("normalize").cast("string"), F.col("batch_timeout_ms"), F.col("max_batch"))
    models = _counters(spark, sf_dir).join(F.broadcast(settings), "model").withColumn("line", line)
    uptime = stats.uptime_secs(read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts")), "ts")
    return stats.server_stats(models, uptime, _cache_totals(spark, sf_dir))


# --- catalog and introspection

CONFIGS = [
    ("a", None, None, None, None, None, None, None, '{"max_position_embeddings": 256}'),
    ("b", 64, 16, "last_hidden_state", None, True, -4, 0, None),
    ("c", None, 0, "missing", None, None, 3, 7, '{"other": 1}'),
    ("d", None, None, None, "mean", None, None, None, "not json"),
]
CONFIG_SCHEMA = "name string, max_length long, dim long, output_tensor string, pooling string, normalize boolean, batch_timeout_ms long, max_batch long, config_json string"
OUTPUTS = [("a", "last_hidden_state", 3, 384), ("a", "pooler_output", 2, 384), ("b", "last_hidden_state", 3, 768), ("b", "sentence_embedding", 2, 768), ("c", "z", 3, 12), ("c", "y", 3, 10)]
_OUTPUTS = ", ".join(f"('{m}', '{n}', {r}, {d}::BIGINT)" for m, n, r, d in OUTPUTS)


def _outputs(spark) -> DataFrame:
    return spark.createDataFrame(OUTPUTS, "model string, name string, rank int, dim long")


@query(f"""
WITH o(model, name, rank, dim) AS (VALUES {_OUTPUTS}),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY CASE rank WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END, name) AS n FROM o)
SELECT model, name, rank::INT AS rank, dim FROM r WHERE n = 1
""")
def select_output_tensor(spark, sf_dir):
    return catalog.select_output(_outputs(spark))


@query("SELECT rank::INT AS rank, CASE rank WHEN 2 THEN 'none' ELSE 'mean' END AS pooling FROM (VALUES (2), (3), (4)) t(rank)")
def pooling_for_rank(spark, sf_dir):
    return spark.createDataFrame([(2,), (3,), (4,)], "rank int").select("rank", catalog.pooling_for_rank(F.col("rank")).alias("pooling"))


_CONFIGS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in CONFIGS)
_CONFIG_ROWS = f"SELECT * FROM (VALUES {_CONFIGS}) c(name, max_length, dim, output_tensor, pooling, normalize, batch_timeout_ms, max_batch, config_json)"
_FILE_LENGTH = "try_cast(json_extract_string(CASE WHEN json_valid(config_json) THEN config_json END, '$.max_position_embeddings') AS BIGINT)"


@query(f"SELECT name, CASE WHEN {_FILE_LENGTH} > 0 THEN {_FILE_LENGTH} END AS max_length FROM ({_CONFIG_ROWS})")
def infer_max_length(spark, sf_dir):
    return spark.createDataFrame(CONFIGS, CONFIG_SCHEMA).select("name", catalog.max_length_of(F.col("config_json")).alias("max_length"))


@query(f"""
WITH o(model, name, rank, dim) AS (VALUES {_OUTPUTS}),
a AS (SELECT model, arg_min(name, CASE rank WHEN 2 THEN '0' WHEN 3 THEN '1' ELSE '2' END || name) AS name FROM o GROUP BY model),
j AS (
  SELECT c.*, coalesce(mine.name, best.name) AS tensor, coalesce(mine.rank, best.rank) AS rank, coalesce(mine.dim, best.dim) AS file_dim
  FROM ({_CONFIG_ROWS}) c LEFT JOIN o mine ON mine.model = c.name AND mine.name = c.output_tensor
  LEFT JOIN a ON a.model = c.name LEFT JOIN o best ON best.model = a.model AND best.name = a.name
)
SELECT name, coalesce(CASE WHEN max_length > 0 THEN max_length END, CASE WHEN {_FILE_LENGTH} > 0 THEN {_FILE_LENGTH} END, 512)::BIGINT AS max_length,
       coalesce(CASE WHEN dim > 0 THEN dim END, file_dim, 0)::BIGINT AS dim, coalesce(tensor, 'last_hidden_state') AS output_tensor,
       coalesce(pooling, CASE rank WHEN 2 THEN 'none' ELSE 'mean' END) AS pooling, coalesce(normalize::BOOLEAN, false) AS normalize,
       CASE WHEN batch_timeout_ms < 0 THEN 1 ELSE coalesce(batch_timeout_ms, 0) END::BIGINT AS batch_timeout_ms,
       coalesce(CASE WHEN max_batch > 0 THEN max_batch END, 32)::BIGINT AS max_batch FROM j
""")
def catalog_resolve(spark, sf_dir):
    return catalog.resolve(spark.createDataFrame(CONFIGS, CONFIG_SCHEMA), _outputs(spark))


@query(f"""
SELECT name, coalesce(CASE WHEN name = 'c' THEN 99 WHEN max_length > 0 THEN max_length END, 0)::BIGINT AS max_length FROM ({_CONFIG_ROWS})
UNION ALL SELECT 'e', 5
""")
def catalog_upsert(spark, sf_dir):
    """A model's new settings replace the old ones; a new model is added."""
    old = spark.createDataFrame(CONFIGS, CONFIG_SCHEMA).select("name", F.coalesce(F.when(F.col("max_length") > 0, F.col("max_length")), F.lit(0).cast("long")).alias("max_length"))
    return catalog.upsert(old, spark.createDataFrame([("c", 99), ("e", 5)], "name string, max_length long"))


LISTINGS = [
    ("r1", ["config.json", "onnx/model.onnx", "model.onnx"]),
    ("r2", ["onnx/model.onnx", "a.onnx"]),
    ("r3", ["onnx/q8.onnx", "b.onnx", "readme.md"]),
    ("r4", ["readme.md"]),
]


@query(f"SELECT name, CASE WHEN timeout > 0 THEN 'batcher' ELSE 'workers' END AS mode, CASE WHEN timeout > 0 THEN 1 ELSE workers END::BIGINT AS sessions FROM ({_SERVED})")
def execution_mode(spark, sf_dir):
    return batching.execution(_served(spark, sf_dir)).select("name", "mode", "sessions")


_LISTINGS = ", ".join(f"('{r}', {names})" for r, names in LISTINGS)


@query(f"""
WITH f AS (SELECT repo, unnest(files) AS path FROM (VALUES {_LISTINGS}) t(repo, files))
SELECT repo, coalesce(max(path) FILTER (WHERE path = 'model.onnx'), max(path) FILTER (WHERE path = 'onnx/model.onnx'), min(path)) AS path
FROM f WHERE ends_with(path, '.onnx') GROUP BY repo
""")
def repo_file_pick(spark, sf_dir):
    import json

    rows = [(r, json.dumps({"siblings": [{"rfilename": f, "size": 1} for f in names]})) for r, names in LISTINGS]
    return files.pick_model_file(spark.createDataFrame(rows, "repo string, json string"))


_STATUS = """SELECT m.name, m.dim, CASE WHEN m.name IN (SELECT role FROM conversations) THEN 'ready' ELSE 'registered' END AS status
FROM (VALUES ('user', 8::INT), ('assistant', 8), ('narrator', 16)) m(name, dim)"""


def _with_status(spark, sf_dir) -> DataFrame:
    """The roles' models and one that no turn asks for, with their states."""
    known = catalog.upsert(_catalog(spark).select("name", "dim"), spark.createDataFrame([("narrator", 16)], "name string, dim int"))
    return catalog.with_status(known, read(spark, sf_dir, "conversations"), "role")


@query(_STATUS)
def models(spark, sf_dir):
    return _with_status(spark, sf_dir).select("name", "dim", "status")


@query(f"SELECT count(*) AS total, count_if(status = 'ready') AS loaded FROM ({_STATUS})")
def models_loaded(spark, sf_dir):
    return catalog.loaded_counts(_with_status(spark, sf_dir))


@query(f"""
WITH m AS ({_PER_MODEL.format(_MISSES)})
SELECT s.name AS model,
       unnest(['dim', 'max_length', 'workers', 'requests', 'avg_latency_us', 'tokens', 'errors', 'pooling', 'normalize', 'batching_timeout_ms', 'batching_max_batch', 'cache_hits', 'cache_misses',
               'cache_hit_rate', 'cache_evictions', 'cache_entries', 'cache_max_bytes', 'cache_memory_bytes']) AS key,
       unnest([s.dim::VARCHAR, s.max_length::VARCHAR, s.workers::VARCHAR, m.requests::VARCHAR, m.avg_latency_us::VARCHAR, m.tokens::VARCHAR, m.errors::VARCHAR, s.pooling, s.normalize::VARCHAR,
               s.timeout::VARCHAR, s.max_batch::VARCHAR, c.hits::VARCHAR, c.misses::VARCHAR, printf('%.1f%%', c.hits * 100 / (c.hits + c.misses)), '0', c.misses::VARCHAR, '{BUDGET}', c.used::VARCHAR]) AS value
FROM ({_SERVED}) s JOIN m ON m.model = s.name, ({_TOTALS}) c
""")
def info(spark, sf_dir):
    """Eleven settings and counters of each model of the event log, and seven of the cache."""
    return stats.model_info(_served(spark, sf_dir), _counters(spark, sf_dir), _cache_totals(spark, sf_dir))


STATES = [("loading", 0), ("loading", 2), ("ready", 0), ("ready", 2), ("draining", 2)]


@query("SELECT s AS state, n::INT AS n_models, CASE WHEN s = 'loading' AND n = 0 THEN 'no models' WHEN s = 'ready' THEN 'OK' ELSE s END AS reply FROM (VALUES ('loading', 0), ('loading', 2), ('ready', 0), ('ready', 2), ('draining', 2)) t(s, n)")
def readiness(spark, sf_dir):
    return spark.createDataFrame(STATES, "state string, n_models int").select("state", "n_models", commands.readiness(F.col("state"), F.col("n_models")).alias("reply"))


@query("""
WITH d(c, n, x) AS (VALUES ('embed', 3, true), ('embed.multi', 3, true), ('ping', 1, true), ('embed', 3, false))
SELECT c AS command, x AS draining, x AND c IN ('embed', 'embed.multi') AS rejected FROM d
""")
def draining(spark, sf_dir):
    rows = spark.createDataFrame([("embed", True), ("embed.multi", True), ("ping", True), ("embed", False)], "command string, draining boolean")
    return rows.select("command", "draining", commands.drained(F.col("command"), F.col("draining")).alias("rejected"))


# the log as commands: one connection per user, the event type says which command
_COMMANDS = """
SELECT event_id, user_id, CASE event_id % 7 WHEN 0 THEN ['PING'] WHEN 1 THEN ['Auth', CASE WHEN event_id % 2 = 0 THEN 'secret' ELSE 'wrong' END] WHEN 2 THEN ['auth']
  WHEN 3 THEN ['EMBED', event_type] WHEN 4 THEN ['embed', event_type, props] WHEN 5 THEN ['embed.multi', 'm', 't', 'm'] ELSE ['nonsense', 'x'] END AS args FROM events
"""


def _commands(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 7
    word = F.when(F.col("event_id") % 2 == 0, "secret").otherwise("wrong")
    args = F.when(k == 0, F.array(F.lit("PING"))).when(k == 1, F.array(F.lit("Auth"), word)).when(k == 2, F.array(F.lit("auth")))
    args = args.when(k == 3, F.array(F.lit("EMBED"), "event_type")).when(k == 4, F.array(F.lit("embed"), "event_type", "props"))
    args = args.when(k == 5, F.array(*map(F.lit, ("embed.multi", "m", "t", "m")))).otherwise(F.array(F.lit("nonsense"), F.lit("x")))
    return read(spark, sf_dir, "events").select("event_id", "user_id", args.alias("args"))


_KNOWN = ", ".join(f"'{k}'" for k in commands.HELP)


@query(f"SELECT event_id, lower(args[1]) AS command, lower(args[1]) IN ({_KNOWN}) AS known, len(args)::INT AS n_args FROM ({_COMMANDS})")
def command_log_parse(spark, sf_dir):
    return commands.parsed(_commands(spark, sf_dir)).select("event_id", "command", "known", "n_args")


@query(f"""
SELECT event_id, CASE WHEN (c = 'embed' AND n < 3) OR (c = 'info' AND n < 2) OR (c = 'auth' AND n <> 2) OR (c = 'embed.multi' AND (n < 3 OR n % 2 = 0))
  THEN 'ERR wrong number of arguments for ''' || upper(c) || ''' command' END AS error
FROM (SELECT event_id, lower(args[1]) AS c, len(args) AS n FROM ({_COMMANDS}))
""")
def arity_validate(spark, sf_dir):
    out = commands.parsed(_commands(spark, sf_dir))
    return out.select("event_id", commands.arity_error(F.col("command"), F.col("n_args")).alias("error"))


@query(f"""
WITH p AS (SELECT event_id, user_id, lower(args[1]) AS c, len(args) AS n, args[2] AS g FROM ({_COMMANDS})),
a AS (SELECT *, CASE WHEN c = 'auth' THEN CASE WHEN n <> 2 THEN 'ERR wrong number of arguments for ''AUTH'' command' WHEN g <> 'secret' THEN 'ERR invalid password' ELSE 'OK' END END AS mine FROM p),
o AS (SELECT *, coalesce(bool_or(coalesce(mine = 'OK', false)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS opened FROM a)
SELECT event_id, CASE WHEN c NOT IN ('auth', 'ping', 'ready') AND NOT opened THEN 'NOAUTH Authentication required.' ELSE mine END AS reply FROM o
""")
def auth_gate(spark, sf_dir):
    return commands.auth_gate(_commands(spark, sf_dir), "user_id", "event_id", "secret").select("event_id", "reply")


@query("""
SELECT conv_id, turn, CASE WHEN text IS NULL THEN '$-1' || chr(13) || chr(10) WHEN role = 'user' THEN '+' || text || chr(13) || chr(10)
  ELSE '$' || octet_length(encode(text)) || chr(13) || chr(10) || text || chr(13) || chr(10) END AS reply FROM conversations
""")
def wire_encode(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "status").otherwise("bulk")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", files.wire_reply(kind, F.col("text")).alias("reply"))


@query("""
SELECT conv_id, CASE WHEN count(*) = 1 THEN any_value(b) ELSE '*' || count(*) || chr(13) || chr(10) || string_agg(b, '' ORDER BY turn) END AS reply
FROM (SELECT conv_id, turn, CASE WHEN text IS NULL THEN '$-1' || chr(13) || chr(10) ELSE '$' || octet_length(encode(text)) || chr(13) || chr(10) || text || chr(13) || chr(10) END AS b FROM conversations)
GROUP BY conv_id
""")
def wire_array(spark, sf_dir):
    """The texts of a conversation as one reply: a bulk, or an array of them."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: t["text"]).alias("texts"))
    return rows.select("conv_id", files.wire_texts(F.col("texts")).alias("reply"))


_HELP = ", ".join(f"('{k}', '{v}')" for k, v in commands.HELP.items())


@query(f"""
SELECT h.command, h.line, count(c.event_id) AS uses FROM (VALUES {_HELP}) h(command, line)
LEFT JOIN (SELECT event_id, lower(args[1]) AS command FROM ({_COMMANDS})) c USING (command) GROUP BY ALL
""")
def help_lines(spark, sf_dir):
    """Each command's line of help and how often the log has it."""
    lines = spark.createDataFrame(list(commands.HELP.items()), "command string, line string")
    uses = commands.parsed(_commands(spark, sf_dir)).groupBy("command").agg(F.count("*").alias("uses"))
    return lines.join(uses, "command", "left").fillna(0, ["uses"])


@query(f"SELECT event_id, 'PONG' AS reply FROM ({_COMMANDS}) WHERE lower(args[1]) = 'ping'")
def ping(spark, sf_dir):
    return commands.parsed(_commands(spark, sf_dir)).where("command = 'ping'").select("event_id", F.lit("PONG").alias("reply"))
