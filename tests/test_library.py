"""The embedding library: functions, operators, catalog, cache, batches, streams, wire."""

from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomvec.client import Client
from loomvec.functions import models as M
from loomvec.functions import tokens as T
from loomvec.functions import vectors as V
from loomvec.operators import batching, cache, commands, embed
from loomvec.plans import catalog, queries
from loomvec.sources import files
from loomvec.streaming.microbatch import drain, stream_windows, windowed_counters

DUCK = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def one(df):
    return df.first()[0]


# --- functions


def test_padding_fills_to_the_longest_of_a_batch(spark):
    rng = np.random.default_rng(20)
    rows = [(int(b), [int(x) for x in rng.integers(1, 900, int(n))]) for b, n in zip(rng.integers(0, 4, 25), rng.integers(0, 12, 25), strict=True)] + [(9, [])]
    longest = {b: max(len(i) for c, i in rows if c == b) for b, _ in rows}
    out = T.pad_batches(spark.createDataFrame(rows, "batch int, ids array<long>"), "batch", "ids").collect()
    assert len(out) == len(rows)
    for r in out:
        rest = longest[r.batch] - len(r.ids)
        assert (r.width, r.input_ids, r.attention_mask) == (longest[r.batch], r.ids + [0] * rest, [1] * len(r.ids) + [0] * rest)


@pytest.mark.parametrize("seed", range(4))
def test_mean_pool(spark, seed):
    rng = np.random.default_rng(seed)
    hidden = rng.integers(-40, 40, (6, 5)).astype(np.float32)
    mask = rng.integers(0, 2, 6) if seed else np.zeros(6, int)
    total, n = np.zeros(5, np.float32), int(mask.sum())
    for row, m in zip(hidden, mask, strict=True):
        if m:
            total = total + row
    want = total * (np.float32(1) / np.float32(n)) if n else total * 0
    df = spark.createDataFrame([(hidden.tolist(), mask.tolist())], "h array<array<float>>, m array<int>")
    assert one(df.select(V.mean_pool(F.col("h"), F.col("m")))) == want.tolist()


@pytest.mark.parametrize(("v", "want"), [([3, 0, 4], [0.6, 0, 0.8]), ([0, 0, 0], [0, 0, 0]), ([1, 2, 3, 4, 5], None)])
def test_l2_normalize(spark, v, want):
    got = one(spark.createDataFrame([([float(x) for x in v],)], "v array<float>").select(V.l2_normalize(F.col("v"))))
    assert got == pytest.approx(want, abs=1e-6) if want else np.linalg.norm(got) == pytest.approx(1, abs=1e-6)


def test_pre_pooled_and_bytes(spark):
    df = spark.createDataFrame([([3.0, 0.0, 4.0],), (None,)], "v array<float>")
    got = df.select(V.pre_pooled(F.col("v"), True).alias("n"), V.to_f32_bytes("v").alias("b"), V.from_f32_bytes(V.to_f32_bytes("v")).alias("r")).collect()
    assert got[0].n == pytest.approx([0.6, 0, 0.8]) and bytes(got[0].b) == np.array([3, 0, 4], "<f4").tobytes() and got[0].r == [3, 0, 4]
    assert got[1].b is None and got[1].r is None


def test_cosine_of_a_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("b"), F.col("b"))).first() == (0.0, pytest.approx(1.0))


def test_strip_padding_on_either_side(spark):
    df = spark.createDataFrame([([0, 0, 5, 6], [0, 0, 1, 1]), ([5, 6, 0], [1, 1, 0])], "i array<long>, m array<long>")
    assert [r[0] for r in df.select(T.strip_padding(F.col("i"), F.col("m"))).collect()] == [[5, 6], [5, 6]]


@given(st.lists(st.one_of(st.none(), st.text(max_size=12)), max_size=8), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_codepoint_tokenizer(texts, n):
    ids, off = M.CodepointTokenizer(n).encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == [([101, *map(ord, t or ""), 102])[:n] for t in texts]


def test_codepoint_expression_agrees(spark):
    texts = ["", None, "ab", "é🙂x", "z" * 300]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.codepoint_ids(F.col("t"))).collect()]
    assert got == [([101, *map(ord, t or ""), 102])[:128] for t in texts]


# --- encoders


class Ranked:
    """An encoder on padded batches, of either rank."""

    def __init__(self, rank):
        self.rank = rank

    def run(self, ids, mask):
        hidden = np.stack([ids, ids * 2.0], axis=2).astype(np.float32)
        return hidden if self.rank == 3 else hidden[:, 0]


@pytest.mark.parametrize("rank", [2, 3])
def test_padded_encoders(monkeypatch, rank):
    monkeypatch.setattr(M, "loaded", lambda m: (M.CodepointTokenizer(m.max_length), Ranked(rank)))
    model = M.Model("m", dim=2, pooling="none" if rank == 2 else "mean", normalize=False)
    got = M.embed_texts(model, ["ab", "", "abcdef"], batch=2)
    ids = [[101, *map(ord, t), 102] for t in ("ab", "", "abcdef")]
    want = [101.0] * 3 if rank == 2 else [np.mean(i) for i in ids]
    assert got[:, 0] == pytest.approx(want) and got[:, 1] == pytest.approx([2 * w for w in want])
    with pytest.raises(ValueError, match="does not fit"):
        M.embed_texts(M.Model("m", pooling="mean" if rank == 2 else "none"), ["a"])


def test_file_tokenizer_cuts_and_pads(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path).encode("hello world again").ids
    ids, off = M.FileTokenizer(path, 2).encode(["hello world again", None])
    assert ids[: off[1]].tolist() == want[:2]
    ids, off = M.FileTokenizer(path, 9, pad_output=True).encode(["hello"])
    assert len(ids) == 9


# --- operators


def test_client(spark):
    c = Client(spark, [M.Model("a", 4), M.Model("b", 8, normalize=False)])
    assert c["a"] is c["a"] and len(c["a"]["x"]) == 4 and len(c["b"]["x", "y"]) == 2
    got = c.multi([("a", "x"), ("none", "x"), ("b", "x"), ("a", "x")])
    assert got[0] == c["a"]["x"] == got[3] and got[1] is None and got[2] == c["b"]["x"]
    assert c.ping() == "PONG" and c.is_ready() and not Client(spark, []).is_ready() and len(c.help()) == 9
    assert [tuple(r) for r in c.models().collect()] == [("a", 4, "ready"), ("b", 8, "ready")] and c.info("b")["normalize"] is False and c.info("none") == {}
    assert c.stats()["total_requests"] == sum(c.info(m)["requests"] for m in "ab") and c.stats()["models_loaded"] == 2
    proxy = c["a"]
    c.reset()
    assert c["a"] is not proxy and c.ready() == "ready" and Client(spark, []).ready() == "no models"
    assert [tuple(r) for r in Client(spark, [M.Model("a", 4)]).models().collect()] == [("a", 4, "registered")]


def test_raw_commands(spark, capsys):
    c = Client(spark, [M.Model("a", 4)], debug=True)
    assert c.command("EMBED", "a", "x", "y") == c["a"]["x", "y"] and "embed a (2 texts" in capsys.readouterr().out
    assert c.command("embed.multi", "a", "x", "no", "x")[1] is None and c.command("Ping") == "PONG" and c.command("ready") == "ready"
    assert c.command("embed", "no", "x") == "ERR model 'no' not found" == c.command("info", "no")
    assert c.command("embed", "a").startswith("ERR wrong number") and c.command("embed.multi", "a").startswith("ERR wrong number") and c.command("x").startswith("ERR unknown")
    assert c.command("info", "a")["dim"] == 4 and c.command("models") == [("a", 4, "ready")] and len(c.command("help")) == 9 and "uptime_secs" in c.command("stats")


def test_connecting(spark, monkeypatch):
    monkeypatch.setenv("LOOMVEC_MASTER", "local[2]")  # a running session is used again
    assert Client.connect([M.Model("a", 4)]).spark.version == spark.version


def test_collected_keeps_positions(spark):
    df = spark.createDataFrame([(1, 2, [2.0]), (1, 0, [0.0]), (1, 1, None)], "c int, p int, v array<float>")
    assert embed.collected(df, "c", "p", "v").first().vectors == [[0.0], None, [2.0]]


def test_lru_evicts_the_least_recent_until_an_entry_fits():
    rng = np.random.default_rng(21)
    budget, sizes = 700, rng.integers(1, 220, 300)
    lru, order, kept, evicted = cache.ByteLru(budget), [], {}, 0
    for size, k in zip(sizes.tolist(), rng.integers(0, 9, 300).tolist(), strict=True):
        key = f"key{k}"
        if size % 3 == 0:
            assert lru.get(key) == (key in kept)
            if key in kept:
                order.remove(key)
                order.append(key)
            continue
        cost = len(key) + size + cache.ENTRY_COST
        if key in kept:  # overwriting never evicts
            order.remove(key)
        else:
            while order and sum(kept.values()) + cost > budget:
                del kept[order.pop(0)]
                evicted += 1
        kept[key] = cost
        order.append(key)
        lru.put(key, size)
        assert (list(lru.entries), lru.used, lru.evictions) == (order, sum(kept.values()), evicted)
    lru.put("large", 10 * budget)  # over the budget: empties the cache and is stored
    assert list(lru.entries) == ["large"]


def test_cache_totals_with_and_without_evictions(spark):
    rng = np.random.default_rng(22)
    log = [(i, f"k{int(rng.integers(30))}") for i in range(400)]
    df = spark.createDataFrame(log, "seq long, k string")
    for budget in (10**6, 900, 1):
        lru, hits = cache.ByteLru(budget), 0
        for _, k in log:
            if lru.get(k):
                hits += 1
            else:
                lru.put(k, 100)
        got = cache.cache_totals(df, "k", "seq", F.lit(100), budget).first()
        assert tuple(got) == (hits, 400 - hits, lru.evictions, len(lru.entries), budget, lru.used)
    assert tuple(cache.cache_totals(df.limit(0), "k", "seq", F.lit(100), 9).first())[:4] == (0, 0, 0, 0)


def test_cached_vectors_are_used_again_and_misses_are_added(spark):
    m = M.Model("m", 4)
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "a"), (4, "")], "i int, text string")
    empty = spark.createDataFrame([], "model string, text string, embedding array<float>")
    first = embed.embed_cached(docs, empty, m)
    plain = {r.i: r.embedding for r in embed.embed(docs, m).collect()}
    assert {r.i: (r.hit, r.embedding) for r in first.collect()} == {i: (False, v) for i, v in plain.items()}
    fresh = embed.misses_for_cache(first, m)
    assert sorted(str(r.text) for r in fresh.collect()) == ["", "None", "a", "b"]
    other = fresh.withColumns({"embedding": F.array(*[F.lit(9.0).cast("float")] * 4)}).where("text = 'a'").unionByName(fresh.withColumn("model", F.lit("x")))
    again = {r.i: (r.hit, list(r.embedding)) for r in embed.embed_cached(docs, other, m).collect()}
    assert again == {i: (i in (0, 3), [9.0] * 4 if i in (0, 3) else list(v)) for i, v in plain.items()}


def test_a_bad_row_fails_its_command_alone(spark):
    rows = [(1, 0, "m", "a"), (1, 1, "m", "b"), (2, 0, "m", "a"), (2, 1, "m", None), (2, 2, "no", "x"), (3, 0, "no", "a"), (4, 0, None, "a")]
    out = embed.embed_commands(spark.createDataFrame(rows, "c int, p int, model string, text string"), [M.Model("m", 3)], "c", "p").collect()
    errors = {1: None, 2: "ERR text is null", 3: "ERR model 'no' not found", 4: "ERR model '' not found"}
    assert all(r.error == errors[r.c] and (r.embedding is None) == (r.c != 1) for r in out) and len(out) == len(rows)


def test_lru_of_varied_sizes(spark):
    rng = np.random.default_rng(0)
    log = [("s" + str(i % 3), i, f"k{int(rng.integers(12))}", int(rng.integers(1, 90))) for i in range(500)]
    got = {r.seq: (r.hit, r.evictions, r.entries, r.used) for r in cache.simulate_lru(spark.createDataFrame(log, "s string, seq long, k string, b long"), "s", "seq", "k", "b", 400).collect()}
    for s in ("s0", "s1", "s2"):
        lru = cache.ByteLru(400)
        for _, i, k, b in [x for x in log if x[0] == s]:
            hit = lru.get(k)
            if not hit:
                lru.put(k, b)
            assert got[i] == (hit, lru.evictions, len(lru.entries), lru.used)


def test_repeats_inside_a_command_are_misses(spark):
    df = spark.createDataFrame([("m", "a", 1), ("m", "a", 1), ("m", "a", 2)], "m string, t string, c int")
    assert sorted(r.hit for r in cache.unbounded_hits(df, ["m", "t"], "c").collect()) == [False, False, True]


def test_numbers_within_keys(spark):
    rng = np.random.default_rng(23)
    rows = [([None, "a", "b"][int(k)], int(i)) for k, i in zip(rng.integers(0, 3, 300), rng.permutation(300), strict=True)]
    got = {(r.k, r.i): r.number for r in batching.numbered(spark.createDataFrame(rows, "k string, i long"), "k", "i", slices=7).collect()}
    assert got == {(k, i): sorted(j for x, j in rows if x == k).index(i) for k, i in rows}
    assert batching.numbered(spark.createDataFrame([], "k string, i long"), "k", "i").count() == 0


def test_windows_close_by_count_and_by_time():
    w = batching.Window(10, 2)
    assert [w.add(t) for t in (0, 1, 2, 11, 12, 13)] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    w = batching.Window(10, 9)
    assert [w.add(t)[0] for t in (0, 9, 10, 19, 20)] == [1, 1, 2, 2, 3]


def streamed(spark, tmp_path, parts, name, **settings):
    """Rows of ``stream_windows`` over one file per trigger."""
    schema = "k string, seq long, at long"
    out = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if out is None:
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = stream_windows(source, "k", "seq", "at", **settings).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        out.processAllAvailable()
    out.stop()
    return [tuple(r) for r in spark.table(name).select("k", "seq", "window", "place", "closed_by").collect()]


def test_stream_windows_are_those_of_the_batch_over_many_arrow_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("ab"[int(rng.integers(2))], i, 7_000 * (i + 1)) for i in range(120)]
    shuffled = [[rows[40 * p + int(i)] for i in rng.permutation(40)] for p in range(3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:  # two late events of a third key let the watermark pass every window
        got = streamed(spark, tmp_path, [*shuffled, [("z", 900, 10**10)], [("z", 901, 2 * 10**10)]], "windows", timeout_us=30_000, max_batch=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = batching.microbatch_windows(spark.createDataFrame(rows, "k string, seq long, at long"), "k", "seq", "at", 30_000, 3)
    assert sorted(r[:4] for r in got if r[0] != "z") == sorted(tuple(r) for r in want.select("k", "seq", "window", "place").collect())
    assert {r[4] for r in got} >= {"count", "arrival"}


def test_a_stream_window_closes_by_time_alone(spark, tmp_path):
    second = 10**6
    parts = [[("a", 1, second), ("a", 2, 2 * second)], [("b", 3, 100 * second)], [("b", 4, 101 * second)]]
    got = streamed(spark, tmp_path, parts, "timed", timeout_us=5 * second, max_batch=10)
    assert sorted(r for r in got if r[0] == "a") == [("a", 1, 1, 1, "time"), ("a", 2, 1, 2, "time")]


def test_stream_counters(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = windowed_counters(source, "ts", "event_type", "value").writeStream.format("memory").queryName("counters").outputMode("complete").start()
    out.processAllAvailable()
    out.stop()
    assert one(spark.table("counters").agg(F.sum("requests"))) == events.count()


def test_command_stream_drains(spark, tmp_path):
    rows = [{"connection": i % 2, "seq": i, "args": ["EMBED", "m", f"t{i}"] if i % 3 else ["ping"]} for i in range(9)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    parsed = commands.parsed(files.command_log(spark, str(tmp_path / "in"), stream=True))
    q = parsed.writeStream.format("memory").queryName("commands").start()
    assert drain(q) and not q.isActive
    want = sorted((r.seq, r.command) for r in commands.parsed(files.command_log(spark, str(tmp_path / "in"))).collect())
    assert sorted((r.seq, r.command) for r in spark.table("commands").collect()) == want and len(want) == 9


def test_lookup_and_gates(spark):
    log = [(1, 1, ["embed", "m", "t"]), (1, 2, ["ping"]), (1, 3, ["auth", "no"]), (1, 4, ["AUTH", "pw"]), (1, 5, ["embed", "m", "t"]), (2, 6, ["models"]), (2, 7, [])]
    df = spark.createDataFrame(log, "c int, s int, args array<string>")
    got = [r.reply for r in commands.auth_gate(df, "c", "s", "pw").orderBy("s").collect()]
    no = "NOAUTH Authentication required."
    assert got == [no, None, "ERR invalid password", "OK", None, no, no]
    assert [r.reply for r in commands.auth_gate(df, "c", "s", "").orderBy("s").collect()][2].startswith("ERR Client sent AUTH")


def test_strict_catalog_raises(spark):
    configs = spark.createDataFrame([("c", None, None, "missing", None, None, None, None, None)], queries.CONFIG_SCHEMA)
    outputs = spark.createDataFrame(queries.OUTPUTS, "model string, name string, rank int, dim long")
    assert catalog.resolve(configs, outputs).first().output_tensor == "y"
    with pytest.raises(Exception, match="no output missing"):
        catalog.resolve(configs, outputs, strict=True).collect()


# --- sources


def test_config_rules(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"models": {"m": {"model_repo": "x"}}}))
    assert files.load_config(str(p))["listen"] == ":6379"
    for bad in ({"models": {"m": {}}}, {"tls_cert": "c"}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.load_config(str(p))


def test_verification_set(spark, tmp_path):
    p = tmp_path / "v.json"
    p.write_text(json.dumps({"model": "m", "dim": 2, "sentences": ["a", "b"], "embeddings": [[1, 2], [3, 4]]}, indent=1))
    assert [tuple(r) for r in files.verification_set(spark, str(p)).orderBy("pos").collect()] == [(0, "a", [1, 2]), (1, "b", [3, 4])]


def test_wire_round_trip(spark):
    rows = [("status", "OK"), ("error", "ERR x"), ("integer", "7"), ("bulk", "é\r\n"), ("bulk", None)]
    got = [r[0].encode() for r in spark.createDataFrame(rows, "k string, t string").select(files.wire_reply(F.col("k"), F.col("t"))).collect()]
    values = [files.read_reply(x)[0] for x in got]
    assert values[0] == "OK" and isinstance(values[1], files.WireError) and values[2:] == [7, "é\r\n".encode(), None]
    assert files.read_reply(files.write_command("embed", "m", b"x"))[0] == [b"embed", b"m", b"x"]


def test_flags(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"listen": ":1", "models": {"c": {"onnx": "c.onnx"}}}))
    got = files.parse_flags(["-listen", ":9", "-model", "a", "-model-onnx", "a.onnx", "-dim", "8", "-normalize", "-model", "b", "-model-repo", "r/b", "-max-length", "64"])
    assert got == {"listen": ":9", "models": {"a": {"onnx": "a.onnx", "dim": 8, "normalize": True}, "b": {"model_repo": "r/b", "max_length": 64}}}
    assert files.parse_flags(["-model-onnx", "x"])["models"] == {"model": {"onnx": "x"}}
    assert files.parse_flags(["-listen", ":9", "-config", str(p), "-cache", "auto"]) == {"listen": ":1", "models": {"c": {"onnx": "c.onnx"}}, "cache": "auto"}
    for bad in ([], ["-listen"], ["-model", "a"], ["-nonsense"], ["stray"], ["-model-onnx", "x", "-tls-cert", "c"]):
        with pytest.raises(ValueError):
            files.parse_flags(bad)


def test_files_of_a_configuration(spark, tmp_path):
    (tmp_path / "m.onnx").write_bytes(b"")
    (tmp_path / "config.json").write_text('{"max_position_embeddings": 77}')
    config = {"models": {"a": {"onnx": str(tmp_path / "m.onnx"), "batching": {"timeout": -1}}, "b": {"model_repo": "r"}, "c": {"onnx": "/none.onnx", "tokenizer": "/none.json"}}}
    assert [e.split(" file ")[0] for e in files.missing_files(config)] == ["model a: tokenizer", "model c: onnx", "model c: tokenizer"]
    outputs = spark.createDataFrame([("a", "y", 2, 5)], "model string, name string, rank int, dim long")
    got = {r.name: r for r in catalog.resolve(files.config_frame(spark, config), outputs).collect()}
    assert (got["a"].max_length, got["a"].dim, got["a"].pooling, got["a"].batch_timeout_ms) == (77, 5, "none", 1) and got["b"].max_length == 512


def test_memory_of_the_machine(monkeypatch):
    import os

    assert files.total_memory() > 2**28
    monkeypatch.setattr(os, "sysconf", lambda name: (_ for _ in ()).throw(ValueError(name)))
    assert files.total_memory() == 0


# --- a model file


def field(number, value):
    """A protobuf field: a varint, or bytes."""

    def varint(n):
        return bytes([n & 127 | (128 if n > 127 else 0)]) + (varint(n >> 7) if n > 127 else b"")

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tiny_model(path):
    """A model of two outputs: each id as a float, (batch, token, 1), and their sum, (batch, 1); inputs in unusual order."""
    attribute = lambda name, value, kind: field(5, field(1, name) + value + field(20, kind))
    node = lambda op, inputs, output, extra=b"": field(1, b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, op) + extra)
    dims = lambda *sizes: field(2, b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in sizes))
    tensor = lambda number, name, kind, *sizes: field(number, field(1, name) + field(2, field(1, field(1, kind) + dims(*sizes))))
    graph = node("Mul", ["input_ids", "attention_mask"], "real") + node("Cast", ["real"], "f", attribute("to", field(3, 1), 2))
    graph += node("Unsqueeze", ["f"], "hidden", attribute("axes", field(8, 2), 7)) + node("ReduceSum", ["f"], "total", attribute("axes", field(8, 1), 7))
    graph += field(2, "g") + tensor(11, "attention_mask", 7, "b", "t") + tensor(11, "input_ids", 7, "b", "t") + tensor(12, "hidden", 1, "b", "t", 1) + tensor(12, "total", 1, "b", 1)
    path.write_bytes(field(1, 6) + field(7, graph) + field(8, field(1, "") + field(2, 11)))
    return str(path)


def test_model_file_runs_and_tells_its_outputs(spark, tmp_path):
    path = tiny_model(tmp_path / "m.onnx")
    assert files.model_tensors(path) == (["attention_mask", "input_ids"], [("hidden", 3, 1), ("total", 2, 1)])
    assert catalog.select_output(files.outputs_frame(spark, {"m": path})).first()["name"] == "total"
    texts = ["abc", "", None, "é" * 20, "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    ids = [[101, *map(ord, t or ""), 102][:16] for t in texts]
    mean = M.Model("m", 1, 16, onnx_path=path, output_tensor="hidden", normalize=False)
    total = M.Model("t", 1, 16, pooling="none", onnx_path=path, output_tensor="total", normalize=False)
    assert [r.embedding[0] for r in embed.embed(df, mean).orderBy("i").collect()] == pytest.approx([sum(x) / len(x) for x in ids])
    assert [r.embedding[0] for r in embed.embed(df, total).orderBy("i").collect()] == [sum(x) for x in ids]
    with pytest.raises(Exception, match="does not fit"):
        embed.embed(df, M.Model("x", 1, 16, pooling="none", onnx_path=path, output_tensor="hidden")).collect()


def test_tokenize_file_equals_the_library(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.tokenize_file(spark, SF).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=True).ids[:128]
        assert (r.n_ids, r.ids_md5) == (len(ids), hashlib.md5(",".join(map(str, ids)).encode()).hexdigest())


def test_f32_bytes_equal_struct(spark):
    import struct

    rows = [(0, [1.5, -2.25, 1e-30]), (1, None), (2, []), (3, [float("inf")])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    out = df.select("i", "v", V.to_f32_bytes("v").alias("b")).select("i", "v", "b", V.from_f32_bytes("b").alias("w")).collect()
    assert all(r.b == (None if r.v is None else struct.pack(f"<{len(r.v)}f", *r.v)) and r.w == r.v for r in out)


def test_array_replies(spark):
    values = [b"\0\1", None, b"x\r\n"]
    assert files.read_reply(files.wire_bytes(values))[0] == values and files.read_reply(files.wire_bytes(values[:1]))[0] == values[0]
    rows = spark.createDataFrame([(["a", None, "é"],), (["b"],), ([],)], "t array<string>")
    got = [files.read_reply(r[0].encode())[0] for r in rows.select(files.wire_texts(F.col("t"))).collect()]
    assert got == [[b"a", None, "é".encode()], b"b", []]


# --- queries against their SQL


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    assert got
    if name in queries.SQL:
        con = DUCK.connect()
        for table in ("documents", "embeddings", "events", "benchmark", "conversations"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        assert got == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall(), key=str)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 200 * 8
