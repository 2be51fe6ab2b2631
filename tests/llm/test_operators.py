"""Each operator against brute force on small tables with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomvec.llm import common, decontaminate, language_id, line_dedup, ngram_join, piece_bpe, queries, textscan, token_store, topk, toxicity, url_filter, warc_revisit
from loomvec.llm.common import Scratch, new_table_path
from loomvec.llm.components import components
from loomvec.llm.queries import BYTE_MODEL, PIECE_MODEL, RULES, tokenizer_path
from loomvec.llm.urls import canonical_url

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- text scanning


@given(st.lists(st.text(alphabet="aB 9.é\n🙂\x7f", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    import pyarrow as pa

    w = textscan.Words(*textscan.text_bytes(pa.array(texts, pa.string())))
    got = [[x.decode() for x in w.words(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [words(t) for t in texts]
    by_hash = {}
    for h, word in zip(w.hashes.tolist(), itertools.chain.from_iterable(got), strict=True):
        assert by_hash.setdefault(h, word) == word


@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=2, max_size=6), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_hashes_of_long_spans_tell_them_apart(parts, times):
    spans = [p.encode() * times for p in parts]
    off = np.cumsum([0, *map(len, spans)])
    raw = np.frombuffer(b"".join(spans), np.uint8)
    for seed in (0, 1):
        got = textscan.span_hashes(raw, off[:-1], off[1:], seed).tolist()
        assert [[a == b for b in got] for a in got] == [[a == b for b in spans] for a in spans]


def test_plain_words(spark):
    import pyarrow as pa

    texts = [" A  b.", "", "...", None, "x", "\u00e9 9z"]
    raw, off = textscan.Words(*textscan.text_bytes(pa.array(texts))).plain()
    assert [raw[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)] == [" ".join(words(t)) for t in texts]


def thue_morse(n):
    """Two words that a polynomial hash modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_joins_tell_long_words_apart(spark):
    docs = table(spark, [(k, w) for k, w in enumerate(thue_morse(2048))] + [(2, thue_morse(2048)[0])], "doc_id long, text string")
    assert rows(line_dedup.dedup_lines(docs), "doc_id", "n_removed") == [(0, 0), (1, 0), (2, 1)]
    assert rows(ngram_join.ngram_join(docs), "doc_id", "class_id", "n_links") == [(0, 0, 1), (1, 1, 0), (2, 0, 1)]


# --- tables in the shared folder


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "local-cluster[2,1,1024]", "applicationId": "a"})()  # noqa: N815

    with pytest.raises(ValueError, match=r"spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_operators_leave_only_what_their_result_reads(spark):
    import os

    docs = table(spark, copies(np.random.default_rng(10)), "doc_id long, text string")
    named = dict(spark.conf.getAll)
    for make, left in ((line_dedup.dedup_lines, ["line-stays"]), (ngram_join.ngram_join, ["joined", "named"])):
        before = common.tables(spark)
        out = make(docs)
        new = [p for p in common.tables(spark) if p not in before]
        assert sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in new) == left
        assert out.count() == docs.count()
        common.drop_tables(spark, new)
        assert common.tables(spark) == before and not any(os.path.exists(p.removeprefix("file://")) for p in new)
    assert dict(spark.conf.getAll) == named  # settings for writing are put back


# --- 1: top-k


@pytest.mark.parametrize(("query_group", "stripe"), [(2, 50), (8192, 200_000)])
def test_topk_equals_brute_force(spark, query_group, stripe):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(-4, 5, 20) / 8]) for i in range(400)]
    data += [(100, data[7][1]), (7, data[7][1]), (500, None), (501, [1.0, None]), (502, [float("nan")] * 20), (503, [float("inf")] * 20), (600, [1e30] * 20), (None, [0.0] * 20), (700, [1.0, 2.0]), (800, []), (900, [1e30] * 20)]
    got = rows(topk.top_k(table(spark, [(*d, "x") for d in data], "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 100 == 0, k=5, query_group=query_group, stripe=stripe), "query_id", "rank", "vec_id", "score")
    import math

    whole = []
    for i, v in data:
        v = None if v is None else [None if x is None else float(np.float32(x)) for x in v]
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(1024 * x) for x in v]))
    want = []
    for a, (q, x) in enumerate(whole):
        if q % 100 == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(p * r for p, r in zip(x, y, strict=True)))), i) for b, (i, y) in enumerate(whole) if b != a and len(y) == len(x)]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5], 1)]
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_topk_of_no_rows(spark):
    assert topk.top_k(table(spark, [], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


# --- 2: revisits


def test_revisits_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    urls = ["http://www.A.org/x/", "https://a.org/x?utm_source=f", "http://a.org/y#z", "http://b.org/"]
    data = []
    for i in range(300):
        kind = ["response", "revisit"][int(rng.integers(2))]
        tag = [None, "t1", "W/t1", "t2"][int(rng.integers(4))]
        url = urls[min(3, int(rng.integers(8)))] if i % 50 else None
        data.append((i, url, int(rng.integers(60)) if i % 41 else None, kind, tag, [None, "mon"][int(rng.integers(2))], [None, "d1", "d2"][int(rng.integers(3))], {"etag": str(i), "server": "s"} if i % 3 else None, "x"))
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, slice string"
    got = {r.record_id: r for r in warc_revisit.resolve_revisits(table(spark, data, schema), slices=7).collect()}
    canon = {urls[0]: "a.org/x", urls[1]: "a.org/x", urls[2]: "a.org/y", urls[3]: "b.org", None: None}
    assert len(got) == sum(r[3] == "revisit" for r in data)
    for r in data:
        if r[3] != "revisit":
            continue
        one = got[r[0]]
        past = [p for p in data if p[3] == "response" and None not in (p[1], p[2], r[1], r[2]) and canon[p[1]] == canon[r[1]] and (p[2], p[0]) < (r[2], r[0])]
        assert one.canonical_url == canon[r[1]]
        if not past:
            assert (one.status, one.response_id) == ("no_response", None)
            continue
        old = max(past, key=lambda p: (p[2], p[0]))
        pairs = [(r[k], old[k]) for k in (4, 5, 6) if r[k] is not None and old[k] is not None]
        strip = lambda x: x.removeprefix("W/")
        status = "unverified" if not pairs else "resolved" if strip(pairs[0][0]) == strip(pairs[0][1]) else "mismatch"
        assert (one.status, one.response_id) == (status, old[0])
        mine = r[7] or {}
        merged = {**(old[7] or {}), **{k: v for k, v in mine.items() if k in warc_revisit.PERMITTED_HEADERS}}
        assert one.headers == (mine if status == "mismatch" else merged)


def test_revisits_in_one_hot_url_with_equal_and_extreme_times(spark):
    ends = [-(2**63), 2**63 - 1]
    data = [(i, "http://a.org/x", [5, ends[0], ends[1], i][i % 4], ["response", "revisit"][i // 4 % 2], None, None, None, None) for i in range(400)]
    data += [(1007, "http://a.org/x", 5, "revisit", None, None, None, {"DATE": "1", "date": "2", "Date": "0", "x": None})] * 2
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    out = warc_revisit.resolve_revisits(table(spark, data, schema), slices=9).collect()
    order = sorted((r[2], r[0]) for r in data if r[3] == "response")
    assert len(out) == sum(r[3] == "revisit" for r in data)
    for r in out:
        when = next(d[2] for d in data if d[0] == r.record_id and d[3] == "revisit")
        past = [x[1] for x in order if x < (when, r.record_id)]
        assert r.response_id == (past[-1] if past else None)
        assert r.headers == ({"date": "2"} if r.record_id == 1007 else {})
    assert warc_revisit.resolve_revisits(table(spark, [], schema)).count() == 0


def test_captures_meet_other_pages(spark):
    out = queries.op2_warc_revisit(spark, "/root/testdata/sf0.01").collect()
    status = [r.status for r in out]
    assert {"resolved", "mismatch", "unverified", "no_response"} == set(status)
    assert sum(r.response_id == r.record_id - 1 for r in out) < len(out) / 2


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.A.org:80/x/?utm_a=1&b=2&ref=3#t", "https://a.org:443", "https://a.org:80/", "http://a.org/?ref=x", "nothing", None, "", "a:b://C/d"]
    want = ["a.org/x?b=2", "a.org", "a.org:80", "a.org", "nothing", None, "", "c/d"]
    got = table(spark, list(enumerate(urls)), "i int, u string").select("i", canonical_url(F.col("u")).alias("c"))
    assert [r.c for r in got.orderBy("i").collect()] == want


# --- 3: pieces

ODD = ["", None, "a", " a", "a  b\n\nc\t", "▁x", "<s>hi</s><unk>", "\0a", "é" * 3, "　x", "🙂͸x", "a\r\nb ", " " * 400, "ab" * 700, "x ▁ y", "<0x41>", "the " * 3000, "the" * 3000, "=" * 3000, "etaoinshrdlu" * 300, "中文" * 900]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))


def test_pieces_equal_the_library(spark, library):
    texts = [*ODD, *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect())]
    df = table(spark, [(i, t, 1) for i, t in enumerate(texts)] + [(0, "again", 2)], "doc_id long, text string, n_tokens int")
    got = rows(piece_bpe.encode_pieces(df, tokenizer_path(PIECE_MODEL), with_ids=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    want = []
    for i, t in [*enumerate(texts), (0, "again")]:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids))
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


@given(st.text(alphabet="ab etTh\n .,é▁🙂中͸", max_size=300))
@settings(max_examples=150, deadline=None)
def test_pieces_of_any_text(library, text):
    m = piece_bpe.model(tokenizer_path(PIECE_MODEL))
    ids = m.encode([text])[0]
    assert ids == library.encode(text)
    assert m.decode(ids) == library.decode(ids)


@given(st.lists(st.integers(3, 700), max_size=30))
@settings(max_examples=150, deadline=None)
def test_decoding_of_any_ids(library, ids):
    assert piece_bpe.model(tokenizer_path(PIECE_MODEL)).decode(ids) == library.decode(ids)


# --- 4: language


def phrases(text, sample):
    """Greedy parse of a whole text by substring search."""
    n, now = int(bool(text)), ""
    for c in text:
        if now + c in sample:
            now += c
        else:
            n += 1
            now = c if c in sample else ""
    return n


def fold(text):
    return re.sub(r"[^a-zé]+", "_", text.lower())


def test_phrases_equal_substring_search(monkeypatch):
    import pyarrow as pa

    samples = (("aa", "the cat sat on the mat and the rat"), ("bb", "le chat été sur la table et le rat"), ("cc", "abab " * 40 + "ab" * 300))
    rng = np.random.default_rng(11)
    texts = ["the rat été zq", "", "x" * 50, "the cat. Sat! " * 700, "ÉTÉ", "12 34", "ab" * 4000, "a" * 3000, "".join(rng.choice(list("abet hcrs."), 6000))]
    for segment, lanes in ((language_id.SEGMENT, 32), (7, 2)):
        monkeypatch.setattr(language_id, "SEGMENT", segment)
        monkeypatch.setattr(language_id, "LANES", lanes)
        p = language_id.CrossParser(samples)
        got = p.phrases(*language_id.folded(*textscan.text_bytes(pa.array(texts))))
        assert got.tolist() == [[phrases(fold(t), fold(s)) for _, s in samples] for t in texts]


def test_a_language_with_few_lettered_rows_is_learned(spark):
    data = [(i, None, "zz") for i in range(3000)] + [(5000 + i, "qwq qaq qoq", "zz") for i in range(3)] + [(6000 + i, "the cat and the dog", "en") for i in range(900)]
    docs = table(spark, data, "doc_id long, text string, lang string")
    samples = language_id.learn(docs, sample_rows=20, sample_chars=60)
    assert [k for k, _ in samples] == ["en", "zz"] and all(len(t) <= 60 + 20 for _, t in samples)
    assert language_id.identify(docs.where("doc_id = 5001"), samples).first().lang_pred == "zz"


def test_language_ties_long_texts_many_languages_and_no_rows(spark):
    docs = table(spark, [(1, "abc abd", "bb"), (2, "abc abd", "aa"), (3, "x" * 50, "cc"), (4, "abc " * 60_000, None)] + [(100 + i, f"word{chr(0x4E00 + i)}", f"l{i}") for i in range(1200)], "doc_id long, text string, lang string")
    samples = language_id.learn(docs, sample_chars=10)
    assert len(samples) == 1203 and dict(samples)["cc"] == "x" * 50  # longer than the bound, and all that there is
    few = language_id.learn(docs.where("doc_id < 4"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.where("doc_id < 5"), few).collect()}
    assert got[1] == got[2] == ("aa", 0.0) and got[3][0] == "cc" and got[4][0] == "aa"
    assert language_id.identify(docs.limit(0), few).count() == 0
    assert language_id.learn(docs.limit(0)) == ()


def test_language_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = table(spark, [(5000, None, "en"), (5001, "123 !!", None), (None, "the of and", None), (5002, "", "fr")], "doc_id long, text string, lang string")
    docs = docs.union(odd)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    samples = language_id.learn(docs.where(~held))
    out = {r.doc_id: r for r in language_id.identify(docs, samples, held_out=F.coalesce(held, F.lit(False))).collect()}
    assert [out[k].lang_pred for k in (5000, 5001, 5002)] == ["und"] * 3
    assert not out[None].held_out and out[5000].score == 0
    test = [(r.lang, out[r.doc_id].lang_pred) for r in docs.where(held & F.col("lang").isNotNull() & (F.col("doc_id") < 5000)).collect()]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_without_labels(spark):
    docs = table(spark, [(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs, language_id.learn(docs)).first().lang_pred == "und"


# --- 5: contamination


def contaminated(docs, items):
    windows = {}
    for i, t in items:
        w = words(t) if i is not None else []
        m = min(13, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[a : a + m]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in windows:
                    hit.update(range(a, a + m))
                    names |= windows[tuple(w[a : a + m])]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("block_bytes", [10**7, 300])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = np.random.default_rng(3)
    vocab = ["a", "bb", "Cc", "d9", "é"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(int(rng.integers(1, 18)))) for i in range(14)] + [(50, None), (51, "... !"), (None, "a a"), (3, text(15)), (7, text(13))]
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(30)] + [(40, None), (41, ""), (0, items[2][1]), (0, items[2][1]), (42, " ".join(["zz"] * 500) + " " + items[3][1]), (None, items[4][1].upper())]
    out = decontaminate.contamination(table(spark, [(*d, 1) for d in docs], "doc_id long, text string, n_hit int"), table(spark, items, "item_id long, text string"), block_bytes=block_bytes)
    assert rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == contaminated(docs, items)


def test_contamination_without_items(spark):
    out = decontaminate.contamination(table(spark, [(1, "a b")], "doc_id long, text string"), table(spark, [], "item_id long, text string")).first()
    assert (out.n_words, out.n_hit, out.contaminated) == (2, 0, False)


# --- 6: lines


def deduped(docs):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    seen, out = [], {}
    for k in order:
        left, removed, wordy = [], 0, 0
        for line in (docs[k][1] or "").split("\n"):
            s = frozenset(words(line))
            wordy += bool(s)
            if s and any(len(s & t) >= 0.8 * len(s | t) - 1e-9 for t in seen):
                removed += 1
            else:
                left.append(line)
            if s:
                seen.append(s)
        text = docs[k][1] if not removed else "\n".join(left)
        out[k] = (docs[k][0], "" if removed and not text.strip() else text, wordy, removed)
    return sorted(out.values(), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("block", [1 << 15, 3])
def test_line_dedup_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    vocab = np.array([f"w{i}" for i in range(60)])
    base = [list(rng.choice(vocab, int(rng.integers(1, 30)), replace=False)) for _ in range(25)]
    docs = []
    for i in range(70):
        lines = []
        for _ in range(int(rng.integers(1, 7))):
            line = list(base[int(rng.integers(len(base)))])
            for _ in range(int(rng.integers(0, 4))):
                line[int(rng.integers(len(line)))] = str(rng.choice(vocab))
            rng.shuffle(line)
            lines.append(" ".join(line))
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n--\n"), (103, "a\n\n\na\nA."), (None, docs[3][1]), (104, "only " * 30000), (105, docs[5][1])]
    got = rows(line_dedup.dedup_lines(table(spark, [(*d, "x") for d in docs], "doc_id long, text string, line string"), block=block), "doc_id", "text", "n_lines", "n_removed")
    assert got == deduped(docs)


def test_line_dedup_of_no_rows(spark):
    assert line_dedup.dedup_lines(table(spark, [], "doc_id long, text string")).count() == 0


def test_repeated_rows_keep_the_same_lines(spark):
    out = line_dedup.dedup_lines(table(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string"))
    assert rows(out, "doc_id", "text") == [(1, "a b c"), (1, "a b c"), (2, "")]


# --- 7: token store


def test_token_store_round_trip(spark):
    t = token_store.tokenizer(tokenizer_path(BYTE_MODEL))
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts = [*ODD, *real, "x <|endoftext|> y", "a \u00a0b 　c", "d's  e"]
    docs = [(1000 - 3 * i, x) for i, x in enumerate(texts)] + [(None, "n"), (7, "b"), (7, "a"), (-(2**40), "low")]
    path = new_table_path(spark, "test-store")
    token_store.write_store(table(spark, [(*d, 0) for d in docs], "doc_id long, text string, start int"), tokenizer_path(BYTE_MODEL), path, block_ids=700)
    got = [tuple(r) for r in token_store.read_store(spark, path).orderBy("start").collect()]
    want, start = [], 0
    for d, x in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    back = dict(token_store.read_ids(spark, path).where("doc_id = 1000").first().asDict())
    assert back["ids"] == [0]


@given(st.lists(st.text(alphabet="ab the\u00e9\u4e2d\u00a0\u2003\n<|>1.,'\x7f\U0001f642", max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_byte_tokens_of_any_texts(texts):
    import pyarrow as pa

    path = tokenizer_path(BYTE_MODEL)
    texts = [*texts, *(t + " <|endoftext|> the" for t in texts)]
    flat, n = token_store.encode_texts(path, *textscan.text_bytes(pa.array(texts, pa.string())))
    want = [token_store.tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]
    ends = np.cumsum(n)
    assert [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == want


@given(st.lists(st.one_of(st.integers(0, 2**40), st.integers(0, 2**64 - 1), st.integers(0, 9)), max_size=200))
@settings(max_examples=80, deadline=None)
def test_elias_fano_select(values):
    values = sorted(values)
    e = token_store.EliasFano.of(np.array(values, np.uint64))
    assert e.select(np.arange(len(values))).tolist() == values
    assert all(e.select(np.array([i, 0, i])).tolist() == [v, values[0], v] for i, v in enumerate(values))


def test_token_store_of_no_rows(spark):
    path = new_table_path(spark, "test-store")
    token_store.write_store(table(spark, [], "doc_id long, text string"), tokenizer_path(BYTE_MODEL), path)
    assert token_store.read_store(spark, path).count() == 0


# --- 8: n-gram join


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(docs):
    sets = [shingle_set(t) for _, t in docs]
    n = len(docs)
    near = [[k for k in range(n) if k != i and sets[i] and len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) - 1e-9] for i in range(n)]
    out = []
    for i in range(n):
        comp, todo = {i}, [i]
        while todo:
            new = [k for k in near[todo.pop()] if k not in comp]
            comp.update(new)
            todo += new
        ids = [docs[k][0] for k in comp if docs[k][0] is not None]
        out.append((docs[i][0], min(ids) if ids else None, len(near[i])))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def copies(rng):
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for b in range(12):
        base = list(rng.choice(vocab, int(rng.integers(3, 200))))
        for _ in range(int(rng.integers(1, 9))):
            mine = list(base)
            for _ in range(int(rng.integers(0, 4))):
                mine[int(rng.integers(len(mine)))] = str(rng.choice(vocab))
            docs.append((len(docs), " ".join(mine)))
    return docs + [(900, None), (901, ""), (902, "..."), (903, "one"), (904, "One!"), (None, docs[0][1]), (905, docs[0][1]), (905, docs[0][1])]


@pytest.mark.parametrize("block", [4096, 3])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CHECKED", block)
    docs = copies(np.random.default_rng(5))
    got = rows(ngram_join.ngram_join(table(spark, [(*d, "x") for d in docs], "doc_id long, text string, class string")), "doc_id", "class_id", "n_links")
    assert got == linked(docs)


def test_keep_one_of_each_group(spark):
    docs = copies(np.random.default_rng(6))
    got = rows(ngram_join.keep_one(table(spark, [(*d, "x") for d in docs], "doc_id long, text string, class string")), "doc_id", "class")
    groups = {(d, c) for d, c, _ in linked(docs)}
    first = [d for d, c in groups if d is not None and d == c]
    assert [d for d, _ in got] == sorted(first, key=str)


def test_posterior_floor_is_a_binomial_tail():
    floor = ngram_join.least_matches(0.8, 1e-6)
    assert floor[0] == 0 and all(a <= b <= a + 1 for a, b in zip(floor, floor[1:], strict=False)) and 0.4 < floor[-1] / ngram_join.HASHES < 0.7


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(500 + i, 501 + i) for i in range(40)]
    got = dict(tuple(r) for r in components(table(spark, edges, "a long, b long"), Scratch(spark), "test").collect())
    forest = {x: x for e in edges for x in e}

    def find(x):
        return x if forest[x] == x else find(forest[x])

    for a, b in edges:
        a, b = find(a), find(b)
        forest[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in forest if any(x in e and e[0] != e[1] for e in edges)}
    assert components(table(spark, [], "a long, b long"), Scratch(spark), "test").count() == 0


# --- 9: toxicity


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    lexicon, trees = toxicity.learn(docs, labels, ~held)
    odd = docs.union(table(spark, [(-1, None, None, None, None), (-2, "", None, None, None), (-2, "", None, None, None)], docs.schema))
    scored = toxicity.score_toxicity(odd, lexicon, trees)
    assert scored.count() == docs.count() + 3 and scored.where("not (score between 0 and 1) or score is null").count() == 0
    test = scored.join(labels.where(held), "doc_id").select("score", "toxic").toPandas()
    right, toxic = test.score >= 0.3, test.toxic == 1
    assert (right & toxic).sum() / right.sum() > 0.85 and (right & toxic).sum() / toxic.sum() > 0.7


def dense_features(text, odds, beginnings):
    """The features of one text, word by word and byte by byte."""
    plain, ws = (text or "").encode(), [w.encode() for w in words(text)]
    told = [odds.get(w, 0.0) for w in ws]
    begun = [max([beginnings.get(w[:n], 0.0) for n in toxicity.BEGINNINGS if len(w) > n] + [0.0]) for w in ws]
    hit = [a > 0 or b > 0 for a, b in zip(told, begun, strict=True)]
    you = [w.decode() in toxicity.SECOND_PERSON for w in ws]
    near = [h and any(you[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k, h in enumerate(hit)]
    masked = [odds.get(w, 0.0) > 0 for w in plain.translate(toxicity.LOOK_ALIKE).split()]
    letter = [65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in plain]
    mark = [32 < b < 127 and not x and not 48 <= b <= 57 for b, x in zip(plain, letter, strict=True)]
    inside = [0 < k < len(plain) - 1 and b in b"0134579@$*!#%&_" and letter[k - 1] and letter[k + 1] for k, b in enumerate(plain)]
    same = [k > 1 and letter[k] and plain[k] == plain[k - 1] == plain[k - 2] for k in range(len(plain))]
    n, size, letters = max(1, len(ws)), max(1, len(plain)), max(1, sum(letter))
    upper = sum(65 <= b <= 90 for b in plain)
    return [
        sum(hit) / n, np.log1p(sum(hit)), sum(told) / n, sum(begun) / n, np.log1p(sum(b > 0 for b in begun)), max(0, sum(masked) - sum(o > 0 for o in told)),
        sum(near) / max(1, sum(hit)), sum(you) / n, upper / letters, plain.count(b"!") / size, plain.count(b"?") / size, sum(mark) / size, sum(inside) / letters, sum(same) / letters, np.log1p(n),
    ]


def test_toxic_features_equal_brute_force():
    import pyarrow as pa

    odds, starts = {b"fool": 2.0, b"vile": 3.5, b"dolt": 2.5}, {b"idio": 4.0, b"scumb": 2.2}
    keys = [(toxicity.keyed(toxicity.hashes_of([w.decode()]), 0), v) for w, v in odds.items()] + [(toxicity.keyed(toxicity.hashes_of([w.decode()]), len(w)), v) for w, v in starts.items()]
    lexicon = toxicity.Lexicon(np.concatenate([k for k, _ in keys]), np.array([v for _, v in keys]))
    rng = np.random.default_rng(12)
    parts = ["you", "FOOL", "f00l", "v1le!", "idiotic", "scumbag", "idio", "the", "sooo", "dolt??", "\u00e9t\u00e9", "1x", "a", "7", "du"]
    texts = ["", None, "a", "1", "aa", "aaa", "x1", "1x"] + [" ".join(rng.choice(parts, int(rng.integers(1, 40)))) for _ in range(60)] + ["a", "1x1", "zzz"]
    got = toxicity.features(*textscan.text_bytes(pa.array(texts)), lexicon)
    np.testing.assert_allclose(got, [dense_features(t, odds, starts) for t in texts], atol=1e-9)
    np.testing.assert_allclose(got, [toxicity.features(*textscan.text_bytes(pa.array([t], pa.string())), lexicon)[0] for t in texts], atol=1e-9)


def test_a_tree_takes_the_best_splits():
    rng = np.random.default_rng(13)
    b = rng.integers(0, 5, (80, 3))
    grad, hess = rng.normal(size=80) + (b[:, 1] > 2), rng.uniform(0.1, 0.25, 80)
    feature, cut, leaf, at = toxicity._tree(b, grad, hess)

    def gain(mine, j, c):
        left = mine & (b[:, j] <= c)
        right = mine & ~left
        if hess[left].sum() <= 1 or hess[right].sum() <= 1:
            return 0.0
        part = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1)
        return part(left) + part(right) - part(mine)

    node = np.zeros(80, int)
    for n in range(2**toxicity.DEPTH - 1):
        mine = node == n
        best = max(gain(mine, j, c) for j in range(3) for c in range(5))
        assert gain(mine, feature[n], cut[n]) == pytest.approx(max(best, 0)) or best <= 1e-6
        node[mine] = 2 * n + 1 + (b[mine, feature[n]] > cut[n])
    assert (at == node - (2**toxicity.DEPTH - 1)).all()
    for k in range(2**toxicity.DEPTH):
        assert leaf[k] == pytest.approx(toxicity.RATE * grad[at == k].sum() / (hess[at == k].sum() + 1))


def test_toxicity_with_clashing_columns_and_repeated_rows(spark):
    docs = table(spark, [(i, f"vile fool {i}" if i % 2 else f"kind word {i}", 1.0, 2) for i in range(60)] * 2, "doc_id long, text string, score double, t int")
    labels = table(spark, [(i, i % 2, "x") for i in range(60)] + [(1, 0, "x"), (2, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.learn(docs, labels)
    out = toxicity.score_toxicity(docs, *model, keep=("score", "t"), score_name="tox").collect()
    assert len(out) == 120 and all((r.tox > 0.5) == bool(r.doc_id % 2) and (r.score, r.t) == (1.0, 2) for r in out)
    assert toxicity.score_toxicity(docs.limit(0), *model).count() == 0


def test_toxicity_without_both_labels(spark):
    docs = table(spark, [(1, "a b"), (2, None)], "doc_id long, text string")
    for data, want in (([], 0.0), ([(1, 1), (2, None), (None, 1), (9, 0)], 1.0)):
        model = toxicity.learn(docs, table(spark, data, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score_toxicity(docs, *model).collect()} == {want}


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_isotonic_is_the_least_squares_fit(pairs):
    x, y = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    kinds = np.unique(x)
    fitted = np.interp(kinds, *toxicity.isotonic(x, y))
    for k, at in enumerate(kinds):  # the largest over beginnings of the smallest over ends of the means between
        want = max(min(y[(x >= a) & (x <= z)].mean() for z in kinds[k:]) for a in kinds[: k + 1])
        assert fitted[k] == pytest.approx(want), at


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_isotonic_is_monotone_and_keeps_the_mean(pairs):
    x, y = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    at, value = toxicity.isotonic(x, y)
    fitted = np.interp(x, at, value)
    assert (np.diff(value) >= 0).all() and abs(fitted.mean() - y.mean()) < 1e-9


# --- 10: URLs


def judged(url, listed):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[2]
    root = re.sub("^www[.]", "", host)
    root = root.removesuffix({"http": ":80", "https": ":443"}.get((url or "").split("://")[0].lower(), "?"))
    whole = root + path.removesuffix("/") + ((m[3] or "") if m else "") if m else url
    return host, path, None, "block" if root in listed or whole in listed else "allow"


def test_url_verdicts_equal_brute_force(spark):
    hosts = ["Example.com", "a.example.net", "net", "spam.org", "www.Spam.org:80", "x.spam.org", "com", "notcom", ""]
    paths = ["", "/", "/en/", "/en/7", "/de/8/x", "/de/", "/es/q?x=1", "/p/1", "/p/1/", "/p/1#f"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "://", "http://a\nb/en/", "x://com?/en/"]
    pages = table(spark, [(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[0], "r")], "page_id long, url string, rule string")
    listed = {"spam.org", "net/p/1", "a.example.net/p/1"} | {f"other{i}.org/x" for i in range(3000)}
    for names, blocks in ((listed, 64), (listed, 1), (set(), 8)):
        out = url_filter.judge_urls(pages, table(spark, [(u,) for u in names] + [(None,)], "url string"), RULES, max_blocks=blocks)
        got = rows(out, "page_id", "host", "path", "rule", "verdict")
        want = [(i, *judged(u, names)) for i, u in [*enumerate(urls), (0, urls[0])]]
        assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    plan = url_filter.judge_urls(pages, table(spark, [("a.org",)], "url string"), RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert url_filter.judge_urls(pages.limit(0), table(spark, [], "url string"), []).count() == 0


# --- queries against their SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert got == sorted(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall())) and got


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_over_the_whole_table(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).collect()) == ids


def test_ngram_join_of_no_rows(spark):
    none = table(spark, [], "doc_id long, text string")
    assert ngram_join.ngram_join(none).count() == 0 and ngram_join.keep_one(none).count() == 0
