"""The corpus pipeline: each stage on its own input, against brute force."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomvec.llm import textscan, toxicity
from loomvec.llm.common import crc32_of_id, drop_tables, tables
from loomvec.llm.queries import PIECE_MODEL, TOXIC_AT, tokenizer_path
from tests.llm.test_operators import contaminated, copies, deduped, linked

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_hit int"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1) for d, t in docs], SCHEMA)


def test_line_stage_drops_documents_without_a_line_left(spark):
    docs = [(i, t) for i, t in copies(np.random.default_rng(8))[:40]] + [(900, ""), (901, None)]
    out = corpus_pipeline.drop_repeated_lines(spark, frame(spark, docs), SF)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    want = [(d, t) for d, t, n, gone in deduped(docs) if not (gone and gone == n)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_near_copy_stage_keeps_one_of_each_group(spark):
    docs = copies(np.random.default_rng(9))
    out = corpus_pipeline.keep_one_of_near_copies(spark, frame(spark, docs), SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for d, c, _ in linked(docs) if c is not None})


def test_decontamination_stage_keeps_the_clean(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(900, items[0][1]), (901, None)]
    out = corpus_pipeline.drop_contaminated(spark, frame(spark, docs), SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in contaminated(docs, items) if not r[5])


def test_toxic_stage_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert left.columns == docs.columns
    kept = {r.toxic: r["count"] for r in left.join(labels, "doc_id").groupBy("toxic").count().collect()}
    all_ = {r.toxic: r["count"] for r in docs.join(labels, "doc_id").groupBy("toxic").count().collect()}
    assert kept[0] > 0.99 * all_[0] and kept.get(1, 0) < 0.3 * all_[1]


def test_run_equals_the_stages_by_brute_force(spark):
    import sentencepiece

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    before = tables(spark)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    new = [p for p in tables(spark) if p not in before]
    assert len(new) == 1  # the last stage's, which the result reads
    drop_tables(spark, new)
    lexicon, trees = toxicity.learn(docs, labels, crc32_of_id(F.col("doc_id")) % 4 != 2)
    left = []
    for r in docs.collect():
        x = toxicity.features(*textscan.text_bytes(pa.array([r.text], pa.string())), lexicon)
        if trees.score(x)[0] < TOXIC_AT:
            left.append((r.doc_id, r.text))
    left = [(d, t) for d, t, n, gone in deduped(left) if not (gone and gone == n)]
    least = {c for _, c, _ in linked(left)}
    left = [(d, t) for d, t in left if d in least]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in contaminated(left, items) if not r[5]}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    assert got == {d: library.encode(t or "") for d, t in left if d in clean}


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, k):
    assert corpus_pipeline.STAGES[k][1](spark, frame(spark, []), SF).count() == 0
