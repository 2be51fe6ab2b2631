"""A corpus pipeline over ``documents``: five filtering and encoding stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and
returns a DataFrame; all but the last return the columns of documents. ``run`` writes and
rereads the result of each stage as Parquet in the shared folder.

No SQL can express the first, second and last stage; tests hold each against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.llm import decontaminate, line_dedup, ngram_join, piece_bpe, toxicity
from loomvec.llm.common import Scratch, crc32_of_id, drop_tables, read, tables
from loomvec.llm.queries import PIECE_MODEL, TOXIC_AT, tokenizer_path

OWN = "__lv_"  # before the names of columns that a stage adds for itself


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; an empty text is judged by its features."""
    lexicon, trees = toxicity.learn(docs, read(spark, sf_dir, "labels"), crc32_of_id(F.col("doc_id")) % 4 != 2)
    scored = toxicity.score_toxicity(docs, lexicon, trees, keep=_others(docs), with_text=True, score_name=f"{OWN}score")
    return scored.where(F.col(f"{OWN}score") < TOXIC_AT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; one that loses all its lines goes. n_chars follows."""
    out = line_dedup.dedup_lines(docs, keep=_others(docs), prefix=OWN)
    out = out.where((F.col(f"{OWN}n_removed") == 0) | (F.col(f"{OWN}n_removed") < F.col(f"{OWN}n_lines")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(f"{OWN}n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by five-word shingles."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words lie in benchmark windows."""
    out = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), keep=(*_others(docs), "text"), prefix=OWN)
    return out.where(~F.col(f"{OWN}contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the ids of each text."""
    return piece_bpe.encode_pieces(docs, tokenizer_path(PIECE_MODEL), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("piece_encoding", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of the tables on the way only the last one stays, which the result reads."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        before = tables(spark)
        docs = scratch.write(stage(spark, docs, sf_dir), "stage")
        drop_tables(spark, [p for p in tables(spark) if p not in before and p != scratch.paths["stage"]])
    return docs
