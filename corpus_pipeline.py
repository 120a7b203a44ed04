"""A corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Stages are written as Parquet and read
again by whoever runs them, so each works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweave.llm.language import identify_rows
from gridweave.llm.lines import without_repeated_lines
from gridweave.llm.minhash import deduplicated
from gridweave.llm.mixing import emitted
from gridweave.llm.packing import best_fit_packing
from gridweave.llm.shared import saved, table

#: A document whose language is less sure than this is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is unsure, go; the others stay as they are."""
    found = identify_rows(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.where((F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; documents of which nothing but white space stays go. n_chars follows the text."""
    found = without_repeated_lines(docs, maximal=True)
    empty = (F.col("_n_deleted") > 0) & ~F.col("text").rlike(r"\S")
    return found.where(~empty).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id.

    Rows that share this id all stay. Documents with a null id, a null text or
    a text without words link with nothing and stay. An empty table stays
    empty; other columns pass through.
    """
    return deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null sources are one source, the last. Null and wordless texts have size 0
    and are taken as often as others; a source of such texts alone is not taken
    at all. Null ids stand by their texts; repeated rows count one by one. An
    empty table stays empty; other columns pass through, but for those under
    the names that the mix adds.
    """
    return emitted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens.

    A null text is an empty one, of the end id alone; null ids come back as
    null, repeated rows are packed each for itself, longer documents are cut.
    Only id and text are read. An empty table gives no rows.
    """
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Language models, suffix arrays and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
