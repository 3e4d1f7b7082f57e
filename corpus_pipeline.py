"""The corpus pipeline: five operators in a row over ``documents``, each on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import Written, packed, unpacked
from loomline.llm.line_dedup import dedup_lines
from loomline.llm.mixing import mix
from loomline.llm.ngram_join import keep_one
from loomline.llm.packing import pack
from loomline.llm.quality import score_quality

#: The columns of documents; other columns that a table has pass through the stages unchanged.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3.

    The score is one of the whole text alone, so repeated rows share their fate and null text counts as empty; a null
    doc_id is scored like any other. Columns of any name stay, an empty table stays empty.
    """
    own = [c for c in COLUMNS if c in docs.columns]
    scored = score_quality(packed(docs, own), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*unpacked(docs.columns, own))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that at least five of them hold; n_chars follows.

    Null text becomes empty; repeated rows of a doc_id are one document when documents are counted, and each stays; a null
    doc_id is a document below all others. Columns of any name stay, an empty table stays empty.
    """
    own = [c for c in COLUMNS if c in docs.columns]
    deduped = dedup_lines(packed(docs, own)).withColumn("n_chars", F.length("text").cast("long"))
    return deduped.select(*unpacked(docs.columns, own))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): one with the smallest doc_id.

    A row goes only if the row that stays has the same words or is linked to it, directly or through others; rows that repeat
    a doc_id with other words, and null doc_ids, are documents of their own. Texts without words all stay, null ones too.
    """
    return keep_one(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token mass follows the target marginals of source, language and topic.

    Rows of one doc_id (null among them) share their fate; null source or language is a category; texts without words take
    their cell's probability. Columns of any name stay, an empty table stays empty.
    """
    own = [c for c in COLUMNS if c in docs.columns]
    return mix(packed(docs, own)).where("selected").select(*unpacked(docs.columns, own))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids.

    Null and empty texts give a piece of one token, repeated rows are packed each, other columns are left out.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the classifier, the tokenizer or the raking; tests/llm holds a brute-force version of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's output written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
