"""The registered queries of this subpackage, each over its whole table, and the SQL for those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("text")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.quality import score_quality

    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "topic", "weight", "probability", "selected")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_license_scan, op3_line_dedup, op4_token_counts, op5_quality_classifier, op6_embedding_near_dedup, op7_mixing, op8_html_extraction, op9_ngram_jaccard_join, op10_exact_top_k,
    )
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        line AS (SELECT r, doc_id, u.i AS i, ls[u.i] AS l FROM doc, unnest(range(1, len(ls) + 1)) AS u(i)),
        stripped AS (SELECT *, regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS s FROM line),
        keyed AS (SELECT *, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM stripped),
        common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        told AS (SELECT r, keyed.doc_id, i, l, keeper IS NOT NULL AND keyed.doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM told GROUP BY r, doc_id""",
    "op6_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
        comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
        SELECT comp.x AS vec_id, coalesce(n_links, 0) AS n_links, component_id, comp.x = component_id AS kept FROM comp LEFT JOIN n USING (x)""",
    "op10_exact_top_k": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
