"""Operator 3, line dedup, in DataFrame functions only.

Lines are exploded and hashed once (a written table of 40 bytes a line, without text). Distinct documents are
counted for each hash with two partial aggregations, so a line that a third of all documents hold costs no task
more than others. Lines over the threshold go back to their documents as lists of positions, and each document
is put together again from the positions that remain.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import Written, broadcast_if_small, packed, quoted, unpacked

#: Tasks over which the lines of one key are dealt when they meet the keys to drop.
SALTS = 16
#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A stripped line with A-Z lower-cased. lower() is exact, and much faster than translate(), on ASCII."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and the columns n_lines and n_dropped.

    A line's key is the line stripped of blanks and A-Z lower-cased. Keys of at least ``min_chars`` code points that
    at least ``min_docs`` distinct documents hold lose all their lines except in the largest doc_id that holds them.
    Null and empty texts are one empty line and become empty; rows that repeat a doc_id are one document when
    documents are counted, and each loses its lines; a null doc_id is a document below all others. Other
    columns are kept as they are, whatever their names (columns n_lines and n_dropped of the input are replaced).
    """
    columns, own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], ["doc_id", "text"]
    docs = packed(docs.select(*(quoted(c) for c in columns)), own)
    base = docs.select("doc_id", "__rest", F.coalesce("text", F.lit("")).alias("text"))
    row = F.xxhash64("text")  # tells apart rows that share a doc_id
    found = base.select("doc_id", row.alias("__row"), F.posexplode(F.split("text", "\n", -1)).alias("__pos", "__line"))
    stripped = found.select("doc_id", "__row", "__pos", F.btrim("__line", F.lit(BLANKS)).alias("__line"))
    long = stripped.where(F.char_length("__line") >= min_chars)
    lines = Written(long.select("doc_id", "__row", "__pos", F.unhex(F.md5(line_key(F.col("__line")))).alias("__key")), "lines")
    held = lines.df.select("__key", "doc_id").distinct().groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.max("doc_id").alias("__keeper"))
    common = held.where(F.col("__n") >= min_docs).select("__key", "__keeper")
    # A line that very many documents hold is dealt out over SALTS tasks; the keys over the threshold are repeated for it.
    salted = common.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "__row"), F.lit(SALTS)).cast("int")
    gone = lines.df.withColumn("__salt", salt).join(salted, ["__key", "__salt"]).where(~F.col("doc_id").eqNullSafe(F.col("__keeper")))
    gone = Written(gone.groupBy("doc_id", "__row").agg(F.collect_list("__pos").alias("__gone")), "gone")
    lines.drop()
    side = gone.df.select(F.col("doc_id").alias("__doc"), F.col("__row").alias("__text"), "__gone")
    side = broadcast_if_small(side, 64, extra=F.size("__gone") * 4)
    joined = base.withColumn("__row", row).join(side, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__text")), "left")
    split = F.split("text", "\n", -1)
    joined = joined.withColumn("n_lines", F.size(split).cast("long")).withColumn("n_dropped", F.coalesce(F.size(F.array_distinct("__gone")), F.lit(0)).cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    lines_kept = F.transform(kept, lambda p: F.get("__split", p))
    joined = joined.withColumn("__split", F.when(F.col("__gone").isNotNull(), split))
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(lines_kept, "\n"))).select(*unpacked(columns, own), "n_lines", "n_dropped")
