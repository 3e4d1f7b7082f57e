"""Request files: JSON lines, raw rows, mixed formats, CSV, edge lists, zip members, images; and their writers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import state_hash
from loomline.operators.requests import REQUEST


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, line number within the file's split order, value) of non-blank lines; only \\n ends a line."""
    text = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return text.where(F.trim("value") != "")


def read_requests(spark: SparkSession, path, strict: bool = True) -> DataFrame:
    """Typed requests from JSON lines; a missing group_id becomes the state's hash. Fields outside the model are ignored.

    ``strict``: a broken line raises, naming its file; else broken lines come back with null columns and ``corrupt``.
    An input without any line is an error when ``strict``, else it gives no rows.
    """
    lines = _lines(spark, path)
    if strict and lines.isEmpty():
        raise ValueError(f"no request in {path}")
    parsed = lines.withColumn("r", F.from_json("value", REQUEST))
    broken = F.col("r").isNull() | F.col("r.state").isNull()
    if strict:
        parsed = parsed.where(F.when(broken, F.raise_error(F.concat(F.lit("not a request in "), "file", F.lit(": "), F.substring("value", 1, 80))).cast("boolean")).otherwise(True))
    out = parsed.select("r.state", F.coalesce(F.nullif("r.group_id", F.lit("")), state_hash(F.col("r.state"))).alias("group_id"), "r.questions", F.when(broken, F.col("value")).alias("corrupt"))
    return out.drop("corrupt") if strict else out


def read_raw(spark: SparkSession, path) -> DataFrame:
    """Rows with all their keys: the JSON text and a map of its top-level fields."""
    return _lines(spark, path).select(F.from_json("value", "map<string,string>").alias("fields"), F.col("value").alias("json"))


def read_mixed(spark: SparkSession, path) -> DataFrame:
    """(format, json): next_click rows have ``context``, benchmark rows ``labels``, requests neither."""
    keys = F.json_object_keys("value")
    kind = F.when(F.array_contains(keys, "context"), "next_click").when(F.array_contains(keys, "labels"), "benchmark").otherwise("request")
    return _lines(spark, path).select(kind.alias("format"), F.col("value").alias("json"))


def read_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV with a header and quoted line ends; the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_edges(spark: SparkSession, path, schema: str = "source string, target string") -> DataFrame:
    """A tab-separated edge list with # comments."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def read_zip_lines(spark: SparkSession, path, member: str = ".jsonl") -> DataFrame:
    """(archive, member, line) of members whose name ends with ``member``; a damaged archive raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if bad := z.testzip():
                        raise ValueError(f"damaged member {bad} in {name}")
                    for m in sorted(n for n in z.namelist() if n.endswith(member)):
                        with z.open(m) as f:
                            while lines := f.readlines(1 << 20):
                                texts = [x.decode().rstrip("\n") for x in lines if x.strip()]
                                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array([m] * len(texts), pa.string()), pa.array(texts, pa.string())], ["archive", "member", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line string")


def read_images(df: DataFrame, base64: str = "base64", path: str = "path") -> DataFrame:
    """Decode image columns: exactly one of base64 and path; strict decoding (a bad text raises)."""
    one = F.col(base64).isNotNull() != F.col(path).isNotNull()
    return df.where(F.when(~one, F.raise_error(F.lit("an image needs exactly one of path and base64")).cast("boolean")).otherwise(True)).withColumn("data", F.unbase64(base64))


def write_requests(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8 as it is; an existing path is an error, and so is a NaN target."""
    nan = F.exists(F.flatten(F.transform("questions", lambda q: F.coalesce(q["target"], F.array().cast("array<double>")))), lambda x: F.isnan(x))
    checked = df.where(F.when(nan, F.raise_error(F.lit("a target is NaN")).cast("boolean")).otherwise(True))
    checked.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than ``limit`` rows are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table of more than {limit} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    body = ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *body])
