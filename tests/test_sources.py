import zipfile

import pytest
from pyspark.sql import functions as F

from loomline.operators import requests as Q
from loomline.sources import requests as SRC
from loomline.sources.links import page_links
from loomline.streaming.events import bucket_step


def test_requests_round_trip(spark, tmp_path):
    q = F.array(Q.noul("t", "Toxic?", F.lit(0.25)))
    df = spark.createDataFrame([("a b", ""), ("c", "x:1")], "state string, group_id string").withColumn("questions", q)
    path = f"file://{tmp_path}/out"
    SRC.write_requests(df, path)
    rows = {r.state: r for r in SRC.read_requests(spark, path).collect()}
    assert rows["c"].group_id == "x:1" and len(rows["a b"].group_id) == 64 and rows["c"].questions[0].target == [0.75, 0.25]
    with pytest.raises(Exception, match="(?i)exist"):
        SRC.write_requests(df, path)
    assert SRC.file_manifest(spark, path).where("file LIKE 'part%'").count() >= 1


def test_broken_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"state":"s","group_id":"g","questions":[]}\n\n{broken\n')
    assert SRC.read_requests(spark, str(tmp_path), strict=False).where("corrupt IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="r.jsonl"):
        SRC.read_requests(spark, str(tmp_path)).collect()


def test_mixed_csv_edges_zip(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"context":"c","options":[],"label":0}\n{"state":"s x","labels":["a"]}\n{"state":"s"}\n')
    assert sorted(r.format for r in SRC.read_mixed(spark, str(tmp_path / "m.jsonl")).collect()) == ["benchmark", "next_click", "request"]
    assert SRC.read_raw(spark, str(tmp_path / "m.jsonl")).count() == 3
    (tmp_path / "c.csv").write_text('text,category\n"two\nlines, ""q""",x\n')
    assert SRC.read_csv(spark, str(tmp_path / "c.csv"), "text string, category string").first().text == 'two\nlines, "q"'
    (tmp_path / "e.tsv").write_text("# note\na\tb\n")
    assert [tuple(r) for r in SRC.read_edges(spark, str(tmp_path / "e.tsv")).collect()] == [("a", "b")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/x.jsonl", "1\n\n2\n")
        z.writestr("other.txt", "no")
    assert [r.line for r in SRC.read_zip_lines(spark, str(tmp_path / "z.zip")).orderBy("line").collect()] == ["1", "2"]


def test_images_links_markdown_bucket(spark):
    df = spark.createDataFrame([("aGk=", None), (None, "x.png")], "base64 string, path string")
    assert [bytes(r.data) if r.data else None for r in SRC.read_images(df).collect()] == [b"hi", None]
    with pytest.raises(Exception, match="exactly one"):
        SRC.read_images(spark.createDataFrame([("aGk=", "x")], "base64 string, path string")).collect()
    pages = spark.createDataFrame([(1, '<a href="/a">a</a><a class=x href="/b#f">b</a><a href="/a">c</a><a href="//h/z">d</a>'), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.href) for r in page_links(pages).collect()] == [(1, "/a")]
    assert SRC.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double")) == "| a | b |\n|---|---|\n| 1 | 0.5000 |"
    tokens, ok, wait = bucket_step(0.0, 10.0, 10.5, 1.0, 3.0)
    assert not ok and wait == 0.5 and bucket_step(tokens, 10.5, 11.0, 1.0, 3.0)[1]
