import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toArrow())
        counts.append(docs.count())
        assert counts[-1] <= counts[-2], name
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and 0 < counts[4] < counts[3]
    lengths = docs.select("doc_id", F.col("n_chars") == F.length("text")).where("NOT (n_chars = length(text))").count()
    assert lengths == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == counts[4]


def test_empty_and_null_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()))
def test_queries_run(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.count() > 0


def test_against_brute_force(spark, tmp_path):
    """The whole pipeline on a small table with repeated ids, nulls and clashing names, against plain versions of its stages."""
    import brute
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomline.llm.quality import train

    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    some = [r for r in base if r[1] and len(r[1]) > 300][:60]
    changed = [(1000 + i, r[1] + " and one more word", r[2], r[3]) for i, r in enumerate(some[:12])]
    shared = "this very line stands in many of the documents of this table"
    lined = [(2000 + i, f"{r[1]}\n  {shared.upper() if i % 2 else shared} ", r[2], r[3]) for i, r in enumerate(some[12:24])]
    odd = [(some[0][0], some[30][1], "en", "s"), some[1], (None, some[31][1], None, "s"), (None, some[32][1], "de", "s"), (3000, None, "en", "s"), (3001, "", "en", "s"), (3002, "###", "en", "s")]
    rows = base + changed + lined + odd
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "n", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __gone string, score int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = train(docs, labels)
    close = [r for r in rows if abs(brute.score(model, r[1] or "") - 0.3) < 1e-4]
    assert not close  # none whose fate hangs on rounding
    left = [r for r in rows if brute.score(model, r[1] or "") >= 0.3]
    assert 20 < len(left) < len(rows)
    left = [(r[0], t, *r[2:]) for r, t in zip(left, brute.kept_lines([r[:2] for r in left]), strict=True)]
    assert sum(shared in r[1].lower() for r in left) < 3
    # One row of each class: the smallest id, null last; among rows without words all.
    order = sorted(range(len(left)), key=lambda i: (left[i][0] is None, left[i][0] or 0))
    root = brute.classes([left[i][1] for i in order])
    first = {c: left[order[c]][0] for c in root}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    near = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(*r, len(r[1]), "n", 1) for r in left], docs.schema), SF)
    kept = [tuple(r)[:4] for r in near.collect()]
    assert near.columns == docs.columns and len(kept) == len(set(root))
    place = {left[i]: c for i, c in zip(order, root)}
    assert {place[r] for r in kept} == set(root) and all(r[0] == first[place[r]] for r in kept)
    chosen = [r for r, m in zip(kept, brute.mixed(kept), strict=True) if m[2]]
    assert 0 < len(chosen) < len(kept)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(([*plain.encode(r[1], add_special_tokens=False).ids, 1] for r in chosen))
    cells, by_doc = {}, {}
    for r in out:
        cells.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["sequence_id"] * 2048 + r["offset"] - r["start"]), []).append((r["start"], bytes(r["ids"])))
    import numpy as np

    assert sorted(np.frombuffer(b"".join(ids for _, ids in sorted(p)), np.uint32).tolist() for p in by_doc.values()) == want
    for k, own in cells.items():
        stops = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *stops[:-1]] and (stops[-1] == 2048 or k == max(cells))
