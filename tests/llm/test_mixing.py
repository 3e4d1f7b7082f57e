import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm.mixing import calibrate, mix, rake


def docs(spark):
    rows = []
    for i in range(600):
        src = "big" if i % 3 else f"s{i % 5}"
        text = " ".join(["word"] * (20 + i % 30)) + (" x | y" if i % 4 == 0 else "")
        rows.append((i, text, "en" if i % 2 else "de", src, len(text), "keep"))
    rows += [(1000, None, None, None, 0, None), (1001, "", "en", "big", 0, None), (7, rows[7][1], "en", "big", 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, weight string")


def test_raked_marginals():
    rng = np.random.default_rng(0)
    tokens = rng.uniform(1, 100, 24)
    margins = [np.arange(24) % 4, np.arange(24) // 4 % 3, np.arange(24) // 12]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.6, 0.4])]
    mass = rake(tokens, margins, targets)
    for at, target in zip(margins, targets, strict=True):
        assert np.allclose(np.bincount(at, mass), target, atol=1e-8)
    p = calibrate(tokens, mass / tokens, 0.4 * tokens.sum())
    assert abs((p * tokens).sum() - 0.4 * tokens.sum()) < 1e-6 and p.max() <= 1


def test_mix(spark):
    out = mix(docs(spark), keep=0.5).collect()
    assert len(out) == 603
    total = sum(r.n_tokens for r in out)
    assert abs(sum(r.probability * r.n_tokens for r in out) - 0.5 * total) < 0.01 * total
    chosen = sum(r.n_tokens for r in out if r.selected)
    assert abs(chosen - 0.5 * total) < 0.15 * total
    assert len({r.selected for r in out if r.doc_id == 7}) == 1
    assert next(r for r in out if r.doc_id == 1000).n_tokens == 0


def test_tables_equal_driver(spark):
    a = {r.doc_id: r.weight for r in mix(docs(spark)).collect()}
    b = {r.doc_id: r.weight for r in mix(docs(spark), driver_cells=0).collect()}
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, rel=1e-3, abs=1e-9) for k, v in a.items())


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def slow_cells(spark):
    rows = []
    for i in range(40):
        a, b = ("x", "p") if i < 36 else ("x", "q") if i < 38 else ("y", "p") if i == 38 else ("y", "q")
        rows.append((i, "w " * (50 + i), b, a))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_tables_stop_by_the_rule_of_the_driver(spark):
    shares = {"source_shares": {"x": 0.5, "y": 0.5}, "lang_shares": {"p": 0.45, "q": 0.55}}
    a = {r.doc_id: (r.weight, r.probability, r.selected) for r in mix(slow_cells(spark), **shares).collect()}
    b = {r.doc_id: (r.weight, r.probability, r.selected) for r in mix(slow_cells(spark), **shares, driver_cells=0).collect()}
    assert all(b[k][:2] == pytest.approx(v[:2], rel=1e-8) and b[k][2] == v[2] for k, v in a.items())


def test_both_ways_refuse_shares_of_no_category(spark):
    for cells in (0, 100):
        with pytest.raises(ValueError, match="no category"):
            mix(slow_cells(spark), source_shares={"nowhere": 1.0}, driver_cells=cells)


def test_raking_that_does_not_converge_warns():
    with pytest.warns(RuntimeWarning, match="not converged"):
        rake(np.array([1.0, 1.0]), [np.array([0, 1]), np.array([0, 1])], [np.array([0.5, 0.5]), np.array([0.9, 0.1])])


def test_against_brute_force(spark):
    import brute

    docs = []
    for i in range(400):
        text = ["the licensed text", "mail a@b", "a | b", "x = {y}", "plain prose words"][i * i % 5] + " word" * (i * 7 % 23)
        docs.append((i if i % 40 else i // 80, text, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i * 3 % 7 % 4]))
    docs += [(500, None, None, None), (None, "", "en", "s1"), (None, "words here", "en", "s1"), docs[3]]
    got = mix(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("__n", F.lit(1)).withColumn("__p", F.lit("x")))
    assert got.columns[:6] == ["doc_id", "text", "lang", "source", "__n", "__p"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = sorted(((d[0], d[1], *m) for d, m in zip(docs, brute.mixed(docs))), key=key)
    for r, w in zip(sorted(got.select("doc_id", "text", "weight", "probability", "selected").collect(), key=key), want, strict=True):
        assert r[:2] == w[:2] and r["weight"] == pytest.approx(w[2], rel=1e-6) and r["probability"] == pytest.approx(w[3], rel=1e-6) and r["selected"] == w[4]
