import hashlib
import re
from collections import defaultdict

from loomline.llm.line_dedup import dedup_lines


def brute(rows, min_chars, min_docs):
    key = lambda l: re.sub("[A-Z]", lambda m: m[0].lower(), l.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for l in (t or "").split("\n"):
            if len(key(l)) >= min_chars:
                held[key(l)].add(i)
    order = lambda i: (i is not None, i or 0)
    gone = {k: max(v, key=order) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [l for l in lines if key(l) not in gone or gone[key(l)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    from pyspark.sql import functions as F

    common, accent = "This LINE is common enough", "Straße ÀÉ Und Mehr Text hier"
    rows = [(i, f"own {i}\n  {common}\t\n{accent}\r\nshort\n{common.lower()}\n") for i in range(8)]
    rows += [(100, common), (101, None), (102, ""), (103, "\n\n"), (104, f"{accent.lower()}\n{accent}"), (5, f"{common}\nother row of 5"), (5, f"{common}\nother row of 5"), (None, f"{common}\nx")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_lines string, __n int")
    out = dedup_lines(df, 20, 5)
    assert out.columns == ["doc_id", "text", "__n", "n_lines", "n_dropped"]
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 20, 5)


def test_plan_is_native_and_empty_table(spark):
    out = dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_that_clash(spark):
    line = "a line that is long enough to be counted by documents"
    rows = [(i, f"own {i}\n{line}", "kept", i) for i in range(6)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, __row string, __key long")).orderBy("doc_id").collect()
    assert [(r["__row"], r["__key"], r["n_dropped"]) for r in out] == [("kept", i, int(i < 5)) for i in range(6)]
