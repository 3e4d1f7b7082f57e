import numpy as np

from loomline.llm.common import Written
from loomline.llm.forest import _router, fit_forest, near_duplicates, split_large, unit
from loomline.llm.topk import threshold_top_k, top_k


def vectors(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    third = slice(100, 100 + n // 3)
    x[third] = x[100] + 0.05 * rng.standard_normal((n // 3, 16))  # near copies
    if n > 510:
        x[500:510] = x[500]
    return x.astype(np.float32)


def rows_of(x):
    out = [(i, [float(v) for v in row], "n") for i, row in enumerate(x)]
    return out + [(2000, None, "n"), (2001, [0.0] * 16, "n"), (2002, [float("nan")] * 16, "n"), (2003, [None] + [1.0] * 15, "n"), (2004, [1.0, 2.0], "n"), (2005, [2.0, 4.0], "n"), (None, [1.0, 2.0], "n"), (5, out[5][1], "n"), (2006, [], "n")]


def test_near_duplicates(spark):
    x = vectors().astype(float)
    df = spark.createDataFrame(rows_of(x), "vec_id long, embedding array<float>, n_links string")
    out = near_duplicates(df, leaf=60, block=64, sample_rows=300).collect()
    assert len(out) == len(rows_of(x))
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    got = {r.vec_id: r for r in out}
    want, found = int(hit.sum()), sum(got[i].n_links for i in range(len(x)))
    assert 0.99 * want <= found <= want
    assert got[250].component_id == min(np.flatnonzero(hit[250])) and not got[250].kept
    assert got[505].n_links == 9 and got[505].component_id == 500
    assert got[2004].n_links == 1 and got[2005].component_id == 2004
    for k in (2000, 2001, 2002, 2003, 2006):
        assert got[k].n_links == 0 and got[k].component_id == k and got[k].kept
    assert got[None].n_links == 0 and got[None].component_id is None
    assert sum(r.vec_id == 5 for r in out) == 2


def test_large_leaves_are_split_on(spark):
    """A table far beyond the sample: leaves end small but for copies, and links equal brute force."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 16)).astype(np.float32)
    x[3000:3600] = x[:600] + 0.04 * rng.standard_normal((600, 16)).astype(np.float32)
    x[5000:5300] = x[7]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    for n_trees, least in ((4, 0.99),):
        got = {r.vec_id: r for r in near_duplicates(df, leaf=24, block=64, sample_rows=64, n_trees=n_trees).collect()}
        found = np.array([got[i].n_links for i in range(len(x))])
        assert (found <= hit.sum(axis=1)).all() and least * hit.sum() <= found.sum()
    sample = unit([row.astype(np.float32).tobytes() for row in x[:64]], single=True)
    sent = spark.sparkContext.broadcast(fit_forest({16: sample}, {16: len(x)}, 3, 24, 0.03, 5))
    fine = df.selectExpr("vec_id AS id", "embedding AS vec")
    routed = Written(fine.mapInArrow(_router(sent, 0.03, True), "id long, dim int, vec binary, cells array<long>"), "routed")
    before = routed.df.selectExpr("explode(cells) AS c").groupBy("c").count().agg({"count": "max"}).first()[0]
    for together in (50_000, 2):
        after, sizes = split_large(Written(routed.df, "copy"), 24, 0.03, 5, True, cell_sample=128, together=together)
        cells = {r.id: r.cells for r in after.df.collect()}
        large = [r for r in sizes.df.collect() if r.n > 4 * 24]
        assert set(cells) == set(range(len(x))) and all(c == sorted(set(c)) and c for c in cells.values())
        assert before > 1000 and all(r.n < 500 for r in large) and len(large) <= 6
        assert cells[5000] == cells[5299] == cells[7]


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(none).count() == 0 and top_k(none).count() == 0


def brute(x, ids, every, k):
    q = np.floor(256 * x).astype(np.int64)
    out = []
    for i in [i for i in range(len(ids)) if ids[i] % every == 0]:
        s = sorted((-int(q[i] @ q[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out += [(int(ids[i]), r + 1, j, -v) for r, (v, j) in enumerate(s)]
    return sorted(out)


def test_top_k(spark):
    x = vectors(300, 2).astype(np.float32).astype(float)
    df = spark.createDataFrame([r for r in rows_of(x) if r[0] is None or r[0] < 2000 or r[0] in (2000, 2002, 2003)], "vec_id long, embedding array<float>, rank string")
    got = sorted(tuple(r) for r in top_k(df, block=64, query_block=2).collect())
    assert got == brute(x, np.arange(300), 50, 5)
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(few).collect()) == [(0, 1, 1, 131072), (0, 2, 2, -65536)]


def wanted(x, ids, queries, own, k):
    out, x, queries = [], x.astype(object), queries.astype(object)
    for q in range(len(queries)):
        out += [(q, j, -s) for s, j in sorted((-int(queries[q] @ x[i]), int(ids[i])) for i in range(len(x)) if ids[i] != own[q])[:k]]
    return out


def test_threshold_stops_early_and_right():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (4000, 3))
    found, scored = threshold_top_k(x, np.arange(4000), x[:20], np.arange(20), 5, together=7)
    assert scored < 20 * 4000 * 0.5 and found == wanted(x, np.arange(4000), x[:20], np.arange(20), 5)


def test_threshold_stops_early_where_dimensions_are_uneven():
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((3000, 64)) * np.array([200, 100, 50, *[0.5] * 61])).astype(np.int64)
    found, scored = threshold_top_k(x, np.arange(3000) * 2, x[:40], np.arange(40) * 2, 5)
    assert scored < 40 * 3000 * 0.6 and found == wanted(x, np.arange(3000) * 2, x[:40], np.arange(40) * 2, 5)


def test_threshold_ties_zeros_few_rows_and_large_numbers():
    x = np.array([[0, 0], [1, -1], [1, -1], [0, 0], [-3, 2]])
    ids = np.array([1, 4, 4, 7, 9])
    for k in (1, 3, 9):
        q, own = np.array([[0, 0], [5, 0], [-1, -1]]), np.array([7, 4, 100])
        assert threshold_top_k(x, ids, q, own, k, first_step=1)[0] == wanted(x, ids, q, own, k)
    big = np.array([[2**40, 1], [2**40, 2], [-(2**40), 3]])
    assert threshold_top_k(big, np.arange(3), big, np.arange(3), 2)[0] == wanted(big, np.arange(3), big, np.arange(3), 2)
