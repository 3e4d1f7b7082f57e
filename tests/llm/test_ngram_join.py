import random
from collections import Counter, defaultdict

from loomline.llm.components import connected_components
from loomline.llm.ngram_join import bands_for, keep_one, ngram_join, words_of


def brute(rows):
    grams = []
    for _, t in rows:
        w = words_of(t or "")
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], d)
    return {d: (low[find(i)], n[i]) for i, (d, _) in enumerate(rows)}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = []
    for _ in range(60):
        rows.append(" ".join(word() for _ in range(rng.randint(3, 80))))
    base = [word() for _ in range(100)]
    for _ in range(150):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(100)] = word()
        rows.append(" ".join(w))
    rows += [rows[0]] * 40 + ["", "...", "...", "one two", "One, two"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(9999, None)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(df, block=16).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in keep_one(df).collect()}
    assert kept == {c for c, _ in got.values()}


def test_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z u v w"), (2, "x y z u v w"), (None, "x y z u v w")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join(df).collect()), key=str)
    assert out == sorted([(1, 1, 0), (1, 1, 0), (1, 1, 2), (2, 1, 2), (None, 1, 2)], key=str)
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands():
    b, r = bands_for(0.8, 0.9999)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.9999


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)] + [(1000, i) for i in range(1001, 1100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    loops = {x for e in edges for x in e} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in loops}


def test_chain_of_loosely_similar_texts(spark, monkeypatch):
    """A long chain is one candidate group with small buckets: it is verified bucket by bucket, with equal results."""
    from loomline.llm import ngram_join as module

    rng = random.Random(9)
    words = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    rows, at = [], 0
    while at + 60 <= len(words):
        rows.append(" ".join(words[at : at + 60]))
        at += rng.choice((2, 3, 5, 6, 7, 9))
    rows += rows[:30]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    told, real = [], module._loose_groups
    monkeypatch.setattr(module, "_loose_groups", lambda *a: told.append(real(*a)) or told[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(df, block=32).collect()}
    assert told[0] is not None and told[0].count() >= 1
    assert got == brute(rows)
    # Ids that repeat with other words take the longer way to their sets.
    again = spark.createDataFrame([*rows, (0, "quite other words than all the rest of them")], "doc_id long, text string")
    classes = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join(again, block=32).collect())
    assert all(classes[(d, *v)] >= 1 for d, v in got.items() if d != 0)


def test_keep_one_with_null_and_repeated_ids(spark):
    near = [f"w{i}" for i in range(60)]
    a, b = " ".join(near), " ".join([*near[:-1], "other"])
    rows = [
        (1, a, "p"), (None, b, "q"),  # a near copy without an id goes
        (None, "clean one two three four five", "r"), (None, "quite different words that stand alone", "s"),  # others without an id stay
        (5, "m n o p q r s", "t"), (7, "m n o p q r s", "u"), (7, "the second text of seven is clean", "v"),
        (None, "clean one two three four five", "w"), (8, "", "x"), (8, None, "y"), (None, "", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    out = keep_one(df)
    assert out.columns == df.columns
    marks = sorted(r.mark for r in out.collect())
    assert [m for m in marks if m not in "rw"] == ["p", "s", "t", "v", "x", "y", "z"] and sum(m in "rw" for m in marks) == 1
