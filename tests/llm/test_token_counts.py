import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm.common import Written
from loomline.llm.token_counts import CountedText, SegmentTree, count_tokens, edit_trees, redactions, shortened_runs, token_trees
from loomline.llm.tokens import ChunkCounts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNT = ChunkCounts(PATH)
full = lambda t: len(COUNT.encoding.encode_ordinary(t))
TEXT = st.text(alphabet=st.sampled_from("ab '.sé!\n\t\x1c\x85\u30009 "), max_size=120)
ROUND = st.lists(st.tuples(st.integers(0, 120), st.integers(0, 12), st.sampled_from(["", " ", "x", "'s", " a\n", "\n\n", "one two three four"])), max_size=5)


def disjoint(raw, n):
    edits, at = [], 0
    for start, size, new in sorted(raw):
        start = max(at, min(start, n))
        end = min(n, start + size)
        if not edits or start >= edits[-1][1]:
            edits.append((start, end, new))
            at = end
    return edits


def applied(text, edits):
    for start, end, new in reversed(edits):
        text = text[:start] + new + text[end:]
    return text


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(ROUND, min_size=1, max_size=4))
def test_rounds_of_edits_equal_full_counts(text, rounds):
    counted = CountedText.of(text, COUNT.__getitem__, 6)
    assert counted.tree.total() == full(text) and counted.text == text
    for raw in rounds:
        edits, before = disjoint(raw, len(text)), len(counted.leaves)
        text = applied(text, edits)
        assert counted.edit(edits) <= before
        assert counted.text == text and counted.tree.total() == full(text)
        assert counted.tree.sums == SegmentTree([full(x) for x in counted.leaves]).sums


def test_an_edit_encodes_its_surroundings_only():
    seen = []
    text = "some words in a row " * 2000
    counted = CountedText.of(text, lambda p: seen.append(p) or COUNT[p], 100)
    seen.clear()
    assert counted.edit([(20_000, 20_004, "many")]) <= 2 and sum(map(len, seen)) < 400
    seen.clear()
    assert counted.edit([(5, 5, "x"), (30_000, 30_300, "")]) <= 8 and sum(map(len, seen)) < 1200
    assert counted.tree.total() == full(counted.text)


def test_trees_persist(spark):
    rows = [(1, "mail a.b@c.de from 10.0.0.1 !!!!!! " + "word " * 500), (2, None), (3, ""), (4, "no edits here"), (4, "no edits here"), (None, "=====" * 30_000 + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS leaves", "1 AS sums")
    now = Written(token_trees(docs, PATH), "trees").df
    for edits in (redactions, shortened_runs, lambda t: [(0, 0, "Start ")], redactions):
        before = {(r.doc_id, "".join(r.leaves)) for r in now.collect()}
        now = Written(edit_trees(now, PATH, edits), "trees").df
        out = now.collect()
        assert {(r.doc_id, "".join(r.leaves)) for r in out} == {(d, applied(t, edits(t))) for d, t in before}
        assert len(out) == 6 and all(r.sums[1] == full("".join(r.leaves)) and r.sums == SegmentTree([full(x) for x in r.leaves]).sums for r in out)
    none = spark.createDataFrame([(1, None, None)], "id long, leaves array<string>, sums array<long>")
    assert [r.sums[1] for r in edit_trees(none, PATH, lambda t: [(0, 0, "a b")]).collect()] == [full("a b")]


def test_query(spark):
    rows = [(1, "mail a.b@c.de from 10.0.0.1 and!!!!!! " + "word " * 500), (2, None), (3, ""), (4, "no edits here"), (4, "no edits here"), (5, "x" * 200_000)]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert len(out) == 6
    for r in out:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        first = applied(text, redactions(text))
        last = applied(first, shortened_runs(first))
        assert (r.n_chars, r.n_tokens, r.n_tokens_1, r.n_tokens_2, r.text) == (len(text), full(text), full(first), full(last), last)
        assert (r.n_edits_1, r.n_edits_2) == (len(redactions(text)), len(shortened_runs(first)))
    one = next(r for r in out if r.doc_id == 1)
    assert "<email>" in one.text and "and!!! " in one.text and 0 < one.leaves_again_1 < one.n_leaves and 0 < one.leaves_again_2 <= 2
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
