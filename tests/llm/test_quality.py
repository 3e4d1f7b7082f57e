import random
import zlib

import numpy as np
import pytest

from loomline.llm.quality import Features, chunks_of, fit, score_quality


def corpus(n=400):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
        bad = i % 4 == 0
        rows.append((i, " | ".join(words) if bad else " ".join(words) + "."))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(1000, None), (1001, ""), (None, "a text")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows + extra], "doc_id long, text string, held_out int, quality string")
    out = score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_no_labels_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = score_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}
    assert fit([], []).score([]) == 0.5


def test_long_runs_give_features_to_their_end():
    features, head = Features(), "a1" * 40
    rng = random.Random(4)
    tails = ["".join(rng.choice("abcdef0123456789+/") for _ in range(4000)) for _ in range(2)]
    one, two = (set(features(head + t)) for t in tails)
    assert min(len(one), len(two)) > 150 and len(one & two) < 0.2 * len(one)
    assert "".join(chunks_of(head + tails[0])) == head + tails[0] and chunks_of("a " + "b" * 80) == ["a", "b" * 80]


def test_scores_and_fit_against_brute_force(spark):
    import brute

    from loomline.llm.quality import BITS, Features, score_quality, train

    rng = np.random.default_rng(2)
    words = ["the", "of", "Word,", "x9", "###", "A-B", "http://q", "naïve", "!!", "42", "end."]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 40)), p=None)) + ("\n" * int(rng.integers(0, 3))) + ("z9!" * 200 if i % 17 == 0 else "") for i in range(120)]
    texts += [None, "", " \n\t ", texts[3], "word " * 30_000 + "q" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(len(t or "") % 2)) for i, t in enumerate(texts[:120])] + [(1, 7), (2, None)], "doc_id long, quality int")
    for t in texts:
        assert set(Features()(t or "").tolist()) == brute.features(t or "")
    model = train(docs, labels)
    for r in score_quality(docs, labels).collect():
        assert r["score"] == pytest.approx(brute.score(model, texts[r["doc_id"]] or ""), abs=1e-5) and r["predicted"] == (r["score"] >= 0.3)
    rows = [np.array(sorted(brute.features(t)), np.int64) for t in texts[:80]]
    told = np.array([len(t) % 2 for t in texts[:80]])
    fitted = fit(rows, told, epochs=5000, tolerance=1e-7)
    assert brute.is_optimal(rows, told, fitted.weights, fitted.bias, 1 << BITS) < 1e-4
