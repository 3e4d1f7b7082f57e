import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomline.llm.packing import pack
from loomline.llm.tokens import ChunkCounts, TokenIds

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello World, it's 42!", "", None, "Zoë's naïve Σ test\n\nline two " * 40, "<|endoftext|> x", "ß ŉ ª ² x­y　z\t1२3", "a" * 5000, "### $$$ %%% word### WORD!!", "Hello World, it's 42!"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def assert_equal(own, plain, texts):
    ids, lengths = own.encode(pa.array(texts, pa.string()), 1)
    assert len(lengths) == len(texts) and lengths.sum() == len(ids)
    for text, got in zip(texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert got.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1], repr(text)


def test_ids_equal_the_tokenizer(tokenizer):
    own = TokenIds(PATH, limit=20)
    for _ in range(2):
        assert_equal(own, tokenizer, TEXTS)
    assert TokenIds(PATH).encode(pa.array(["Hello"]))[0].tolist() == tokenizer.encode("Hello", add_special_tokens=False).ids


def test_ids_of_every_low_character_and_of_mixtures(tokenizer):
    own, rng = TokenIds(PATH, limit=500), random.Random(5)
    low = [chr(i) for i in range(0x250)]
    assert_equal(own, tokenizer, [f"{c}a" for c in low] + [f"a{c}b" for c in low] + [f"5{c}" for c in low] + [f"{c}'s{c}{c}" for c in low])
    assert_equal(own, tokenizer, ["word\x1cnext", "it's'll''s", "we'RE 'd'd", "x<|endoftext|>y <|startoftext|>", "<|endoftext", "'", "''", "a'", "r'r've"])
    pool = low + list("Σ\u0301İ中文\u2028\u3000é\U0001f600") + ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'re", "the", "\n"] + [" "] * 90
    assert_equal(own, tokenizer, ["".join(rng.choices(pool, k=rng.randint(0, 80))) for _ in range(1500)])


def test_other_tokenizer_files_take_the_plain_way():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = TokenIds(path)
    assert not own.by_words
    assert_equal(own, Tokenizer.from_file(path), TEXTS)


def test_batches_are_cut_by_bytes():
    from loomline.llm.common import slices

    batch = pa.RecordBatch.from_arrays([pa.array([5, 0, 3, 9, 1]), pa.array(["aaaaa", None, "bbb", "c" * 9, "d"])], ["n", "t"])
    assert [p.column(0).to_pylist() for p in slices(batch, 1, 8)] == [[5, 0, 3], [9], [1]]
    assert [p.num_rows for p in slices(batch, 1, 100, 2)] == [2, 2, 1] and not list(slices(batch.slice(0, 0), 1))


def test_chunk_counts_add_up():
    c = ChunkCounts(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    from loomline.llm.token_counts import CountedText

    for text in TEXTS:
        assert CountedText.of(text or "", c.__getitem__, 10).tree.total() == len(c.encoding.encode_ordinary(text or ""))


def test_round_trip(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string").repartition(3)
    rows = pack(docs, PATH, window=64).collect()
    by_doc, cells = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and 0 < r.length <= 64
        by_doc.setdefault(r.doc_id, []).append(r)
        cells.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        got = b"".join(bytes(r.ids) for r in pieces)
        assert list(array("I", got)) == want and all(r.doc_tokens == len(want) for r in pieces)
        assert zlib.crc32(got) == zlib.crc32(array("I", want).tobytes())
    assert sorted(cells) == list(range(len(cells)))
    for k, own in cells.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 64 or k == len(cells) - 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
