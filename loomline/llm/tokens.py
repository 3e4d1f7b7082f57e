"""Cached use of public tokenizers: counts and ids of a text equal the tokenizer's own, at a part of its time.

A text is cut at white space, where the tokenizers' own splitting always ends a piece; what a cut piece gives is
kept in a bounded dictionary. Only pieces not met before go to the tokenizer, many at a time.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters below this are stable under NFC and have the same letter, digit and case classes in every library.
SIMPLE = 0x250
#: The only normaliser and splitter of which the fast way below is a part-by-part equal.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Recent:
    """A dictionary in two generations: when the young one is full it becomes the old one, whose entries then go."""

    def __init__(self, limit: int):
        self.half, self.young, self.old = max(1, limit // 2), {}, {}

    def missing(self, keys: list) -> list:
        """The keys that neither generation holds; those of the old one move to the young one."""
        young, old = self.young, self.old
        if len(young) > self.half:
            young, old = self.young, self.old = {}, young
        out = []
        for k in keys:
            if k not in young:
                if (v := old.get(k)) is not None:
                    young[k] = v
                else:
                    out.append(k)
        return out


SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point below SIMPLE, and of one that stands for all others: lower case and kind.

    What the fast way does not split itself is WHOLE: its chunk, up to the next white space, goes to the tokenizer.
    """
    lower, kind = np.arange(SIMPLE + 1, dtype=np.uint16), np.full(SIMPLE + 1, WHOLE, np.uint8)
    for i in range(SIMPLE):
        low = chr(i).lower()
        if chr(i) in " \t\n\v\f\r":
            kind[i] = SPACE
        elif chr(i).isprintable() and len(low) == 1:
            lower[i] = ord(low)
            kind[i] = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(low)[0], OTHER)
    return lower, kind


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; the last flag is false."""
    return np.flatnonzero(flags & ~np.append(False, flags[:-1])), np.flatnonzero(~flags & np.append(False, flags[:-1]))


class TokenIds:
    """The ids of texts by a tokenizer file, as the plain tokenizer gives them without special tokens of its own.

    For the one kind of file that NORMALIZER and PRE_TOKENIZER describe, a batch of texts is split into words by arrays of
    code points, and each distinct word is encoded once and kept; of any other file whole texts go to the tokenizer.
    ``limit`` bounds, roughly, the words that are kept.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.by_words = (
            told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not model["dropout"]
            and not (told["truncation"] or told["padding"])
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in told["added_tokens"])
        )
        if not self.by_words:
            return
        self.words, self.chunks = Recent(limit), Recent(limit // 4)
        self.special = [t["content"] for t in told["added_tokens"]]
        # The same model behind white space alone; each word's last token, and no other, has the suffix.
        self.bare = Tokenizer(Tokenizer.from_file(path).model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
        self.lower, self.kind = _tables()
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> list[bytes]:
        new = self.words.missing(words)
        known = self.words.young
        for low in range(0, len(new), 20_000):
            part = new[low : low + 20_000]
            spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(self.alphabet) for w in part]
            lines = [" ".join(spelled[i : i + 128]) for i in range(0, len(part), 128)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokenizer's words do not end in its suffix")
            data = ids.tobytes()
            known.update((w, data[at:to]) for w, at, to in zip(part, [0, *cuts], cuts))
        return [known[w] for w in words]

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        new = self.chunks.missing(chunks)
        self.chunks.young.update(zip(new, self._whole(new)))
        return [self.chunks.young[c] for c in chunks]

    def _split(self, text: str) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray, list[str]]:
        """(starts, words) of the pieces of a text that ends in a newline, and (starts, texts) of the chunks to take whole."""
        if text.isascii():
            point = np.frombuffer(text.encode("ascii"), np.uint8)
        else:
            point = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), SIMPLE)
        kind, low = self.kind[point], self.lower[point]
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                kind[at] = WHOLE
                at = text.find(s, at + 1)
        space = kind == SPACE
        keep, at, chunks = ~space, np.zeros(0, np.int64), []
        if (whole := kind == WHOLE).any():
            number = np.cumsum(space)
            bad = np.zeros(number[-1] + 1, bool)
            bad[number[whole]] = True
            bad = bad[number] & keep
            keep &= ~bad
            at, to = _runs(bad)
            chunks = [text[i:j] for i, j in zip(at.tolist(), to.tolist())]
        # A piece is a run of letters or of other signs, or one digit; an apostrophe that begins one may take letters.
        begins = np.append(True, kind[1:] != kind[:-1])
        begins |= kind == DIGIT
        short = np.flatnonzero((low[:-1] == ord("'")) & begins[:-1])
        if len(short):
            ahead = np.append(low, np.zeros(2, low.dtype))
            one, two = ahead[short + 1], ahead[short + 2]
            pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            taken = np.where(pair, 2, np.isin(one, [ord(c) for c in "stmd"]))
            short, taken = short[taken > 0], taken[taken > 0]
            begins[short + 1] = False
            begins[short + taken + 1] = True
        begins &= keep
        starts = np.flatnonzero(begins)
        # Pieces fill what is kept without gaps, two bytes a character.
        offsets = np.append(np.cumsum(keep)[starts] - 1, keep.sum()).astype(np.int32) * 2
        data = low[keep].tobytes()
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return starts, pieces.dictionary_encode(), at, chunks

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of strings in a row, ``end`` after each text, and how many ids each text has."""
        last = b"" if end is None else int(end).to_bytes(4, "little")
        texts = [t or "" for t in texts.to_pylist()]
        if not self.by_words or not texts:
            found = [x + last for x in self._whole(texts)]
            return np.frombuffer(b"".join(found), np.uint32), np.array([len(x) // 4 for x in found], np.int64)
        starts, words, whole_at, chunks = self._split("\n".join(texts) + "\n")
        names = words.dictionary
        # One join and one split make Python strings faster than a conversion of each; no word holds a newline.
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), "\n".encode("utf-16-le"))[0].as_py() if len(names) else b""
        found = self._of_words(joined.decode("utf-16-le").split("\n")) if len(names) else []
        number = {c: i for i, c in enumerate(dict.fromkeys(chunks), len(found))}
        found += self._of_chunks(list(number))
        found.append(last)
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if chunks:
            codes, starts = np.append(codes, [number[c] for c in chunks]), np.append(starts, whole_at)
            order = np.argsort(starts, kind="stable")
            codes, starts = codes[order], starts[order]
        stops = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(starts, stops)
        codes = np.insert(codes, upto, len(found) - 1)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        counts, flat = sizes[codes], np.frombuffer(b"".join(found), np.uint32)
        after = np.cumsum(counts)
        begin = np.cumsum(sizes) - sizes
        ids = flat[np.repeat(begin[codes] - (after - counts), counts) + np.arange(after[-1])]
        return ids, np.diff(after[upto + np.arange(len(texts))], prepend=0)


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    """One for each worker process: the tasks that it runs in a row share what is known."""
    return TokenIds(path)


class ChunkCounts(dict):
    """White space and the word after it -> how many tokens a byte-level BPE makes of them."""

    def __init__(self, path: str, limit: int = 300_000):
        import base64

        import public_tokenizers
        import tiktoken

        super().__init__()
        self.limit = limit
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> int:
        if len(self) > self.limit:
            self.clear()
        self[chunk] = n = len(self.encoding.encode_ordinary(chunk))
        return n


@lru_cache(maxsize=2)
def chunk_counts(path: str) -> ChunkCounts:
    """One for each worker process, as token_ids."""
    return ChunkCounts(path)
