"""Operator 4, token counts that follow edits without counting whole texts again.

A document's pre-tokens hang in a segment tree: leaves are runs of pre-tokens of about ``leaf_chars`` characters,
inner nodes sum the tokens of their two children. Leaves begin where white space follows a character that is none:
there the tokenizer always ends a piece, so counts of leaves add up. The trees are a table, a row for each document, which
is kept from one edit to the next. An edit touches the leaves it overlaps; these are encoded again, with neighbours as
long as the edited region does not begin and end at such places, and the sums on the way to the root are updated.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import Written, slices

Edit = tuple[int, int, str]
Edits = Callable[[str], list[Edit]]

#: Fixed value: what is white space to the tokenizer. Python's own class holds four control characters more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and the non-white run after it: the smallest piece whose count stands alone.
_PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+\\Z").findall

#: What the default edits replace.
REDACTIONS = [
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"\b[0-9a-f]{32,64}\b", "<secret>"),
    (r"\+?\d[\d ()-]{7,}\d", "<phone>"),
]


class SegmentTree:
    """Sums over leaves: ``sums[1]`` is the root, the leaves are ``sums[size:]``; ``sums`` alone restores the tree."""

    def __init__(self, counts: list[int]):
        self.size = 1 << max(0, (len(counts) - 1).bit_length())
        self.sums = [0] * self.size + counts + [0] * (self.size - len(counts))
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @classmethod
    def of(cls, sums: list[int]) -> SegmentTree:
        tree = cls.__new__(cls)
        tree.size, tree.sums = len(sums) // 2, sums
        return tree

    def total(self) -> int:
        return self.sums[1]

    def set(self, leaf: int, count: int) -> None:
        i = leaf + self.size
        delta = count - self.sums[i]
        while i and delta:
            self.sums[i] += delta
            i >>= 1


class CountedText:
    """A text as leaves and the tree of their tokens, which edits keep true; ``count`` gives the tokens of a piece."""

    def __init__(self, leaves: list[str], tree: SegmentTree, count: Callable[[str], int], leaf_chars: int = 400):
        self.leaves, self.tree, self.count, self.leaf_chars = leaves, tree, count, leaf_chars

    @classmethod
    def of(cls, text: str, count: Callable[[str], int], leaf_chars: int = 400) -> CountedText:
        counted = cls([], SegmentTree([0]), count, leaf_chars)
        counted.leaves, counts = counted._cut(text)
        counted.tree = SegmentTree(counts)
        return counted

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _cut(self, text: str) -> tuple[list[str], list[int]]:
        """Leaves of a text and their tokens: the only place that encodes."""
        starts, counts, at, tokens = [0], [], 0, 0
        for piece in _PIECES(text):
            if at - starts[-1] >= self.leaf_chars:
                counts.append(tokens)
                starts.append(at)
                tokens = 0
            tokens += self.count(piece)
            at += len(piece)
        counts.append(tokens)
        starts.append(len(text))
        return [text[a:b] for a, b in zip(starts, starts[1:])], counts

    def edit(self, edits: list[Edit]) -> int:
        """Apply sorted, disjoint (start, end, replacement) edits of the text as it is now; return the leaves counted again.

        Regions of touched leaves are renewed from the last to the first, so the places before them stay as they were.
        """
        leaves = self.leaves
        starts = [0, *accumulate(map(len, leaves))]
        n = len(leaves)
        regions: list[tuple[int, int, list[Edit]]] = []  # first leaf, last leaf, edits
        for edit in edits:
            first = min(n - 1, bisect_right(starts, edit[0], 0, n) - 1)
            last = max(first, min(n - 1, bisect_right(starts, edit[1] - 1, 0, n) - 1))
            if regions and first <= regions[-1][1]:
                regions[-1] = (regions[-1][0], max(last, regions[-1][1]), [*regions[-1][2], edit])
            else:
                regions.append((first, last, [edit]))
        again, counts, moved = 0, self.tree.sums[self.tree.size : self.tree.size + n], False
        while regions:
            first, last, own = regions.pop()
            after, tail = last + 1, ""
            while True:
                new = self._edited(starts, first, last, own) + tail
                # The region must begin at white space after a character that is none, and so must what follows it.
                if first > 0 and new[:1] not in _WHITE:
                    first -= 1
                    if regions and regions[-1][1] >= first:
                        first, _, more = regions.pop()
                        own = [*more, *own]
                elif after < len(leaves) and (not new or new[-1] in _WHITE):
                    tail += leaves[after]
                    after += 1
                else:
                    break
            texts, tokens = self._cut(new)
            again += after - first
            moved |= len(texts) != after - first
            if not moved:
                for i, c in enumerate(tokens, first):
                    self.tree.set(i, c)
            leaves[first:after], counts[first:after] = texts, tokens
        if moved:
            self.tree = SegmentTree(counts)
        return again

    def _edited(self, starts: list[int], first: int, last: int, edits: list[Edit]) -> str:
        base, out = "".join(self.leaves[first : last + 1]), []
        at = low = starts[first]
        for start, end, new in edits:
            out += base[at - low : start - low], new
            at = end
        return "".join(out) + base[at - low :]


_WHITE = frozenset(WHITE)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The default edits of a text: sorted and disjoint, earlier patterns first."""
    found: list[tuple[int, int, str]] = []
    for pattern, new in _REDACTIONS:
        found += [(m.start(), m.end(), new) for m in pattern.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for edit in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


_REDACTIONS = [(re.compile(p), new) for p, new in REDACTIONS]
_RUN = re.compile(r"([^\w\s])\1{3,}")


def shortened_runs(text: str) -> list[Edit]:
    """Edits that leave three of a longer run of one sign."""
    return [(m.start() + 3, m.end(), "") for m in _RUN.finditer(text)]


TREES = "doc_id long, leaves array<string>, sums array<long>"


def _grow(path: str, leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomline.llm.tokens import chunk_counts

        count = chunk_counts(path).__getitem__
        for batch in batches:
            for rows in slices(batch, 1, most_rows=256):
                trees = [CountedText.of(t or "", count, leaf_chars) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([t.leaves for t in trees], pa.list_(pa.string())), pa.array([t.tree.sums for t in trees], pa.list_(pa.int64()))], ["doc_id", "leaves", "sums"])

    return run


def token_trees(docs: DataFrame, ranks_path: str, leaf_chars: int = 400) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, more): doc_id, leaves (the text in parts) and sums (their segment tree).

    sums[1] is the text's number of tokens. Null and empty texts have one empty leaf; repeated rows give a row each; an empty
    table gives no rows; other columns are left out. Write the table: ``edit_trees`` goes on from it.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_grow(ranks_path, leaf_chars), TREES)


def _edit(path: str, edits: Edits, leaf_chars: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomline.llm.tokens import chunk_counts

        count, at, sums_at = chunk_counts(path).__getitem__, names.index("leaves"), names.index("sums")
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows, n_edits, again = batch.slice(low, 64), [], []
                leaves, sums = rows.column(at).to_pylist(), rows.column(sums_at).to_pylist()
                for i, own in enumerate(leaves):
                    if own is None:
                        own, sums[i] = [""], [0, 0]
                    counted = CountedText(own, SegmentTree.of(sums[i]), count, leaf_chars)
                    wanted = edits(counted.text)
                    n_edits.append(len(wanted))
                    again.append(counted.edit(wanted) if wanted else 0)
                    leaves[i], sums[i] = counted.leaves, counted.tree.sums
                columns = list(rows.columns)
                columns[at], columns[sums_at] = pa.array(leaves, pa.list_(pa.string())), pa.array(sums, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_edits, pa.int64()), pa.array(again, pa.int64())], [*names, "n_edits", "leaves_again"])

    return run


def edit_trees(trees: DataFrame, ranks_path: str, edits: Edits, leaf_chars: int = 400) -> DataFrame:
    """``trees`` (leaves, sums, more) after ``edits``, with n_edits and leaves_again: what was encoded anew.

    ``edits(text)`` gives sorted, disjoint (start, end, replacement) edits of the text that the leaves make up. The result is
    such a table again and takes further edits. A null tree is that of an empty text; other columns stay (n_edits and
    leaves_again are replaced).
    """
    base = trees.select(*(c for c in trees.columns if c not in ("n_edits", "leaves_again")))
    schema = T.StructType([*base.schema.fields, T.StructField("n_edits", T.LongType()), T.StructField("leaves_again", T.LongType())])
    return base.mapInArrow(_edit(ranks_path, edits, leaf_chars, base.columns), schema)


def count_tokens(docs: DataFrame, ranks_path: str, rounds: tuple[Edits, ...] = (redactions, shortened_runs), leaf_chars: int = 400) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, more): token counts before and after rounds of edits, on kept trees.

    doc_id, n_chars, n_tokens, n_leaves; then of round k (from 1) n_edits_k, n_tokens_k, leaves_again_k; and text, the text in
    the end. By default the first round turns e-mail and IP addresses, phone numbers and hexadecimal secrets into
    placeholders, and the second shortens runs of one sign. The trees are written once, and each round goes on from the
    trees of the one before: a count equals that of the whole edited text, but only leaves_again_k leaves are encoded for
    it. Nulls, empty texts, repeated rows and empty tables are those of ``token_trees``.
    """
    trees = Written(token_trees(docs, ranks_path, leaf_chars), "trees").df
    length = F.aggregate("leaves", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    now = trees.select("doc_id", "leaves", "sums", length.alias("n_chars"), F.col("sums")[1].alias("n_tokens"), F.size("leaves").cast("long").alias("n_leaves"))
    columns = ["doc_id", "n_chars", "n_tokens", "n_leaves"]
    for k, edits in enumerate(rounds, 1):
        own = [f"n_edits_{k}", f"n_tokens_{k}", f"leaves_again_{k}"]
        done = edit_trees(now, ranks_path, edits, leaf_chars)
        now = done.select("leaves", "sums", *columns, F.col("n_edits").alias(own[0]), F.col("sums")[1].alias(own[1]), F.col("leaves_again").alias(own[2]))
        columns += own
    return now.select(*columns, F.array_join("leaves", "").alias("text"))
