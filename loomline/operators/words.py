"""Word-level differences of short texts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def changed_words(a: str | None, b: str | None) -> int | None:
    """Over all differing blocks, the larger of the words gone and the words new; null if a text is null."""
    if a is None or b is None:
        return None
    blocks = difflib.SequenceMatcher(None, old := a.split(), new := b.split(), autojunk=False).get_matching_blocks()
    at, total = (0, 0), 0
    for block in blocks:  # the last one is empty and stands at both ends
        total += max(block.a - at[0], block.b - at[1])
        at = block.a + block.size, block.b + block.size
    assert at == (len(old), len(new))
    return total


def _word_diff(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([changed_words(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def word_diff(a: Column, b: Column) -> Column:
    return F.pandas_udf(_word_diff, "int")(a, b)


def minimal_pair(a: Column, b: Column, most: int = 8) -> Column:
    """Texts that differ, in at most ``most`` words."""
    return word_diff(a, b).between(1, most)
