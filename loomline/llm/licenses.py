"""Operator 2, license scans: ordered signature rules behind a keyword gate.

A text becomes its words (ASCII lower-cased) joined by single spaces. Each rule stands behind gate words, one of
which any of its matches holds; only rules behind a word that occurs run. Matches are then taken by priority and length,
and a match that lies inside the span of one already taken is suppressed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = """doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,
    detections array<struct<rule:string,label:string,first_word:long,last_word:long,weight:double>>"""

#: Lower-cases A-Z, keeps digits, letters and all bytes of other characters, and makes anything else a space.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


class Scanner:
    def __init__(self):
        from loomline.llm.license_rules import BASE, rules

        self.base = [(label, f" {phrase} ".encode()) for label, phrase in BASE]
        self.rules = rules()
        self.behind: dict[bytes, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for gate in rule[4]:
                self.behind.setdefault(gate.encode(), []).append(i)
        self.gates = frozenset(self.behind)

    def base_places(self, words: bytes) -> list[tuple[int, int, str]]:
        """(first word, last word, label) of every place of a base phrase in b" w1 w2 ... "."""
        out = []
        for label, phrase in self.base:
            at, first, seen = words.find(phrase), 0, 0
            while at >= 0:
                first, seen = first + words.count(b" ", seen, at), at
                out.append((first, first + phrase.count(b" ") - 2, label))
                at = words.find(phrase, at + 1)
        return sorted(out)

    def detect(self, text: str, gates: frozenset[bytes]) -> list[tuple[str, str, int, int, float]]:
        """(rule, label, first word, last word, weight) of the matches that stay, in text order."""
        gated = {i for gate in gates for i in self.behind[gate]}
        by_priority: dict[int, list[tuple]] = {}
        for i in sorted(gated):
            name, label, priority, weight, _, pattern = self.rules[i]
            by_priority.setdefault(-priority, []).extend((m.start(), -m.end(), name, label, weight) for m in pattern.finditer(text))
        taken: list[tuple] = []
        above: list[tuple[list[int], list[int]]] = []  # of each priority: starts, and the furthest end up to each
        for _, matches in sorted(by_priority.items()):
            starts, ends, furthest = [], [], -1
            for start, end, *what in sorted(matches):
                if -end <= furthest or any((k := bisect_right(s, start)) and -end <= e[k - 1] for s, e in above):
                    continue
                furthest = -end
                starts.append(start)
                ends.append(furthest)
                taken.append((start, -end, *what))
            above.append((starts, ends))
        out = []
        at = first = 0
        for start, end, name, label, weight in sorted(taken):
            first, at = first + text.count(" ", at, start), start
            out.append((name, label, first, first + text.count(" ", start, end), weight))
        return out

    def scan(self, text: bytes) -> tuple:
        words = text.translate(_WORDS).split()
        gates = self.gates.intersection(words)
        joined = b" ".join(words)
        base = self.base_places(b" " + joined + b" ")
        found = self.detect(joined.decode("utf-8", "replace"), gates) if gates else []
        base_labels = sorted({b[2] for b in base})
        labels = sorted({*base_labels, *(d[1] for d in found)})
        miss = 0.0 if base else 1.0
        for _, _, _, _, weight in found:
            miss *= 1 - weight
        return len(words), len(base), base[0][0] if base else None, max(b[0] for b in base) if base else None, ",".join(base_labels), ",".join(labels), 1 - miss, found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    struct = pa.struct([("rule", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("weight", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(struct)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            rows = batch.slice(low, 1024)
            found = [scanner.scan(t or b"") for t in rows.column(1).to_pylist()]
            as_dicts = [[dict(zip(("rule", "label", "first_word", "last_word", "weight"), d, strict=True)) for d in x[7]] for x in found]
            columns = [pa.array([x[i] for x in found] if i < 7 else as_dicts, kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", *names])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, more): the columns of SCHEMA, detections in text order.

    Words are runs of digits, a-z (after ASCII lower-casing) and non-ASCII characters of the whole text. n_base counts
    all places of the base phrases, first_word and last_word are their smallest and largest start (null if none).
    labels holds the base labels and those of the rules' detections. Matches are taken by falling priority, of one priority
    the longer of those with one start first; a match inside one already taken is suppressed, while a match of lower
    priority around one stays beside it. The score is 1 - product(1 - weight) over detections, 1 with a base phrase. Null and empty texts have no words, empty labels
    and score 0; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(_scan, SCHEMA)
