import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm.license_rules import BASE, TEXTS, rules
from loomline.llm.licenses import Scanner, scan_licenses

SCANNER = Scanner()
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = sorted((i, label) for label, p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x[1] for x in places}))


PARTS = st.sampled_from(["under the MIT license", "Under-The mit License", "apache license, version 2", "CC BY-NC", "cc by nc cc by nc", "é", "license", " ", "\n", "under the", "SPDX-License-Identifier: GPL-3.0", "x1"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=12).map(" ".join))
def test_base_places(text):
    assert SCANNER.scan(text.encode())[:5] == brute(text)


def test_rules_and_suppression():
    assert len(rules()) > 200 and [r[2] for r in rules()] == sorted((r[2] for r in rules()), reverse=True)
    labels = SCANNER.scan(b"Licensed under the Apache License, Version 2.0 (the License)")[5]
    assert labels == "apache-2"
    found = SCANNER.scan(b"released under the GNU General Public License version 3 or any later version")[7]
    spans = [(f[2], f[3]) for f in found]
    assert all(not (a != b and a[0] >= b[0] and a[1] <= b[1]) for a in spans for b in spans)
    assert "gpl-3" in {f[1] for f in found}


def test_every_gate_is_needed():
    """A rule never matches a text without any of its gate words."""
    for name, _, _, _, gates, pattern in rules():
        assert gates, name
        for text in ("under the mit license", "spdx license identifier mit", "licensed under the apache license version 2 0", "see the mit license for details", "license mit", "cc by nc 4 0"):
            if pattern.search(text):
                assert set(gates) & set(text.split()), (name, text)


def test_edges(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (3, "under the mit license " * 2000, 0.1), (None, "CC BY-NC", 0.2)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].labels, by[1].score) == (0, 0, None, "", 0.0)
    assert by[3].n_base == 2000 and by[3].last_word == 4 * 1999 and by[3].score == 1
    assert by[None].base_labels == "cc-by-nc"
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hand_written_rules_stand_behind_their_own_words():
    assert len(TEXTS) > 200 and len({(t[0], t[3]) for t in TEXTS}) == len(TEXTS)
    for label, weight, gates, pattern in TEXTS:
        assert 0 < weight <= 1 and all(re.search(rf"(?<![a-z0-9]){g}(?![a-z0-9])", pattern) for g in gates), (label, gates)


NOTICES = st.sampled_from(
    ["under the mit license", "licensed under the apache license version 2 0", "the license", "spdx license identifier gpl 3 0 or later", "all rights reserved", "gnu general public license version 3 29 june 2007",
     "see the gnu gpl license for details", "mozilla public license version 2 0", "cc by nc sa 4 0", "word", "released under the terms of the bsd 3 clause license", "license mit license"]
)


@settings(max_examples=200, deadline=None)
@given(st.lists(NOTICES, max_size=10).map(" ".join))
def test_suppression_against_brute_force(text):
    """By falling priority, then by start and length: what lies inside a match already taken goes, and nothing else."""
    every = [(-priority, m.start(), -m.end(), name, label) for name, label, priority, _, _, pattern in rules() for m in pattern.finditer(text)]
    taken = []
    for priority, start, end, name, label in sorted(every):
        if not any(s <= start and -end <= e for s, e, _, _ in taken):
            taken.append((start, -end, name, label))
    got = SCANNER.scan(text.encode())[7]
    assert sorted((name, label, text.count(" ", 0, s), text.count(" ", 0, e)) for s, e, name, label in taken) == sorted(d[:4] for d in got)
