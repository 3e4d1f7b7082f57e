"""Text and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Lower case, any run of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def state_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def seeded_hash(seed: str | int, key: Column) -> Column:
    """The order of a reproducible shuffle: SHA-256 of 'seed:key'."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)



def hex_mod10(hexes: Column) -> Column:
    """A 256-bit hexadecimal number mod 10: every power of 16 is 6 mod 10."""
    digits = F.transform(F.filter(F.split(hexes, ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + d)
    last = F.element_at(digits, -1)
    return (last + 6 * (total - last)) % 10


def hex_parity(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, -1, 1), 16, 10).cast("int") % 2


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def grams(w: Column, n: int) -> Column:
    """Distinct n-grams of an array of words; none for a shorter one. Give it a computed column: it is read once per gram."""
    all_grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, F.array_distinct(all_grams)).otherwise(F.array().cast("array<string>"))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+(?:[.,:]\d+)*"), F.lit(0))


def same_numbers(old: Column, new: Column) -> Column:
    """Whether two texts hold the same set of number tokens."""
    a, b = number_tokens(old), number_tokens(new)
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def lexical_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(words(a), words(b)))


def first_match(rules: list[tuple[str, str]], text: Column, default: str) -> Column:
    """The label of the first pattern that matches."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for p, label in rules], F.lit(default))


#: Spellings of units and what they become.
UNIT_SPELLINGS = (
    (r"\$(\d+)", "$1 USD"),
    (r"(\d+) km\b", "$1 kilometres"),
    (r"(\d+) minutes\b", "$1 min"),
    (r"(\d+(?:\.\d+)?) kg\b", "$1 kilograms"),
    (r"(\d+) units\b", "$1 pcs"),
    (r"(\d+) users\b", "$1 user accounts"),
)


def other_units(text: Column) -> Column:
    """Every unit in its other spelling."""
    for pattern, to in UNIT_SPELLINGS:
        text = F.regexp_replace(text, pattern, to)
    return text


#: Names of the punctuation variants.
PUNCTUATION = ("semicolons", "no_periods", "spaced_commas", "dashes")


def other_punctuation(text: Column, mode: Column) -> Column:
    """Full stops at the end of words as semicolons or gone, commas spaced, colons as dashes; another mode changes nothing."""
    stop = r"\.(?=\s|$)"
    return (
        F.when(mode == "semicolons", F.regexp_replace(text, stop, ";")).when(mode == "no_periods", F.regexp_replace(text, stop, ""))
        .when(mode == "spaced_commas", F.replace(text, F.lit(", "), F.lit(" , "))).when(mode == "dashes", F.replace(text, F.lit(": "), F.lit(" - "))).otherwise(text)
    )


def family_of(group_id: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(group_id, ":", 1)


def question_key(question_id: Column) -> Column:
    """The id without a last part of at least eight hexadecimal digits, if two other parts stand before it."""
    return F.regexp_replace(question_id, r"^([^:]*:.*):[0-9a-f]{8,}$", "$1")


#: Hosts whose absolute links are articles.
ARTICLE_HOSTS = ("en.wikipedia.org", "www.wikipedia.org")


def article_title(href: Column) -> Column:
    """The title that a link names, or null: no query, fragment or other host, an article path, no namespace."""
    host = F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(href, r"[?#]+$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_replace(bare, r"^\./", "/wiki/")
    raw = F.regexp_extract(path, r"^/wiki/(.*)$", 1)
    slug = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    fine = ~href.rlike(r"\?[^#]|#.") & ((host == "") | host.isin(*ARTICLE_HOSTS)) & path.startswith("/wiki/") & (slug != "") & ~slug.contains(":")
    return F.when(fine, F.replace(slug, F.lit("_"), F.lit(" ")))
