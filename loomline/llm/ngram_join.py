"""Operator 9, n-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Texts with the same words fall into one class first, so copies cost a partial aggregation. One row for each class and
band is dealt by the band's hash; links to the smallest class of each bucket give candidate groups. The full n-gram
sets then go to their candidate groups, and every pair of a group is verified exactly: groups are cut into blocks and
each pair of blocks is one small task, which returns counts and a spanning link for each row, not the pairs. A
group whose buckets are much smaller than itself (a chain of loosely similar texts, as large corpora have) is
verified bucket by bucket instead; a pair counts in the first bucket that holds both.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import Written, broadcast_if_small, packed, slices, tidy, unpacked
from loomline.llm.components import connected_components

_WORDS = re.compile(r"\w+").findall
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Candidates with their n-gram sets; a cell is a group or bucket, its blocks, and the bucket's band hash (null: a group).
SETS = "key binary, copies long, bands array<long>, cells array<struct<comp:binary,nb:int,band:long>>, grams binary"


def words_of(text: str) -> list[str]:
    """Lower-cased words; a text of signs alone is split at white space instead."""
    low = text.lower()
    return _WORDS(low) or low.split()


def _key(words: list[str]) -> bytes | None:
    """The name of a word sequence; without words null."""
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest() if words else None


def bands_for(similarity: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band that reach ``recall`` at ``similarity`` with at most ``most`` hashes."""
    found = None
    for rows in range(1, most + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))
        if bands * rows <= most:
            found = (bands, rows)
    if found is None:
        raise ValueError("no band count reaches that recall")
    return found


class Shingler:
    """Words -> sorted distinct 64-bit hashes of their n-grams; a shorter text has one gram of all its words."""

    def __init__(self, n: int = 5, limit: int = 250_000):
        import xxhash

        self.n, self.limit, self.hash = n, limit, xxhash.xxh3_64_intdigest
        self.seen: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.seen) > self.limit:
                self.seen.clear()
            for w in words:
                if w not in self.seen:
                    self.seen[w] = self.hash(w)
            return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))

    def __call__(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = self._hashes(words)
            n = min(self.n, len(h))
            g = h[: len(h) - n + 1].copy()
            for i in range(1, n):
                g = g * _MUL + h[i : len(h) - n + 1 + i]
            g ^= g >> np.uint64(31)
            g *= _MIX
            g ^= g >> np.uint64(29)
            return np.unique(g)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)
        self.salt = rng.integers(1, 1 << 62, (bands, rows), dtype=np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band; the band's number is part of it."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(grams), 1024):
                x = grams[None, at : at + 1024] * self.a
                x += self.b
                x ^= x >> np.uint64(32)
                np.minimum(low, x.min(axis=1), out=low)
            h = ((low.reshape(self.bands, self.rows) + self.salt) * _MIX ^ self.salt) * _MUL
            out = h[:, 0].copy()
            for i in range(1, self.rows):
                out = (out ^ (out >> np.uint64(33))) * _MIX + h[:, i]
            return out.view(np.int64)


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minhash = Shingler(n), MinHash(bands, rows)
        for batch in batches:
            for part in slices(batch, 1, most_rows=256):
                keys, sizes, signs = [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text or "")
                    grams = shingles(words)
                    keys.append(_key(words))
                    sizes.append(len(grams))
                    signs.append(minhash(grams) if words else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.list_(pa.int64()))], ["doc_id", "key", "grams", "bands"]
                )

    return tidy(run)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            for part in slices(batch, 0, most_rows=256):
                sets = [shingles(words_of(t or "")).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sets, pa.binary())], ["key", "copies", "bands", "cells", "grams"])

    return tidy(run)


def _similar(sets: list[np.ndarray], others: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Boolean matrix: which of ``sets`` and ``others`` (or ``sets`` again) have at least the Jaccard similarity."""
    every = sets if others is None else sets + others
    sizes = np.array([len(s) for s in every], np.int64)
    grams, at = np.unique(np.concatenate(every), return_inverse=True)
    doc = np.repeat(np.arange(len(every)), sizes)
    shared = np.bincount(at, minlength=len(grams)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    at, doc = number[at[keep]], doc[keep]
    order = np.argsort(at, kind="stable")
    at, doc = at[order], doc[order]
    n, total, step = len(sets), int(shared.sum()), 4096
    both = np.zeros((n, n if others is None else len(others)), np.float32)
    for low in range(0, total, step):
        i, j = np.searchsorted(at, [low, low + step])
        m = np.zeros((len(every), min(step, total - low)), np.float32)
        m[doc[i:j], at[i:j] - low] = 1
        both += m[:n] @ (m.T if others is None else m[n:].T)
    a, b = sizes[:n, None], (sizes if others is None else sizes[n:])[None, :]
    return both >= similarity * (a + b - both) - 1e-6


def _verify(similarity: float):
    out = pa.schema([("key", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64()), ("low", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        first, second = group.column("first").to_numpy(), group.column("side").to_numpy()
        keys = np.array([k for k in group.column("key").to_pylist()], object)
        copies = group.column("copies").to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        diagonal = bool(first[0])
        left = np.arange(len(sets)) if diagonal else np.flatnonzero(second == 0)
        right = left if diagonal else np.flatnonzero(second == 1)
        if not len(left) or not len(right):
            return out.empty_table()
        linked = _similar([sets[i] for i in left], None if diagonal else [sets[i] for i in right], similarity)
        if diagonal:
            np.fill_diagonal(linked, False)
        bucket = group.column("band")[0].as_py()
        if bucket is not None:  # a pair counts in the first bucket that holds both
            own = np.stack([np.asarray(b.values, np.int64) for b in group.column("bands")])
            for k in range(int(np.flatnonzero(own[0] == bucket)[0])):
                linked &= own[left, k][:, None] != own[right, k][None, :]
        rows: dict[int, list] = {}
        # Spanning links of what is linked here: by union, each row to its root's smallest key.
        parent = list(range(len(sets)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(len(left)):
            hit = np.flatnonzero(linked[i])
            if len(hit):
                rows[int(left[i])] = [len(hit), int(copies[right[hit]].sum())]
                for j in hit:
                    a, b = root(int(left[i])), root(int(right[j]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        if not diagonal:
            for j in range(len(right)):
                hit = np.flatnonzero(linked[:, j])
                if len(hit):
                    rows[int(right[j])] = [len(hit), int(copies[left[hit]].sum())]
        lowest: dict[int, bytes] = {}
        for i in rows:
            r = root(i)
            lowest[r] = min(lowest.get(r, keys[i]), keys[i])
        return pa.table([[keys[i] for i in rows], [v[0] for v in rows.values()], [v[1] for v in rows.values()], [lowest[root(i)] for i in rows]], schema=out)

    return run


def ngram_join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999, block: int = 128) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, more): doc_id, class_id, n_links, n_text_links, n_copies.

    Words are runs of letters, digits and underscores of the whole lower-cased text (a text of signs alone: split at white
    space); n-grams are distinct (a text shorter than n words has one gram). Two documents are linked if the Jaccard
    similarity of their n-grams is at least ``similarity``; equal word sequences always are. class_id is the smallest
    doc_id reachable by links, n_copies the documents with the same words (itself included), n_text_links the linked
    different word sequences, n_links the other documents linked. Null and empty texts link with nothing (n_copies 1).
    Rows that repeat a doc_id with the same words count once; with other words they are documents of that id
    each. A null doc_id joins its class but never names it while another id does. No pair of a candidate bucket is left
    out; the banding misses a pair of exactly the threshold with probability 1 - recall.
    """
    seen, classes, _ = _classes(docs, n, similarity, recall, block)
    classes = Written(classes.select("key", "class_id", "copies", "texts", "docs"), "classes").df
    out = seen.select("doc_id", "key").join(classes, "key", "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies")
    )


def _classes(docs: DataFrame, n: int, similarity: float, recall: float = 0.9999, block: int = 128) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, key, more) of all rows, (key, doc, component, class_id, copies, texts, docs) of their word sequences, and
    whether no doc_id repeats.

    doc is the smallest doc_id of a word sequence; component names its class even where ids are null or repeat.
    """
    bands, rows = bands_for(similarity, recall)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = Written(base.mapInArrow(_signatures(n, bands, rows), "doc_id long, key binary, grams long, bands array<long>"), "signatures").df
    unique = seen.groupBy("doc_id").count().where("count > 1").isEmpty()
    once = seen.where(F.col("key").isNotNull()).groupBy("key", "doc_id").agg(F.max("grams").alias("grams"))
    texts = Written(once.groupBy("key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.max("grams").alias("grams")), "texts").df
    # One row for each class and band: the bands of equal texts are equal, so copies fall together at once.
    banded = seen.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("bands").alias("bands")).select("key", F.explode("bands").alias("band"))
    banded = Written(banded, "banded")
    buckets = banded.df.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("band", "least")
    links = banded.df.join(buckets, "band").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    candidates = connected_components(links)
    found = connected_components_of_texts(base, texts, seen, banded.df, candidates.df, n, similarity, block, unique) if candidates is not None else None
    banded.drop()
    if found is None:
        none = F.lit(0).cast("long")
        return seen, texts.select("key", "doc", F.col("key").alias("component"), F.col("doc").alias("class_id"), "copies", none.alias("texts"), none.alias("docs")), unique
    counts, linked = found
    told = texts.join(counts, "key", "left").join(linked.withColumnRenamed("node", "key"), "key", "left")
    told = told.select("key", "doc", "copies", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("component", "key").alias("component"))
    told = Written(told, "told").df
    named = told.groupBy("component").agg(F.min("doc").alias("class_id"))
    return seen, told.join(named, "component").select("key", "doc", "component", "class_id", "copies", "texts", "docs"), unique


def _cells(members: DataFrame, block: int) -> DataFrame:
    """(key, comp, nb, band) of members (key, grams, comp, band): how many blocks each candidate group is cut into.

    Blocks hold about `block` texts and at most about a million grams; large groups get larger blocks, so that a group of
    m texts ships each text sqrt-many times rather than m / block times.
    """
    size = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("grams").alias("g"))
    few = F.ceil(F.col("m") / block)
    by_grams = F.ceil(F.col("g") / 1_000_000)
    many = F.greatest(F.lit(24), F.ceil(F.col("m") / 1024), by_grams)
    size = size.select("comp", F.greatest(F.least(few, many), by_grams, F.lit(1)).cast("int").alias("nb"))
    # Only groups of several blocks meet their members; they are few, and members need not be dealt by group for it.
    large = broadcast_if_small(Written(size.where("nb > 1"), "blocks").df, 48)
    return members.join(large, "comp", "left").select("key", "comp", F.coalesce("nb", F.lit(1)).alias("nb"), "band")


def _loose_groups(banded: DataFrame, candidates: DataFrame, block: int) -> DataFrame | None:
    """(comp) of groups beyond one block in which comparing bucket by bucket takes less than half of all pairs."""
    large = candidates.groupBy(F.col("component").alias("comp")).agg(F.count(F.lit(1)).cast("double").alias("m")).where(F.col("m") > block)
    large = Written(large, "large").df
    if large.isEmpty():
        return None
    buckets = banded.groupBy("band").agg(F.min("key").alias("node"), F.count(F.lit(1)).cast("double").alias("b")).where("b > 1")
    cost = buckets.join(candidates, "node").groupBy(F.col("component").alias("comp")).agg(F.sum(F.col("b") * F.col("b")).alias("cost"))
    loose = Written(large.join(cost, "comp").where("2 * cost < m * m").select("comp"), "loose").df
    return None if loose.isEmpty() else loose


def connected_components_of_texts(base: DataFrame, texts: DataFrame, seen: DataFrame, banded: DataFrame, candidates: DataFrame, n: int, similarity: float, block: int, unique: bool) -> tuple[DataFrame, DataFrame] | None:
    """Verify the candidate groups (node, component): (key, texts, docs) counts and (node, component) of true links."""
    members = candidates.join(texts.withColumnRenamed("key", "node"), "node")
    members = Written(members.select(F.col("node").alias("key"), F.col("component").alias("comp"), "doc", "copies", "grams"), "members").df
    loose = _loose_groups(banded, candidates, block)
    tight = members if loose is None else members.join(loose, "comp", "left_anti")
    cells = _cells(tight.select("key", "grams", "comp", F.lit(None).cast("long").alias("band")), block)
    bands = F.lit(None).cast("array<long>")
    if loose is None:
        side = cells.join(members.select("key", "doc", "copies"), "key").select("key", "doc", "copies", bands.alias("bands"), F.array(F.struct("comp", "nb", "band")).alias("cells"))
    else:
        inside = Written(members.join(loose, "comp", "left_semi").select("key", "grams"), "inside").df
        spread = banded.join(inside, "key")
        shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("b")).where("b > 1").select("band")
        # A bucket's name as bytes; a group's name is a key of 16 bytes, so the two never meet.
        spread = Written(spread.join(shared, "band").select("key", "grams", F.unhex(F.hex("band")).alias("comp"), "band"), "spread").df
        signs = seen.join(inside.select("key"), "key", "left_semi").groupBy("key").agg(F.first("bands").alias("bands"))
        every = cells.unionByName(_cells(spread, block)).groupBy("key").agg(F.collect_list(F.struct("comp", "nb", "band")).alias("cells"))  # at most one for each band
        side = every.join(members.select("key", "doc", "copies"), "key").join(signs, "key", "left").select("key", "doc", "copies", "bands", "cells")
    side = Written(side, "sized").df
    side = broadcast_if_small(side.withColumnRenamed("doc", "__doc"), 120, extra=F.size("cells") * 40 + F.coalesce(F.size("bands"), F.lit(0)) * 8)
    wanted = base.join(side, F.col("doc_id").eqNullSafe(F.col("__doc"))).select("text", "key", "copies", "bands", "cells")
    sets = wanted.mapInArrow(_sets(n), SETS)
    # A doc_id that repeats with other words gives sets under a key that is not theirs; the key's own text decides.
    if not unique:
        sets = _own_sets(base, side, n)
    sets = sets.select("key", "copies", "bands", "grams", F.inline("cells"))
    b = F.pmod(F.xxhash64("key"), F.col("nb")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("b", o).alias("bi"), F.greatest("b", o).alias("bj"), (F.col("b") > o).cast("int").alias("side"), (F.col("b") == o).alias("first")))
    dealt = sets.withColumn("b", b).select("key", "copies", "bands", "comp", "band", "grams", F.inline(places))
    found = dealt.groupBy("comp", "bi", "bj").applyInArrow(_verify(similarity), "key binary, texts long, docs long, low binary")
    found = Written(found, "verified").df
    linked = connected_components(found.select(F.col("key").alias("a"), F.col("low").alias("b")))
    if linked is None:
        return None
    return found.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs")), linked.df


def _own_sets(base: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """The sets of candidates when doc_ids repeat: only texts whose own words make the key, once for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            rows = []
            for text, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text or "")
                if words and _key(words) == own[0]:
                    rows.append((*own, shingles(words).tobytes()))
            kinds = [*(c.type for c in batch.columns[1:]), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "copies", "bands", "cells", "grams"])

    wanted = base.join(side, F.col("doc_id").eqNullSafe(F.col("__doc"))).select("text", "key", "copies", "bands", "cells")
    found = wanted.mapInArrow(run, SETS)
    return found.groupBy("key").agg(*(F.first(c).alias(c) for c in ("copies", "bands", "cells", "grams")))


def _keyed(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = (words_of(t or "") for t in batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([_key(w) for w in words], pa.binary())], [*columns, "__key"])

    return run


def keep_one(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: one with the smallest doc_id (a null id only if all are null).

    Rows without words are classes of their own and all stay. Null and repeated doc_ids are no reason to go: a row goes
    only if the row that stays has the same words or is linked to it. Of rows with equal doc_id and words any one stays.
    """
    columns, own = docs.columns, ["doc_id", "text"]
    docs = packed(docs, own)
    seen, classes, unique = _classes(docs, n, similarity)
    classes = Written(classes, "classes").df
    if unique:  # an id is a row
        told = seen.select("doc_id", "key").join(classes.select("key", "class_id"), "key")
        gone = told.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__gone"))
        gone = broadcast_if_small(Written(gone, "gone").df, 32)
        return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")), "left_anti").select(*unpacked(columns, own))
    # A row is its id and words. The first of a class: its smallest id, then the smallest key.
    first = classes.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("first"))
    first = broadcast_if_small(Written(first.select(F.col("first.doc").alias("__doc"), F.col("first.key").alias("__first")), "first").df, 48)
    schema = T.StructType([*docs.schema.fields, T.StructField("__key", T.BinaryType())])
    rows = Written(docs.select("*", F.col("text").cast("string").alias("__text")).mapInArrow(_keyed(docs.columns), schema), "keyed").df
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__first"))
    kept = rows.where(F.col("__key").isNotNull()).join(first, same, "left_semi")
    kept = kept.withColumn("__id", F.col("doc_id").cast("long")).dropDuplicates(["__id", "__key"]).drop("__id")
    return kept.unionByName(rows.where(F.col("__key").isNull())).select(*unpacked(columns, own))
