"""Operator 6, embedding near-dedup: a forest of random-projection trees with spill.

Each tree is fitted on a bounded sample: recursive random splits, with rows near a split going to both sides. All rows
are routed through all trees; leaves that hold many rows, as they do when the table outgrows the sample, are split on, each
by a sample of its own rows, until none is large. Rows are compared within their leaves, in blocks. A pair is counted in the first tree and
leaf that hold both, so counts need no table of pairs; each leaf gives a spanning link for each row, and the
components of those links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import Written, broadcast_if_small
from loomline.llm.components import connected_components


def directions_of(rng: np.random.Generator, dims: int, n: int = 12) -> np.ndarray:
    d = rng.standard_normal((n, dims))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def best_cut(x: np.ndarray, directions: np.ndarray, spill: float) -> tuple[int, float] | None:
    """(which direction, threshold) of the cheapest split of unit rows; none if all put over two in five on both sides."""
    best = None
    for i, d in enumerate(directions):
        p = np.sort(x @ d)
        cuts = np.quantile(p, np.linspace(0.2, 0.8, 25))
        low, high = np.searchsorted(p, cuts - spill), np.searchsorted(p, cuts + spill, "right")
        # Rows of the two sides, squared: what comparing them costs.
        cost = (high / len(p)) ** 2 + (1 - low / len(p)) ** 2
        k = int(cost.argmin())
        if (high[k] - low[k]) <= 0.4 * len(p) and (best is None or cost[k] < best[0]):
            best = (cost[k], i, float(cuts[k]))
    return None if best is None else best[1:]


class Tree:
    """Inner nodes hold a direction and a threshold; ``kids`` are node numbers, or -1 - leaf."""

    def __init__(self):
        self.directions: list[np.ndarray] = []
        self.thresholds: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.leaves = 0

    def fit(self, x: np.ndarray, leaf: float, spill: float, rng: np.random.Generator, depth: int = 40) -> int:
        """Fit on unit rows; a split must put at most two in five rows on both sides, or the node stays a leaf."""
        split = self._split(x, spill, rng) if len(x) > leaf and depth else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        at = len(self.kids)
        self.directions.append(split[0])
        self.thresholds.append(split[1])
        self.kids.append((0, 0))
        p = x @ split[0] - split[1]
        self.kids[at] = (self.fit(x[p <= spill], leaf, spill, rng, depth - 1), self.fit(x[p >= -spill], leaf, spill, rng, depth - 1))
        return at

    def _split(self, x: np.ndarray, spill: float, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
        directions = directions_of(rng, x.shape[1])
        best = best_cut(x, directions, spill)
        return None if best is None else (directions[best[0]], best[1])

    def route(self, x: np.ndarray, spill: float) -> list[list[int]]:
        """The leaves of each unit row."""
        out: list[list[int]] = [[] for _ in x]
        todo = [(0 if self.kids else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                for r in rows:
                    out[r].append(-1 - node)
            elif len(rows):
                p = x[rows] @ self.directions[node] - self.thresholds[node]
                todo += [(self.kids[node][0], rows[p <= spill]), (self.kids[node][1], rows[p >= -spill])]
        return out


def unit(vectors: list[bytes], single: bool = False) -> np.ndarray:
    """Unit rows in double precision; ``single``: the bytes are those of single numbers, which lose nothing."""
    x = np.stack([np.frombuffer(v, np.float32 if single else np.float64) for v in vectors]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """Distinct (id, vec) rows with an id and a vector of finite components; ``zero``: zero vectors may stay."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False)) & (F.size(v) > 0)
    if not zero:
        fine &= F.exists(v, lambda c: c != 0)
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: c + F.lit(0.0)).alias("vec")).distinct()


def fit_forest(sample: dict[int, np.ndarray], totals: dict[int, int], n_trees: int, leaf: int, spill: float, seed: int) -> dict[int, list[Tree]]:
    """Trees by dimension; a leaf of the sample stands for about ``leaf`` rows of the table."""
    forest = {}
    for dim, x in sorted(sample.items()):
        forest[dim] = []
        for k in range(n_trees):
            tree = Tree()
            tree.fit(x, max(32.0, leaf * len(x) / totals[dim]), spill, np.random.default_rng([seed, dim, k]))
            forest[dim].append(tree)
    return forest


#: Cells are numbered so that a split cell's parts follow it: cell * (PARTS + 1) + 1 + part; one that stays, cell * (PARTS + 1).
DEPTH = 4
PARTS = 1 << DEPTH
FIRST_LEAVES = 20  # bits of a leaf's number in its tree
MOST_ROUNDS = 9  # of splitting on: cells then still fit 64 bits, and a first leaf may be 16**9 times too large


def _router(sent, spill: float, single: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), batch.column(1)
            dims = np.array([len(v) for v in vecs])
            for dim in np.unique(dims):
                for rows in np.array_split(np.flatnonzero(dims == dim), max(1, int((dims == dim).sum()) // 2000)):
                    raw = [vecs[int(r)].values.to_numpy().astype(np.float32 if single else np.float64).tobytes() for r in rows]
                    x = unit(raw, single)
                    leaves = [t.route(x, spill) for t in forest[int(dim)]]
                    # Each (tree, leaf) as one number, ascending by tree: the first common one owns a pair.
                    cells = [[(k << FIRST_LEAVES) + c for k, own in enumerate(leaves) for c in sorted(own[i])] for i in range(len(rows))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array([int(dim)] * len(rows), pa.int32()), pa.array(raw, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["id", "dim", "vec", "cells"])

    return run


def _node_directions(seed: int, dim: int, cell: int, node: int) -> np.ndarray:
    return directions_of(np.random.default_rng([seed, dim, cell, node]), dim)


def _fit_cell(spill: float, seed: int, single: bool, enough: int):
    """(dim, cell, vec, rows) of a cell's sample -> its DEPTH levels of splits: thresholds, and which seeded direction; -1 none."""
    out = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("cuts", pa.list_(pa.float64())), ("picks", pa.list_(pa.int32()))])

    def run(group: pa.Table) -> pa.Table:
        dim, cell, n = group.column("dim")[0].as_py(), group.column("cell")[0].as_py(), group.column("n")[0].as_py()
        cuts, picks, todo = [0.0] * (PARTS - 1), [-1] * (PARTS - 1), [(0, unit(group.column("vec").to_pylist(), single))]
        share = n / group.num_rows  # rows that a row of the sample stands for
        while todo:
            node, x = todo.pop()
            if node < PARTS - 1 and len(x) * share > enough and len(x) >= 16:
                directions = _node_directions(seed, dim, cell, node)
                found = best_cut(x, directions, spill)
                if found is not None:
                    picks[node], cuts[node] = found
                    p = x @ directions[found[0]] - found[1]
                    todo += [(2 * node + 1, x[p <= spill]), (2 * node + 2, x[p >= -spill])]
        return pa.table([[dim], [cell], [cuts], [picks]], schema=out)

    return run


def _split_on(sent, spill: float, seed: int, single: bool, renumber: bool):
    """Put rows of the cells that ``sent`` holds into their parts; ``renumber`` the other cells too."""

    def parts(x: np.ndarray, dim: int, cell: int, cuts: list[float], picks: list[int]) -> list[tuple[int, np.ndarray]]:
        out, todo = [], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node >= PARTS - 1 or picks[node] < 0:
                while node < PARTS - 1:  # a node that stays whole is the first part below it
                    node = 2 * node + 1
                out.append((node - (PARTS - 1), rows))
                continue
            p = x[rows] @ _node_directions(seed, dim, cell, node)[picks[node]] - cuts[node]
            todo += [(2 * node + 1, rows[p <= spill]), (2 * node + 2, rows[p >= -spill])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            dims, raw, cells = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            new: list[list[int]] = [[] for _ in cells]
            inside: dict[tuple[int, int], list[int]] = {}
            for i, own in enumerate(cells):
                for c in own:
                    old, part = (c, 0) if renumber else divmod(c, PARTS + 1)
                    if not part and (dims[i], old) in known:
                        inside.setdefault((dims[i], old), []).append(i)
                    else:
                        new[i].append(c * (PARTS + 1) if renumber else c)
            for (dim, cell), rows in inside.items():
                for part, at in parts(unit([raw[i] for i in rows], single), dim, cell, *known[dim, cell]):
                    for j in at:
                        new[rows[j]].append(cell * (PARTS + 1) + 1 + part)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([sorted(c) for c in new], pa.list_(pa.int64()))], ["id", "dim", "vec", "cells"])

    return run


def _sizes(routed: DataFrame) -> Written:
    return Written(routed.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")), "sizes")


def split_large(routed: Written, leaf: int, spill: float, seed: int, single: bool, cell_sample: int = 1024, together: int = 50_000) -> tuple[Written, Written]:
    """Split the cells of over 4 * leaf rows on, round by round; (routed, sizes) when none is left that splits.

    A round fits DEPTH levels on up to ``cell_sample`` rows of each large cell (those whose hash comes first) and writes the
    rows with their new cells. Thresholds of at most ``together`` cells, some 200 bytes each, are broadcast at a time.
    """
    spark, sizes = routed.spark, _sizes(routed.df)
    whole: DataFrame | None = None  # cells that did not split, by their number of now
    for _ in range(MOST_ROUNDS):
        large = sizes.df.where(F.col("n") > 4 * leaf)
        if whole is not None:
            large = large.join(whole, ["dim", "cell"], "left_anti")
        large = Written(large, "large")
        n_large = large.df.count()
        if not n_large:
            break
        side = F.broadcast(large.df) if n_large <= 500_000 else large.df.hint("merge")  # 20 bytes a row
        own = routed.df.select("dim", "vec", F.explode("cells").alias("cell"), F.xxhash64("id").alias("o")).join(side, ["dim", "cell"])
        own = own.withColumn("k", F.row_number().over(Window.partitionBy("dim", "cell").orderBy("o"))).where(F.col("k") <= cell_sample).select("dim", "cell", "vec", "n")
        fitted = Written(own.groupBy("dim", "cell").applyInArrow(_fit_cell(spill, seed, single, leaf), "dim int, cell long, cuts array<double>, picks array<int>"), "fitted")
        split, passes = fitted.df.where("picks[0] >= 0"), max(1, -(-n_large // together))
        stay = fitted.df.where("picks[0] < 0").select("dim", "cell")
        if split.isEmpty():
            break
        for i in range(passes):
            rows = split.where(F.pmod(F.xxhash64("dim", "cell"), F.lit(passes)) == i).collect()
            sent = spark.sparkContext.broadcast({(r["dim"], r["cell"]): (r["cuts"], r["picks"]) for r in rows})
            before, routed = routed, Written(routed.df.mapInArrow(_split_on(sent, spill, seed, single, i == 0), "id long, dim int, vec binary, cells array<long>"), "routed")
            before.drop()
            sent.unpersist()
        stay = stay if whole is None else stay.unionByName(whole)
        whole = Written(stay.select("dim", (F.col("cell") * (PARTS + 1)).alias("cell")), "whole").df
        sizes.drop()
        sizes = _sizes(routed.df)
    return routed, sizes


def _compare(threshold: float, single: bool):
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("low", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        ids, sides = group.column("id").to_numpy(), group.column("side").to_numpy()
        diagonal = bool(group.column("first")[0].as_py())
        left = np.arange(len(ids)) if diagonal else np.flatnonzero(sides == 0)
        right = left if diagonal else np.flatnonzero(sides == 1)
        if not len(left) or not len(right):
            return out.empty_table()
        x = unit(group.column("vec").to_pylist(), single)
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[a], right[b]
        real = ids[a] != ids[b]
        if diagonal:
            real &= a < b
        a, b = a[real], b[real]
        if not len(a):
            return out.empty_table()
        # Owned here: no cell before this one holds both. Rows carry their earlier cells, of which a matrix tells.
        rows = np.unique(np.concatenate([a, b]))
        own = group.column("cells").take(pa.array(rows)).combine_chunks()
        lengths = np.diff(own.offsets.to_numpy())
        numbers, at = own.flatten().to_numpy(), np.repeat(rows, lengths)
        known, number = np.unique(numbers, return_inverse=True)
        inside = np.zeros((len(ids), max(1, len(known))), bool)
        inside[at, number] = True
        packed = np.packbits(inside, axis=1)
        owned = np.concatenate([~(packed[a[i : i + 100_000]] & packed[b[i : i + 100_000]]).any(axis=1) for i in range(0, len(a), 100_000)])
        n = np.bincount(a[owned], minlength=len(ids)) + np.bincount(b[owned], minlength=len(ids))
        # Smallest id reachable inside this group of rows: labels fall along the links until none changes.
        low = ids.copy()
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            if (new == low).all():
                break
            low = new
        return pa.table([ids[rows], n[rows], low[rows]], schema=out)

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, n_trees: int = 6, leaf: int = 512, spill: float = 0.03, sample_rows: int = 20_000, block: int = 512, seed: int = 11
) -> DataFrame:
    """One row per row of ``vectors``: its id, n_links, component_id and kept.

    Two vectors of one length are linked if a tree puts them into one leaf and their cosine, in double precision, is
    at least ``threshold``; with the defaults a pair of exactly the threshold is missed with a probability of about one in a
    million at 64 dimensions. n_links counts other ids, component_id is the smallest id reachable by links (the own
    one at least) and kept tells whether they are the same. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, link with nothing. Repeated rows count once and get a row each; an
    id with several vectors has the links of all of them. Other columns are ignored.

    The trees are fitted on at most ``sample_rows`` rows of each length (those whose hash comes first); leaves that are still
    large are split on by samples of their own (split_large). Every row is routed and compared. A leaf of any size, such as
    one of copies, is compared in blocks of ``block`` rows, one task for each pair of blocks.
    """
    fine = Written(valid_vectors(vectors, id_col, vec_col, zero=False).withColumn("dim", F.size("vec")), "vectors").df
    totals = {r["dim"]: r["n"] for r in fine.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = vectors.select(F.col(id_col).cast("long").alias(id_col))
    if not totals:
        return base.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    sample = {}
    for dim in totals:  # a few lengths at most: a table of embeddings has one
        picked = fine.where(F.col("dim") == dim).select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
        sample[dim] = unit([np.asarray(v.values, np.float64).tobytes() for v in picked.column("vec")])
    sent = vectors.sparkSession.sparkContext.broadcast(fit_forest(sample, totals, n_trees, leaf, spill, seed))
    single = vectors.schema[vec_col].dataType.elementType == T.FloatType()
    routed = Written(fine.select("id", "vec").mapInArrow(_router(sent, spill, single), "id long, dim int, vec binary, cells array<long>"), "routed")
    routed, sizes = split_large(routed, leaf, spill, seed, single)
    blocks = broadcast_if_small(sizes.df.select("dim", "cell", F.ceil(F.col("n") / block).cast("int").alias("nb")), 24)
    b = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("b", o).alias("bi"), F.greatest("b", o).alias("bj"), (F.col("b") > o).cast("int").alias("side"), (F.col("b") == o).alias("first")))
    # Each row goes to its cells with the cells before, by which pairs are owned.
    dealt = routed.df.select("id", "dim", "vec", F.posexplode("cells").alias("at", "cell"), "cells").withColumn("cells", F.slice("cells", F.lit(1), F.col("at")))
    dealt = dealt.join(blocks, ["dim", "cell"]).withColumn("b", b).select("id", "dim", "cell", "vec", "cells", F.inline(pairs))
    found = Written(dealt.groupBy("dim", "cell", "bi", "bj").applyInArrow(_compare(threshold, single), "id long, n long, low long"), "links").df
    counts = found.groupBy(F.col("id").alias("__id")).agg(F.sum("n").alias("__n"))
    linked = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    if linked is None:
        return base.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    told = base.join(counts, F.col(id_col) == F.col("__id"), "left").join(linked.df, F.col(id_col) == F.col("node"), "left")
    component = F.coalesce("component", F.col(id_col))
    return told.select(id_col, F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col(id_col)).alias("kept"))
