"""Exact nearest neighbours without comparing all pairs.

Vectors are scaled to length one, where cosine order is distance order, and cut into cells around the
leaves of a two-level tree of pivots.  A first round searches every vector's own cell.  The distance of
the k-th vector found there bounds the search of that vector by itself: by the triangle inequality a
second round compares it only with those other cells, and looks only below those branches, that come nearer.
For that round neighbouring cells are packed into groups, and a vector travels once to a group, not to each
of its cells.  Queries and candidates meet in blocks of bounded size, so a cell or group of any size is many
tasks; a block is worked off in slices and keeps k candidates a query, so its memory does not depend on what
the bounds exclude.  Copies of one vector are compared once and share the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = 32768      # vectors per side of a block at most
VALUES = 1 << 22   # numbers per side of a block at most (32 MB)
SLICE = 1024       # vectors per side of one product inside a block
PARTS = 16         # parts to aim at where the input is too small to fill blocks
TASK = 2048        # vectors of one task that looks at vectors one by one
CELL = 256         # vectors of a cell to aim at
MAX_CELLS = 4096   # pivots travel to every task: at most MAX_CELLS vectors; cells grow beyond that
SAMPLE = 4         # vectors drawn for each pivot wanted
SLACK = 1e-4       # rounding allowance of the distance bounds, covers ties of similarity
DIGITS = 9         # similarities equal to this many digits are ties, broken by id


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value bound to a variable: Spark would evaluate it again for every element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def unit_vectors(vectors: DataFrame, centre: bool) -> DataFrame:
    """(id, v) scaled to length one, centred first for Pearson; vectors without a direction drop out."""
    v = F.transform("v", lambda x: x.cast("double"))
    if centre:
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
        v = _once(mean, lambda m: F.transform("v", lambda x: x.cast("double") - m))
    rows = vectors.select("id", v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("n", norm).where("n > 0").select(
        "id", _once(F.col("n"), lambda n: F.transform("v", lambda x: x / n)).alias("v"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0))


class PivotTree:
    """Leaf pivots below branch pivots; leaves of one branch are neighbours in `leaves`.

    Any placement of vectors is right, as bounds come from the radii measured afterwards.
    """

    def __init__(self, pivots: np.ndarray):
        branches = int(np.ceil(np.sqrt(len(pivots))))
        owner = _distances(pivots, pivots[:branches]).argmin(1)
        owner[:branches] = np.arange(branches)          # no branch without a leaf
        self.branches = pivots[:branches]
        self.leaves = pivots[np.argsort(owner, kind="stable")]
        self.edges = np.searchsorted(np.sort(owner), np.arange(branches + 1))

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to it, distance to its branch) of each vector."""
        far = _distances(v, self.branches)
        branch = far.argmin(1)
        leaf, near = np.zeros(len(v), dtype=np.int32), np.zeros(len(v))
        for t in np.unique(branch):
            rows = np.flatnonzero(branch == t)
            d = _distances(v[rows], self.leaves[self.edges[t]:self.edges[t + 1]])
            leaf[rows] = d.argmin(1) + self.edges[t]
            near[rows] = d.min(1)
        return leaf, near, far[np.arange(len(v)), branch]


@dataclass
class Cells:
    """What the second round needs to know of a tree's cells: sizes, radii of leaves and of branches."""

    tree: PivotTree
    size: np.ndarray
    radius: np.ndarray
    spread: np.ndarray

    def bound(self, v: np.ndarray, leaf: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each vector surely has k others: from its branch's leaves or from whole branches."""
        edges = self.tree.edges
        held = np.add.reduceat(self.size, edges[:-1])
        out = _surely(_distances(v, self.tree.branches) + self.spread, held, k)
        branch = np.searchsorted(edges, leaf, side="right") - 1
        for t in np.unique(branch):
            rows, some = np.flatnonzero(branch == t), slice(edges[t], edges[t + 1])
            near = _distances(v[rows], self.tree.leaves[some]) + self.radius[some]
            out[rows] = np.minimum(out[rows], _surely(near, self.size[some], k))
        return out

    def nearer(self, v: np.ndarray, leaf: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, leaf) of the leaves other than its own that a vector's bound does not exclude, branch by branch."""
        far = _distances(v, self.tree.branches)
        for t in range(len(self.spread)):
            rows = np.flatnonzero(far[:, t] <= bound + self.spread[t] + SLACK)
            if not len(rows):
                continue
            some = slice(self.tree.edges[t], self.tree.edges[t + 1])
            ok = _distances(v[rows], self.tree.leaves[some]) <= bound[rows, None] + self.radius[None, some] + SLACK
            i, j = np.nonzero(ok)
            i, j = rows[i], j + some.start
            yield i[leaf[i] != j], j[leaf[i] != j]


def _surely(reach: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Per row, the least reach of cells that together hold k vectors beside the row's own."""
    order = np.argsort(reach, axis=1)
    enough = np.cumsum(size[order], axis=1) > k
    first = np.take_along_axis(reach, order, 1)[np.arange(len(reach)), enough.argmax(1)]
    return np.where(enough.any(1), first, np.inf)


def spread_pivots(drawn: np.ndarray, count: int) -> np.ndarray:
    """`count` of the vectors drawn: half as drawn, so dense places are cut finely, and then always the one
    farthest from those taken, so no group stays without a pivot and swells the cell it falls into."""
    taken = list(range(min(len(drawn), -(-count // 2))))
    far = _distances(drawn, drawn[taken]).min(1)
    while len(taken) < min(count, len(drawn)):
        taken.append(int(far.argmax()))
        far = np.minimum(far, _distances(drawn, drawn[taken[-1:]])[:, 0])
    return drawn[taken]


def _id_type(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def _tasks(rows: DataFrame, count: int) -> DataFrame:
    """Rows dealt to tasks by id: a vector costs far more than its bytes, by which Spark would pack them."""
    return rows.repartition(max(1, min(MAX_CELLS, -(-count // TASK))), "id")


def place(unit: DataFrame) -> tuple[DataFrame, PivotTree | None]:
    """(id, v, cell, dist, far) of every vector and the tree its cells come from."""
    total = unit.count()
    count = min(MAX_CELLS, max(1, -(-total // CELL)))
    kind = _id_type(unit)

    def assigned(tree: PivotTree) -> DataFrame:
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    cell, dist, far = tree.place(_stack(pdf["v"]))
                    yield pdf.assign(cell=cell, dist=dist, far=far)
        return _tasks(unit.select("id", "v"), total).mapInPandas(
            assign, f"id {kind}, v array<double>, cell int, dist double, far double")

    def first(rows: DataFrame, key: Column, most: int) -> list:  # most is at most SAMPLE * MAX_CELLS
        # only ids are put in order, and not by the driver: it would be sent that many vectors by every task
        ids = written(rows.select("id", key.alias("key")).orderBy("key", "id").limit(most), "knn-drawn")
        return [np.array(r.v, dtype="float64") for r in ids.join(unit.select("id", "v"), "id").orderBy("key", "id").select("v").collect()]

    drawn = first(unit, F.xxhash64("id"), count)
    if not drawn:
        return unit.select("id", "v", F.lit(0).alias("cell"), F.lit(0.0).alias("dist"), F.lit(0.0).alias("far")), None
    if count > 1:
        # a second draw by squared distance to the first finds the groups that the first one missed
        u = (F.pmod(F.xxhash64("id", F.lit("far")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        key = -F.log(u) / (F.col("dist") * F.col("dist") + 1e-12)
        drawn += first(assigned(PivotTree(np.stack(drawn))), key, (SAMPLE - 1) * count)
    tree = PivotTree(spread_pivots(np.stack(drawn), count))
    return written(assigned(tree), "knn-cells"), tree


def _side(count: int, dimensions: int) -> int:
    """Vectors per side of a block: as many as memory allows, as every vector travels once for each block of the others."""
    return max(1, min(BLOCK, VALUES // max(1, dimensions), max(SLICE, count // PARTS)))


def _packed(size: np.ndarray, side: int) -> np.ndarray:
    """Group of each cell: neighbouring cells together, up to a block's side."""
    return (np.cumsum(size) - size) // side


def _merged(parts: list[tuple], rank: np.ndarray, k: int) -> tuple:
    """The k best of every row of (row, column, similarity), ties by the column's rank."""
    row, col, sim = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((rank[col], -sim, row))
    at = row[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, dtype=np.int64)
    order = order[np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) < k]
    return row[order], col[order], sim[order]


def _search(q: pd.DataFrame, s: pd.DataFrame, k: int, cells: Cells | None) -> Iterator[tuple]:
    """(query id, candidate id, similarity) of the k best candidates of each query, slice by slice.

    With `cells` a query skips its own cell and those that its bound excludes.
    """
    s = s.sort_values(["cell", "id"])
    ids, leaf = s["id"].to_numpy(), s["cell"].to_numpy()
    rank = np.empty(len(s), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(s))
    sv = _stack(s["v"])
    for start in range(0, len(q), SLICE):
        part = q.iloc[start:start + SLICE]
        own, v, home = part["id"].to_numpy(), _stack(part["v"]), part["cell"].to_numpy()
        least = np.full(len(part), -np.inf)
        if cells is not None:
            bound = part["bound"].to_numpy(dtype="float64")
            least = 1 - (bound + SLACK) ** 2 / 2
        held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)   # row, column, similarity
        new, many = [], 0
        for a in range(0, len(s), SLICE):
            z, rows = min(a + SLICE, len(s)), np.arange(len(part))
            if cells is not None:
                here = np.unique(leaf[a:z])
                ask = _distances(v, cells.tree.leaves[here]) <= bound[:, None] + cells.radius[here][None, :] + SLACK
                rows = np.flatnonzero((ask & (home[:, None] != here[None, :])).any(1))
                if not len(rows):
                    continue
            near = (v if len(rows) == len(v) else v[rows]) @ sv[a:z].T
            i, j = np.divmod(np.flatnonzero(near >= least[rows, None]), z - a)
            other = own[rows[i]] != ids[a + j] if cells is None else home[rows[i]] != leaf[a + j]
            i, j = i[other], j[other]
            new.append((rows[i], a + j, np.round(near[i, j], DIGITS)))
            many += len(i)
            if many > 4 * k * len(part) or z == len(s):
                held, new, many = _merged([held, *new], rank, k), [], 0
                full = np.flatnonzero(np.bincount(held[0], minlength=len(part)) == k)
                kth = np.full(len(part), np.inf)
                np.minimum.at(kth, held[0], held[2])
                least[full] = np.maximum(least[full], kth[full] - 2 * 10.0 ** -DIGITS)
        row, col, sim = _merged([held, *new], rank, k)
        if len(row):
            yield own[row], ids[col], sim


def meet(queries: DataFrame, placed: DataFrame, k: int, key: str = "cell", cells: Cells | None = None) -> DataFrame:
    """k best of the vectors of its `key` for each query sent there, in blocks: a, b, similarity."""
    count, dimensions = placed.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    side = _side(count, dimensions or 1)

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias(name))

    sizes = parts(queries, "qp").join(parts(placed, "sp"), key)

    def chunk(own: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(own)).cast("int")

    def all_of(other: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(other) - 1))

    bound = F.lit(None).cast("double") if cells is None else F.col("bound")
    block_of = F.col(key).alias("block")
    asked = queries.join(sizes, key).select(
        "id", "v", "cell", block_of, chunk("qp").alias("qc"), all_of("sp").alias("sc"), bound.alias("bound"), F.lit(True).alias("query"))
    held = placed.join(sizes, key).select(
        "id", "v", "cell", block_of, all_of("qp").alias("qc"), chunk("sp").alias("sc"), F.lit(None).cast("double").alias("bound"),
        F.lit(False).alias("query"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        q, s = pdf[pdf["query"]], pdf[~pdf["query"]]
        found = list(_search(q, s, k, cells)) if len(q) and len(s) else []
        if not found:
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        a, b, similarity = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": a, "b": b, "similarity": similarity})

    kind = _id_type(placed)
    return asked.unionByName(held).groupBy("block", "qc", "sc").applyInPandas(block, f"a {kind}, b {kind}, similarity double")


def measured(placed: DataFrame, tree: PivotTree) -> Cells:
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("near"), F.max("far").alias("far")).collect()
    size, radius = np.zeros(len(tree.leaves), dtype=np.int64), np.full(len(tree.leaves), -np.inf)
    spread = np.full(len(tree.branches), -np.inf)
    for r in stats:  # at most MAX_CELLS rows
        size[r.cell], radius[r.cell] = r.n, r.near
        t = int(np.searchsorted(tree.edges, r.cell, side="right")) - 1
        spread[t] = max(spread[t], r.far)
    return Cells(tree, size, radius, spread)


def sent_away(placed: DataFrame, tree: PivotTree, home: DataFrame, k: int, cells: Cells | None = None) -> DataFrame:
    """(id, bound, pack) of every group with another cell that a vector has to ask, given what it found at home."""
    cells = cells or measured(placed, tree)
    total = int(cells.size.sum())
    packs = _packed(cells.size, _side(total, tree.leaves.shape[1]))
    kth = home.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("found"), F.min("similarity").alias("least")).where(
        F.col("found") >= k).select("id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).alias("kth"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v, leaf = _stack(pdf["v"]), pdf["cell"].to_numpy()
            bound = np.fmin(pdf["kth"].to_numpy(dtype="float64"), cells.bound(v, leaf, k))
            asked = np.zeros((len(pdf), int(packs[-1]) + 1), dtype=bool)
            for row, cell in cells.nearer(v, leaf, bound):
                asked[row, packs[cell]] = True
            row, pack = np.nonzero(asked)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "bound": bound[row], "pack": pack.astype("int32")})

    rows = _tasks(placed.select("id", "v", "cell").join(kth, "id", "left"), total)
    return rows.mapInPandas(send, f"id {_id_type(placed)}, bound double, pack int")


def _knn_distinct(unit: DataFrame, k: int) -> DataFrame:
    """k nearest among distinct vectors: a, b, similarity."""
    placed, tree = place(unit)
    home = top_k(meet(placed.select("id", "v", "cell"), placed, k), k)
    if tree is None or len(tree.leaves) == 1:
        return home
    home = written(home, "knn-home")
    cells = measured(placed, tree)
    # the vectors themselves are joined on afterwards, so they are not written once more for every group
    away = written(sent_away(placed, tree, home, k, cells), "knn-sent").join(placed.select("id", "v", "cell"), "id")
    packs = _packed(cells.size, _side(int(cells.size.sum()), tree.leaves.shape[1]))
    packed = placed.join(placed.sparkSession.createDataFrame(
        list(enumerate(packs.tolist())), "cell int, pack int"), "cell").select("id", "v", "cell", "pack")
    return top_k(home.unionByName(meet(away, packed, k, "pack", cells)), k)


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def knn(vectors: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """k most similar other vectors of each of `vectors(id, v)`: a, b, similarity.

    Cosine or Pearson; ties by smaller id.
    """
    unit = written(unit_vectors(vectors, centre=metric == "pearson").withColumn(
        "copy", F.sha2(F.to_json("v"), 256)), "knn-unit")
    groups = unit.groupBy("copy").agg(F.min("id").alias("rep"))
    distinct = unit.join(groups, (unit.copy == groups.copy) & (unit.id == groups.rep)).select("id", "v")
    near = _knn_distinct(written(distinct, "knn-distinct"), k)
    # of each set of copies only the k+1 smallest ids can be a neighbour of anything
    member = unit.select("id", "copy").join(groups, "copy").select("id", "rep")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    few = member.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("rep", F.col("id").alias("b"))
    reps = near.unionByName(groups.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")))
    reach = reps.withColumnRenamed("b", "rep").join(few, "rep").select("a", "b", "similarity")
    # k+1 candidates per representative are enough for every copy, one of them may be the copy itself
    pairs = top_k(reach, k + 1).withColumnRenamed("a", "rep").join(member.withColumnRenamed("id", "a"), "rep")
    return top_k(pairs.where("a <> b").select("a", "b", "similarity"), k)
