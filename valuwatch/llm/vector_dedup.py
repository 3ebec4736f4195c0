"""Near-duplicate vectors by exact range search over blocks that the angle cannot exclude.

Every vector has one home, the cluster of its nearest centre.  Small clusters are packed into a block,
large ones are dealt to as many blocks as their size asks for.  A vector meets a block unless the angle
excludes it: a vector of cluster c is nearer to c than to any other centre, so it lies beyond the plane
between the centres, and its angle to c lies between the smallest and the largest of the cluster.  Where
neither bound exceeds the range, the vector is sent there, however many blocks that are; so no pair in
range is lost, and a dense group of any size is joined block by block.

Each pair of blocks meets in one of the two.  Similarities are matrix products in single precision; what
is within their error of the limit is decided in double.  Counts add up without gathering pairs, and each
group hands on a spanning forest of its links, which is all that components need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, written
from .common import let
from .components import connected_components

COSINE = 0.9
#: Vectors aimed at per cluster; fewest and most vectors aimed at per block (the most at WIDTH components), blocks of a small table.
PER_CLUSTER, FEWEST, MOST, WIDTH, PARTS = 1024, 1024, 8192, 64, 16
#: Blocks whose vectors are searched for in one task, and of how many vectors at a time.
SPAN, AT_ONCE = 8, 1024
#: Documented bound of the sample that clusters are fitted on, and of clusters; both only decide how much is excluded.
SAMPLE, MOST_CLUSTERS = 32_768, 4_096
#: Slack of the bounds, above the rounding of angles and products in double precision.
SLACK = 1e-6


def unit(v: Column) -> Column:
    """The vector at length one in double precision, or null if it links with nothing: null, empty, zero,
    or with null or non-finite components."""
    def at_one(d: Column) -> Column:
        bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        top = F.array_max(F.transform(d, lambda x: F.abs(x)))
        # scaled to the largest component first, which keeps squares in range
        return F.when(~bad & (top > 0), let(top, lambda t: let(F.transform(d, lambda x: x / t), divided)))

    def divided(s: Column) -> Column:
        length = F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x))
        return let(length, lambda n: F.transform(s, lambda x: x / n))

    return let(v.cast("array<double>"), at_one)


def centres(units: DataFrame, n: int, rounds: int = 8) -> np.ndarray:
    """Cluster centres by spherical k-means on a bounded sample, taken in order of a hash of the vector."""
    sample = units.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["v"]
    if not len(sample):
        return np.zeros((0, 0))
    width = len(sample.iloc[0])
    x = np.array([v for v in sample if len(v) == width], dtype=np.float32)
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[k:k + 4096] @ c.T).argmax(1) for k in range(0, len(x), 4096)])
        for k in range(len(c)):
            some = x[near == k]
            if len(some) and (length := np.linalg.norm(total := some.sum(0))) > 0:
                c[k] = total / length
    return c


def _similar(v: pd.Series, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, similarities to the centres) of the vectors of the centres' length, some at a time."""
    same = np.flatnonzero(v.map(len).to_numpy() == c.shape[1])
    for k in range(0, len(same), 512):
        some = same[k:k + 512]
        yield some, np.stack(v.iloc[some].to_numpy()) @ c.T


def _homes(nodes: DataFrame, centre: np.ndarray) -> DataFrame:
    """(node, v, copies, cluster, angle): the cluster of the nearest centre and the angle to it.  Vectors of
    another length are a cluster of their own kind, below zero."""
    shared = nodes.sparkSession.sparkContext.broadcast(centre)      # MOST_CLUSTERS vectors at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            cluster, angle = -1 - b["v"].map(len).to_numpy(), np.zeros(len(b))
            for some, s in _similar(b["v"], c):
                home = s.argmax(1)
                cluster[some] = home
                angle[some] = _angles(s[np.arange(len(some)), home], np.linalg.norm(c[home], axis=1))
            yield b.assign(cluster=cluster, angle=angle)

    return nodes.select("node", "v", "copies").mapInPandas(
        run, "node bigint, v array<double>, copies bigint, cluster bigint, angle double")


def _angles(s: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(s / length, -1, 1))


class Blocks:
    """Which blocks the vectors of a cluster go to, and which blocks a vector must be searched for in.

    `clusters` has the cluster, n, low and high (angles) of every cluster that is not empty.  A pack is a
    cluster, or small clusters in a row by nearness; it has one block, or as many as its size asks for.
    """

    def __init__(self, clusters: pd.DataFrame, centre: np.ndarray, cosine: float):
        self.centre, self.range = centre, np.arccos(np.clip(cosine, -1, 1)) + SLACK
        self.side = np.sin(self.range) if self.range < np.pi / 2 else np.inf
        rows = clusters.set_index("cluster")
        self.chain = np.array(_chain(centre, sorted(k for k in rows.index if k >= 0)), dtype=np.int64)
        self.low, self.high = rows["low"].reindex(self.chain).to_numpy(), rows["high"].reindex(self.chain).to_numpy()
        total = int(rows["n"].sum()) if len(rows) else 0
        self.pack: dict[int, int] = {}
        self.starts: list[int] = []                                   # of packs in the chain
        sizes: list[int] = []
        most: list[int] = []
        for k, cluster in enumerate([*self.chain.tolist(), *(k for k in rows.index if k < 0)]):
            width, n = centre.shape[1] if cluster >= 0 else -1 - cluster, int(rows["n"][cluster])
            size = max(512, min(max(FEWEST, -(-total // PARTS)), MOST, MOST * WIDTH // max(1, width)))
            if cluster < 0 or not sizes or sizes[-1] + n > size:
                sizes.append(0)
                most.append(size)
                if cluster >= 0:
                    self.starts.append(k)
            sizes[-1] += n
            self.pack[cluster] = len(sizes) - 1
        self.pieces = np.array([-(-n // m) for n, m in zip(sizes, most, strict=True)], dtype=np.int64)
        self.first = np.cumsum(self.pieces) - self.pieces
        self.n = int(self.pieces.sum())
        self.spans = self.n // 2 // SPAN + 1

    def packs_met(self, home: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Per vector, given its home and its similarities to the centres, the packs it may find something in."""
        c = self.centre[self.chain]
        near = s[np.arange(len(s)), home]
        apart = np.sqrt(np.maximum(0, ((self.centre ** 2).sum(1)[home][:, None] + (c ** 2).sum(1) - 2 * self.centre[home] @ c.T)))
        s = s[:, self.chain]
        angle = _angles(s, np.linalg.norm(c, axis=1))
        met = near[:, None] - s <= self.side * (apart + SLACK) + SLACK
        met &= (angle - self.high <= self.range) & (self.low - angle <= self.range)
        return np.logical_or.reduceat(met, self.starts, axis=1)

    def routes(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(block, span, own, node, v, copies): each vector in every span of its own block, and as a query of
        the blocks it meets among the half of all that follow its own in a circle."""
        every = np.arange(self.n)
        of_block = np.repeat(np.arange(len(self.pieces)), self.pieces)
        for b in batches:
            met = np.zeros((len(b), len(self.pieces)), dtype=bool)
            pack = b["cluster"].map(self.pack).to_numpy(dtype=np.int64)
            home = b["cluster"].to_numpy()
            for some, s in _similar(b["v"], self.centre):
                met[some, :len(self.starts)] = self.packs_met(home[some], s)
            met[np.arange(len(b)), pack] = True
            mixed = (b["node"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = self.first[pack] + (mixed % self.pieces[pack].astype(np.uint64)).astype(np.int64)
            data = np.array([np.asarray(v, dtype=np.float64).tobytes() for v in b["v"]], dtype=object)
            node, copies = b["node"].to_numpy(), b["copies"].to_numpy()
            for k in range(0, len(b), AT_ONCE):
                ahead = (every - block[k:k + AT_ONCE, None]) % self.n
                half = (ahead > 0) & ((2 * ahead < self.n) | (2 * ahead == self.n) & (block[k:k + AT_ONCE, None] < every))
                i, j = np.nonzero(half & met[k:k + AT_ONCE][:, of_block])
                mine = np.repeat(np.arange(len(ahead)), self.spans)
                at = np.concatenate([mine, i]) + k
                yield pd.DataFrame({
                    "block": np.concatenate([block[mine + k], j]),
                    "span": np.concatenate([np.tile(np.arange(self.spans), len(ahead)), ahead[i, j] // SPAN]),
                    "own": np.arange(len(at)) < len(mine), "node": node[at], "v": data[at], "copies": copies[at]})


def _chain(centre: np.ndarray, some: list[int]) -> list[int]:
    """Clusters in a row, each followed by the nearest one that is left."""
    if not some:
        return []
    out, left = [some[0]], np.array(some[1:], dtype=np.int64)
    while len(left):
        k = int((centre[left] @ centre[out[-1]]).argmax())
        out.append(int(left[k]))
        left = np.delete(left, k)
    return out


def _span(hit: np.ndarray, row: np.ndarray, col: np.ndarray, label: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of `hit` that connect what has different labels, and the labels after that."""
    out: list[tuple[int, int]] = []
    while True:
        apart = hit & (label[row][:, None] != label[col])
        i, j = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
        if not len(i):
            return out, label
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while (p := parent.setdefault(k, k)) != k:
                parent[k] = k = parent[p]
            return k

        u = np.concatenate([row[i], row[apart[:, j].argmax(0)]])
        v = np.concatenate([col[apart[i].argmax(1)], col[j]])
        for s, t, a, b in zip(u.tolist(), v.tolist(), label[u].tolist(), label[v].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((s, t))
        to = np.arange(len(label))
        for k in list(parent):
            to[k] = root(k)
        label = to[label]


def range_join(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of a block's own vectors with the queries and, in its first span, with each other: (u, -1, n)
    counts the links of u, (u, v, 0) are links that span the components."""
    pdf = pdf.sort_values("own", ascending=False, kind="stable")
    n_own, first = int(pdf["own"].sum()), 0 if pdf["span"].iloc[0] == 0 else int(pdf["own"].sum())
    x = np.frombuffer(b"".join(pdf["v"]), dtype=np.float64).reshape(len(pdf), -1)
    single, error = x.astype(np.float32), 6e-8 * (x.shape[1] + 8)
    weight, count = pdf["copies"].to_numpy(dtype=np.float64), np.zeros(len(pdf))
    label, tree, own = np.arange(len(pdf)), [], np.arange(n_own)
    cuts = [*range(first, n_own, AT_ONCE), *range(max(first, n_own), len(pdf), AT_ONCE), len(pdf)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        s = single[start:end] @ single[:n_own].T
        hit = s >= cosine + error
        i, j = np.nonzero(~hit & (s >= cosine - error))
        hit[i, j] = np.einsum("ij,ij->i", x[start + i], x[j]) >= cosine
        row = np.arange(start, end)
        if start < n_own:
            hit[row - start, row] = False                             # the vector itself
        if not hit.any():
            continue
        count[start:end] += hit @ weight[:n_own]
        if start >= n_own:
            count[:n_own] += weight[start:end] @ hit
        links, label = _span(hit, row, own, label)
        tree += links
    node, linked = pdf["node"].to_numpy(), np.flatnonzero(count)
    u, v = np.array(tree, dtype=np.int64).reshape(-1, 2).T
    return pd.DataFrame({"u": np.concatenate([node[linked], node[u]]), "v": np.concatenate([np.full(len(linked), -1), node[v]]),
                         "n": np.concatenate([count[linked].astype(np.int64), np.zeros(len(u), dtype=np.int64)])})


def near_links(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, counts, forest): each row's node; links counted per node; links that span the components.

    Rows of equal direction are one node, its number the smallest id among them.
    """
    rows = vectors.select(F.col(id).alias("id"), unit(F.col(vector)).alias("v"))
    # equal up to rounding in the last places of a double
    rows = rows.withColumn("same", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.transform("v", lambda x: F.round(x, 13) + 0.0)), 256)))
    nodes = written(rows.where("same is not null").groupBy("same").agg(
        F.min("v").alias("v"), F.count(F.lit(1)).alias("copies")).withColumn(
        "node", F.monotonically_increasing_id()), "vec-nodes")
    n = nodes.count()
    centre = centres(nodes, max(1, min(MOST_CLUSTERS, -(-n // PER_CLUSTER)))).astype(np.float64)
    homes = written(_homes(nodes, centre), "vec-homes")
    # a row per cluster and per length of vectors
    clusters = homes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).toPandas()
    blocks = Blocks(clusters.sort_values("cluster"), centre, cosine)
    shared = nodes.sparkSession.sparkContext.broadcast(blocks)
    placed = homes.mapInPandas(lambda batches: shared.value.routes(batches),
                               "block bigint, span bigint, own boolean, node bigint, v binary, copies bigint")
    found = written(placed.groupBy("block", "span").applyInPandas(
        lambda pdf: range_join(pdf, cosine), "u bigint, v bigint, n bigint"), "vec-links")
    counts = found.where("v < 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    forest = found.where("v >= 0").select("u", "v")
    keys = written(rows.select("id", "same").join(nodes.select("same", "node", "copies"), "same", "left"), "vec-rows")
    discard(homes)
    return keys, counts, forest


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row of `vectors`: its id, n_links (other rows linked directly) and component_id (smallest id
    reachable by links, its own included).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
    of different lengths do not link with each other.  Rows of equal direction link with one another;
    repeated ids count as rows, and null ids are passed over where a smallest id is taken.  An empty
    table gives an empty result; other columns are not carried.
    """
    rows, counts, forest = near_links(vectors, id, vector, cosine)
    parts = connected_components(forest, "u", "v")
    labelled = rows.join(counts, "node", "left").join(parts, "node", "left").withColumn(
        "part", F.coalesce("component", "node"))
    least = labelled.where("part is not null").groupBy("part").agg(F.min("id").alias("least"))
    return labelled.join(least, "part", "left").select(
        F.col("id").alias(id), F.coalesce(F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "id").alias("component_id"))


def exact_links(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                every: int = 20) -> DataFrame:
    """(id, n_links) by brute force for the stated queries, rows whose id is divisible by `every`, against
    all rows in blocks of one Arrow batch.  For audits; the queries go to every task and are refused
    beyond a fixed number."""
    units = vectors.select(F.col(id).alias("id"), unit(F.col(vector)).alias("v"))
    q = units.where((F.col("id") % every == 0) & F.col("v").isNotNull()).limit(200_001).toPandas()
    if len(q) > 200_000:
        raise ValueError("too many audit queries; raise `every`")
    shared = vectors.sparkSession.sparkContext.broadcast(np.array(q["v"].tolist()))
    ids = q["id"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            x = np.array(b["v"].tolist())
            for k in range(0, len(ids), 1024):
                total[k:k + 1024] += (shared.value[k:k + 1024] @ x.T >= cosine).sum(1)
        yield pd.DataFrame({"id": ids, "n": total})

    return units.where("v is not null").mapInPandas(run, "id bigint, n bigint").groupBy("id").agg((F.sum("n") - 1).alias("n_links"))
