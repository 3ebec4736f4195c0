"""Approval communities: weighted graph, modularity, Louvain as an iterative DataFrame job."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Book
from ..session import discard, written

# Fixed value: roles that carry an independent control function.
INDEPENDENT_ROLE = "(?i)^.*(ipv|product control|risk|controller|vcg|map|model).*$"
SCALE = 10_000  # weights are held as whole numbers of 1/SCALE, so sums do not depend on their order


def approval_edges(b: Book) -> DataFrame:
    """approver -> author of the override approved, weighted by how often; nobody with themselves."""
    overrides = b.event.where("label = 'PriceOverride'").select(F.col("event_id").alias("source_event_id"),
                                                               F.col("performer_id").alias("author"))
    approvals = b.response.where("kind = 'Approval' and source_label = 'PriceOverride'").select(
        "source_event_id", F.col("person_id").alias("approver"))
    return approvals.join(overrides, "source_event_id").where("approver <> author").groupBy("approver", "author").agg(
        F.count(F.lit(1)).alias("weight"))


def independence_flag(b: Book) -> DataFrame:
    """Control desk or control role; unknown on one side leaves the answer to the other."""
    return b.person.join(b.desk.select("desk_id", "control"), "desk_id", "left").select(
        "person_id", (F.col("control") | F.col("role").rlike(INDEPENDENT_ROLE)).alias("independent"))


def circle_rollup(b: Book, members: DataFrame) -> DataFrame:
    """Size, desks and independence of each community of `members(node, community)`."""
    people = members.join(b.person.select(F.col("person_id").alias("node"), "desk_id"), "node", "left").join(
        independence_flag(b).withColumnRenamed("person_id", "node"), "node", "left")
    return people.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("desk_id").alias("desks"),
                                           F.coalesce(F.bool_or("independent"), F.lit(False)).alias("has_independent"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w): undirected edges in both directions, parallel ones added up, whole weights."""
    w = F.round(F.col("w") * SCALE).cast("bigint")
    one = edges.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), w.alias("w"))
    two = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return one.unionByName(two).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _quality(graph: DataFrame, labels: DataFrame, resolution: float) -> DataFrame:
    """One row, q: share of weight inside communities minus what chance would put there."""
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    z = labels.select(F.col("node").alias("dst"), F.col("community").alias("cz"))
    per = graph.join(a, "src").join(z, "dst").groupBy("ca").agg(
        F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cz"), F.col("w")).otherwise(0)).alias("inside"))
    total = F.sum("k").cast("double")
    return per.agg((F.sum("inside") / total - F.lit(resolution) * F.sum(F.col("k").cast("double") * F.col("k"))
                    / (total * total)).alias("q"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of `labels(node, community)` over weighted edges (a, b, w)."""
    return _quality(_both_ways(edges), labels, resolution).select(F.round("q", 6).alias("q"))


#: A move must gain more than this, in units of weight; far above the rounding of the sums it comes from.
LEAST_GAIN = 1e-6
#: Moves of several blocks at once must raise modularity by more than this, far above its rounding.
LEAST_RISE = 1e-12
#: Links that one block holds on average (some 50 bytes each in its task), and passes over the nodes of one of several blocks in a round.
BLOCK_LINKS = 5 << 20
PASSES = 10


def _sweep(rows: pa.Table, two_m: float, resolution: float, passes: int) -> pa.Table:
    """Moves of one block's nodes, one after the other, as long as one gains and for so many passes.

    A row that is `own` is a node with its community, its strength `w` and the community's volume `vol`; the
    others are its links, to a `peer` that may move here as well or summed by community of the other end.
    A pass asks the peers of those that moved in the last one; all nodes are asked first and last.
    """
    own, links = rows.filter(rows["own"]).sort_by("node"), rows.filter(pc.invert(rows["own"]))
    ids, k = pd.Index(own["node"].to_numpy()), own["w"].to_numpy()
    node = ids.get_indexer(links["node"].to_numpy())
    order = np.argsort(node, kind="stable")
    starts = np.searchsorted(node[order], np.arange(len(own) + 1)).tolist()
    peer = np.full(len(links), -1, dtype=np.int64)
    peer[links["peer"].is_valid().to_numpy()] = ids.get_indexer(links["peer"].drop_null().to_numpy())
    outside = peer < 0
    away = links.select(["community", "vol"]).filter(pa.array(outside))
    at, names = pd.factorize(np.concatenate([own["community"].to_numpy(), away["community"].to_numpy()]), sort=True)
    vol = np.zeros(len(names))
    vol[at] = np.concatenate([own["vol"].to_numpy(), away["vol"].to_numpy()])
    held, fixed = at[:len(own)].copy(), np.full(len(links), -1, dtype=np.int64)
    fixed[outside] = at[len(own):]
    w, peer, fixed, mixed = links["w"].to_numpy()[order], peer[order], fixed[order], bool(outside.any())
    del links, away, node, order, outside
    start, weight, total = held.copy(), np.zeros(len(names)), 0.0
    asked, whole = range(len(own)), True
    for _ in range(passes):
        moved = []
        for i in asked:
            some = slice(starts[i], starts[i + 1])
            if some.start == some.stop:
                continue
            near = held[peer[some]]
            if mixed:
                near = np.where(peer[some] >= 0, near, fixed[some])
            np.add.at(weight, near, w[some])
            c = held[i]
            vol[c] -= k[i]
            gain = weight[near] - resolution * k[i] / two_m * vol[near]
            best = gain.max()
            more = best - (weight[c] - resolution * k[i] / two_m * vol[c])
            if more > LEAST_GAIN:
                c, total = near[gain == best].min(), total + more
                held[i] = c
                moved.append(i)
            vol[c] += k[i]
            weight[near] = 0.0
        if moved:
            touched = np.unique(np.concatenate([peer[starts[i]:starts[i + 1]] for i in moved]))
            asked, whole = touched[touched >= 0].tolist(), False
        elif whole:
            break
        else:
            asked, whole = range(len(own)), True
    changed = np.flatnonzero(held != start)
    kind = rows.schema.field("node").type
    return pa.table({"block": pa.array(np.full(len(changed), rows["block"][0].as_py(), dtype=np.int32)),
                     "node": own["node"].take(pa.array(changed)), "to": pa.array(names[held[changed]], type=kind),
                     "gain": pa.array(np.full(len(changed), total))})


def _block_moves(graph: DataFrame, strength: DataFrame, labels: DataFrame, two_m: int, resolution: float, blocks: int, turn: int,
                 near: DataFrame | None = None) -> DataFrame:
    """(block, node, to, gain): what every block of nodes would do if all others stayed, and gain by it in all.

    Blocks are dealt anew every turn, of the nodes in `near` if that is given.  There is no row only if no single
    move of these raises modularity.
    """
    def block(c: str):
        return F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(blocks)).cast("int")

    kind, alone = labels.schema["node"].dataType.simpleString(), blocks == 1 and near is None
    held = labels.join(strength, "node")
    volume = held.groupBy("community").agg(F.sum("k").cast("double").alias("vol"))
    if near is not None:
        held = held.join(near, "node", "left_semi")
        graph = _links_of(graph, near)
    nodes = held.join(volume, "community").select(
        block("node").alias("block"), F.lit(True).alias("own"), "node", F.lit(None).cast(kind).alias("peer"), "community",
        F.col("k").cast("double").alias("w"), "vol")
    ends = graph.where("src <> dst")
    if alone:   # every other end is a peer, whose row tells its community
        links = ends.select(block("src").alias("block"), F.lit(False).alias("own"), F.col("src").alias("node"), F.col("dst").alias("peer"),
                            F.lit(None).cast(kind).alias("community"), F.col("w").cast("double").alias("w"), F.lit(None).cast("double").alias("vol"))
    else:
        ends = ends.join(labels.select(F.col("node").alias("dst"), "community"), "dst")
        links = ends.select(block("src").alias("block"), F.col("src").alias("node"), F.when(block("src") == block("dst"), F.col("dst")).alias("peer"),
                            "community", "w").groupBy("block", "node", "peer", "community").agg(F.sum("w").cast("double").alias("w"))
        links = links.join(volume, "community").select("block", F.lit(False).alias("own"), "node", "peer", "community", "w", "vol")
    passes = MAX_ROUNDS if alone else PASSES
    return nodes.union(links).groupBy("block").applyInArrow(
        lambda rows: _sweep(rows, float(two_m), resolution, passes), f"block int, node {kind}, to {kind}, gain double")


def _links_of(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


def _touched(graph: DataFrame, moves: DataFrame) -> DataFrame:
    """The nodes of `moves` and their neighbours."""
    nodes = moves.select("node").distinct()
    return nodes.union(graph.join(nodes.withColumnRenamed("node", "dst"), "dst").select("src")).distinct()


def _local_moves(graph: DataFrame, labels: DataFrame, two_m: int, resolution: float) -> tuple[DataFrame, bool]:
    """Labels that no single move improves, and whether anything moved.

    All blocks move at once if modularity rises by it, else the half of them that gain most, and so on; one
    block alone always raises it, and is not measured where it is the only one.  Nodes of different blocks get in each other's way, so once the nodes near a
    turn's moves fit into fewer blocks, the next turn is theirs alone.  Only a turn of all nodes ends it.
    """
    strength = written(graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "louvain-strength")
    blocks = -(-graph.count() // BLOCK_LINKS)
    quality = _quality(graph, labels, resolution).first()[0] if blocks > 1 else 0.0
    first, near, parts = labels, None, blocks
    for turn in range(MAX_ROUNDS):
        moves = written(_block_moves(graph, strength, labels, two_m, resolution, parts, turn, near), "louvain-moves")
        ranked = [r.block for r in moves.groupBy("block").agg(F.max("gain").alias("gain")).orderBy(F.desc("gain"), "block").collect()]
        if not ranked and near is None:
            return labels, turn > 0
        if not ranked:
            discard(moves, near)
            near, parts = None, blocks
            continue
        while True:
            made = moves.where(F.col("block").isin(ranked)).select("node", "to")
            tried = written(labels.join(made, "node", "left").select("node", F.coalesce("to", "community").alias("community")), "louvain-labels")
            rise = _quality(graph, tried, resolution).first()[0] - quality if blocks > 1 else 0.0
            if rise > LEAST_RISE or len(ranked) == 1:
                break
            discard(tried)
            ranked = ranked[:len(ranked) // 2]
        discard(near)
        near, parts = None, blocks
        if blocks > 1:
            near = written(_touched(graph, moves), "louvain-near")
            parts = -(-_links_of(graph, near).count() // BLOCK_LINKS)
            if parts >= blocks:
                discard(near)
                near, parts = None, blocks
        discard(moves, labels if labels is not first else None)
        labels, quality = tried, quality + rise
    raise RuntimeError(f"local moves not settled after {MAX_ROUNDS} rounds")


def _connected(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels in which every community is connected: parts without a link between them get names of their own.

    Each node takes the smallest name among itself and its neighbours in the community, and then the name
    that this one has taken, until no name changes.
    """
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    z = labels.select(F.col("node").alias("dst"), F.col("community").alias("cz"))
    inside = written(graph.where("src <> dst").join(a, "src").join(z, "dst").where("ca = cz").select("src", "dst"), "louvain-inside")
    names = written(labels.select("node", F.col("node").alias("name")), "louvain-names")
    for _ in range(MAX_ROUNDS):
        near = inside.join(names.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("name").alias("other"))
        least = names.join(near, "node", "left").select("node", "name", F.least("name", "other").alias("low"))
        jump = names.select(F.col("node").alias("low"), F.col("name").alias("further"))
        step = written(least.join(jump, "low", "left").select("node", "name", F.least("low", "further").alias("new")), "louvain-names")
        if not step.where("name <> new").head(1):
            return names.withColumnRenamed("name", "community")
        names = step.select("node", F.col("new").alias("name"))
    raise RuntimeError(f"connected parts not settled after {MAX_ROUNDS} rounds")


#: Safety limit: passing it is an error and never an unfinished result.
MAX_ROUNDS = 2000


def louvain(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Communities of weighted undirected edges (a, b, w): node, community (its smallest member).

    Rounds of local moves, then contraction, as long as something moves; on the way up every community is
    kept connected.  At the top, single nodes move again on the whole graph, and if any does it all goes on
    from there.  So in the result no single move raises modularity and every community is connected.  Every
    round raises modularity, so it ends.  Each round writes its labels to the shared scratch folder; the
    driver only sees whether there are moves.  Nodes are numbered in the order of their names, and the numbers
    are sent and compared in place of these.
    """
    linked = written(edges.where("a <> b").select("a", "b", "w"), "louvain-edges")
    nodes = linked.select(F.col("a").alias("name")).union(linked.select("b")).distinct()
    numbers = written(nodes.orderBy("name").select("name", F.monotonically_increasing_id().alias("no")), "louvain-numbers")
    for c in ("a", "b"):
        linked = linked.join(numbers, F.col(c) == F.col("name")).drop(c, "name").withColumnRenamed("no", c)
    found = _settled(written(_both_ways(linked), "louvain-graph"), resolution)
    least = found.groupBy("community").agg(F.min("node").alias("least"))
    return (found.join(least, "community").join(numbers.select(F.col("no").alias("node"), "name"), "node")
            .join(numbers.select(F.col("no").alias("least"), F.col("name").alias("of")), "least")
            .select(F.col("name").alias("node"), F.col("of").alias("community")))


def _settled(base: DataFrame, resolution: float) -> DataFrame:
    """(node, community) of a graph (src, dst, w) in both directions, as `louvain` describes it; any names."""
    two_m = base.agg(F.sum("w")).first()[0]
    labels = written(base.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("community")), "louvain-map")
    if not two_m:
        return labels
    for _ in range(MAX_ROUNDS):
        labels, moved = _local_moves(base, labels, two_m, resolution)
        if not moved:
            break
        labels = _connected(base, labels)
        graph, mapping = _contracted(base, labels), labels
        while True:
            tops = written(graph.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("community")), "louvain-tops")
            tops, merged = _local_moves(graph, tops, two_m, resolution)
            if not merged:
                break
            step = tops.select(F.col("node").alias("community"), F.col("community").alias("next"))
            mapping = written(mapping.join(step, "community").select("node", F.col("next").alias("community")), "louvain-map")
            graph = _contracted(graph, tops)
        labels = mapping
    else:
        raise RuntimeError(f"communities not settled after {MAX_ROUNDS} levels")
    return labels


def _contracted(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of communities, links inside one as a link to itself."""
    return written(graph.join(labels.select(F.col("node").alias("src"), F.col("community").alias("ca")), "src")
                   .join(labels.select(F.col("node").alias("dst"), F.col("community").alias("cz")), "dst")
                   .groupBy(F.col("ca").alias("src"), F.col("cz").alias("dst")).agg(F.sum("w").alias("w")), "louvain-graph")
