"""Event trajectories in long form: (position, atom, grid point) cells instead of dense vectors.

With an identity basis the embedding is a grouped sum; a dense vector is built only where
neighbours are searched, and its length is the vocabulary times the grid.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import days, elapsed_days, ts
from ..model import Book

# Labels that bear a signal, rules of the retrieval check and how many make a book rich.
TRAJECTORY_LABELS = ("MethodologyChange", "PriceOverride", "Escalation", "PnLSignal", "Approval")
RETRIEVAL_RULES = ("R3", "R5", "R8")
RETRIEVAL_MIN = 2
HEAT_ROWS = 12
HEAT_FLOOR = 1e-9


@dataclass(frozen=True)
class Params:
    grid_points: int = 5
    theta: float = 365.0
    window: int = 1
    smoothing: float = 0.02
    decay: float = 0.005


def _recent(at: Column, as_of: str, theta: float) -> Column:
    clock = ts(as_of)
    return (at < clock) & (at >= clock - days(F.lit(int(theta))))


def trajectory_events(b: Book, gaps: DataFrame, p: Params = Params()) -> DataFrame:
    """Events and gaps of the window before the clock: position_id, event_id, elapsed, atoms."""
    clock = ts(b.as_of)
    roles = b.person.select("person_id", "role")
    desks = b.position.select("position_id", "desk_id")
    events = (b.chronology.where(F.col("label").isin(*TRAJECTORY_LABELS) & _recent(F.col("event_at"), b.as_of, p.theta))
              .join(roles, "person_id", "left").join(desks, "position_id")
              .select("position_id", "event_id", elapsed_days(F.col("event_at"), clock).cast("double").alias("elapsed"),
                      F.array_distinct(F.array_compact(F.array("label", "role", "desk_id"))).alias("atoms")))
    broken = gaps.where(_recent(F.col("due_by"), b.as_of, p.theta)).select(
        "position_id", F.col("gap_id").alias("event_id"),
        elapsed_days(F.col("due_by"), clock).cast("double").alias("elapsed"), F.array("rule_id").alias("atoms"))
    return events.unionByName(broken)


def trajectory_atoms(events: DataFrame) -> DataFrame:
    """Sorted vocabulary with its index.  Desks, labels, roles and rules: a bounded word list."""
    words = events.select(F.explode("atoms").alias("atom")).distinct()
    return words.select("atom", (F.row_number().over(Window.orderBy("atom")) - 1).alias("atom_no"))


def grid(theta: Column, p: Params) -> Column:
    """The grid points over [0, theta] as an array; a single point sits at 0."""
    if p.grid_points == 1:
        return F.array(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(p.grid_points - 1)), lambda i: i * (theta / (p.grid_points - 1)))


def fp_grid(spans: DataFrame, p: Params) -> DataFrame:
    """Grid of every span: columns of `spans` (with theta) plus gi, tau."""
    return spans.select("*", F.posexplode(grid(F.col("theta"), p)).alias("gi", "tau"))


def fp_smoothing(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Weights of the grid points around the one nearest to `elapsed` (the lower on ties), cut at
    the ends and normalised over what is left: columns of `events` plus gi, w."""
    taus = grid(F.lit(p.theta), p)
    nearest = F.array_min(F.transform(taus, lambda t, i: F.struct(F.abs(t - F.col("elapsed")).alias("d"), i.alias("i")))).i
    rows = events.withColumn("__taus", taus).withColumn("__n", nearest)
    span = F.sequence(F.greatest(F.col("__n") - p.window, F.lit(0)), F.least(F.col("__n") + p.window, F.lit(p.grid_points - 1)))
    raw = F.transform(span, lambda i: F.struct(i.alias("gi"), F.exp(
        -F.lit(p.smoothing) * F.abs(F.get("__taus", i) - F.col("elapsed"))).alias("w")))
    total = F.aggregate("__raw", F.lit(0.0), lambda s, x: s + x.w)
    cells = F.transform("__raw", lambda x: F.struct(x.gi.alias("gi"), (x.w / F.col("__z")).alias("w")))
    return rows.withColumn("__raw", raw).withColumn("__z", total).select(*events.columns, F.inline(cells))


def fp_event_embedding(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Per event one cell for every atom and weighted grid point: position_id, event_id, elapsed, atom, gi, v."""
    return fp_smoothing(events, p).select("position_id", "event_id", "elapsed", F.explode("atoms").alias("atom"), "gi",
                                          F.col("w").alias("v"))


def fp_embedding(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Decayed sum over the events strictly before the clock and within theta, non-zero cells only."""
    live = events.where((F.col("elapsed") > 0) & (F.col("elapsed") <= p.theta))
    decay = F.exp(-F.lit(p.decay) * F.col("elapsed"))
    return fp_event_embedding(live, p).groupBy("position_id", "atom", "gi").agg(
        F.sum(decay * F.col("v")).alias("v")).where("v <> 0")


def fp_identity_basis(atoms: DataFrame, p: Params = Params()) -> DataFrame:
    """Dimension k of every (atom, grid point)."""
    return atoms.select("atom", "atom_no", F.explode(F.sequence(F.lit(0), F.lit(p.grid_points - 1))).alias("gi")).select(
        "atom", "gi", (F.col("atom_no") * p.grid_points + F.col("gi")).alias("k"))


def fp_dimension_name(dims: DataFrame, atoms: DataFrame, p: Params = Params()) -> DataFrame:
    """Back from k to (atom, gi)."""
    return dims.withColumn("atom_no", F.floor(F.col("k") / p.grid_points)).withColumn("gi", F.col("k") % p.grid_points).join(
        atoms, "atom_no").select("k", "atom", "gi")


def fp_given_basis(embedding: DataFrame, basis: DataFrame) -> DataFrame:
    """Embedding in a caller's basis (atom, gi, k, v): position_id, k, v; cells without a vector add nothing."""
    return embedding.withColumnRenamed("v", "cell").join(basis, ["atom", "gi"]).groupBy("position_id", "k").agg(
        F.sum(F.col("cell") * F.col("v")).alias("v"))


def basis_faults(embedding: DataFrame, basis: DataFrame) -> DataFrame:
    """Why a basis must be refused: vectors of different length, atoms it does not cover."""
    sizes = basis.groupBy("atom", "gi").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo <> hi").select(
        F.lit("mixed dimensions").alias("fault"), F.concat_ws("..", "lo", "hi").alias("detail"))
    missing = embedding.select("atom", "gi").distinct().join(sizes, ["atom", "gi"], "left_anti").select(
        F.lit("no vector").alias("fault"), F.concat_ws("@", "atom", "gi").alias("detail"))
    return mixed.unionByName(missing)


def fp_random_basis(atoms: DataFrame, dimension: int, seed: int, p: Params = Params(), sparsity: float = 1 / 3) -> DataFrame:
    """Sparse +1/-1/0 vectors drawn from 52 bits of md5 over (seed, atom, grid point, dimension)."""
    cells = atoms.select("atom", F.explode(F.sequence(F.lit(0), F.lit(p.grid_points - 1))).alias("gi"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(dimension - 1))).alias("k"))
    text = F.concat_ws("|", F.lit(seed).cast("string"), "atom", F.col("gi").cast("string"), F.col("k").cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return cells.select("atom", "gi", "k", F.when(u < sparsity / 2, 1.0).when(u < sparsity, -1.0).otherwise(0.0).alias("v"))


def _filled(cells: DataFrame, size: Column) -> DataFrame:
    """(id, v): the cells (position_id, k, v) of a position as an array of that size, 0 where it has none."""
    packed = cells.groupBy("position_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return packed.withColumn("size", size).select(F.col("position_id").alias("id"), F.transform(
        F.sequence(F.lit(0), (F.col("size") - 1).cast("int")),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


def dense(embedding: DataFrame, atoms: DataFrame, p: Params = Params()) -> DataFrame:
    """(id, v): full vectors, their length bounded by the vocabulary."""
    size = atoms.agg(F.count(F.lit(1))).scalar() * p.grid_points
    cells = embedding.join(atoms, "atom").select("position_id", (F.col("atom_no") * p.grid_points + F.col("gi")).cast("int").alias("k"), "v")
    return _filled(cells, size)


def trajectory_write(embedding: DataFrame) -> DataFrame:
    """Positions with a vector, its non-zero dimensions and its length."""
    return embedding.groupBy("position_id").agg(F.count(F.lit(1)).alias("dimensions"),
                                                F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("norm"))


def _places(embedding: DataFrame) -> DataFrame:
    """Number k of every (atom, grid point) that occurs, in their order: a bounded word list."""
    return embedding.select("atom", "gi").distinct().withColumn("k", F.row_number().over(Window.orderBy("atom", "gi")) - 1)


def _both(pairs: DataFrame, embedding: DataFrame) -> DataFrame:
    """Pairs with the cells of both ends by place, 0 where an end lacks the cell, none where it lacks them all.

    A vector travels as one value, once to each pair of its position: as a row for each cell, a pair would be
    some hundred rows to shuffle and group.
    """
    places = _places(embedding)
    size = places.agg(F.count(F.lit(1))).scalar()
    vectors = _filled(embedding.join(places, ["atom", "gi"]).select("position_id", "k", "v"), size)
    return (pairs.join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b", "left")
            .join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a", "left")
            .where("va is not null or vb is not null")
            .withColumns({c: F.coalesce(c, F.array().cast("array<double>")) for c in ("va", "vb")}))


def _zipped(use: Callable[[Column, Column], Column]) -> Column:
    """`use` of the values of both ends at every place."""
    def value(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))   # the shorter array is filled up with nulls

    return F.zip_with("va", "vb", lambda x, y: use(value(x), value(y)))


def euclid_rerank(pairs: DataFrame, embedding: DataFrame) -> DataFrame:
    """Shortlist (a, b, similarity) with the Euclidean distance, the nearest first."""
    squares = _zipped(lambda x, y: (x - y) * (x - y))
    return _both(pairs, embedding).select("a", "b", F.round("similarity", 4).alias("cosine"), F.round(
        F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)), 4).alias("euclid"))


def top_dimensions(pairs: DataFrame, embedding: DataFrame, n: int = 3) -> DataFrame:
    """The n cells that add most to the similarity of each pair."""
    parts = F.transform(_zipped(lambda x, y: F.struct(F.round(x * y, 9).alias("c"), y.alias("y"))),
                        lambda x, k: F.struct((-x.c).alias("c"), k.alias("k"), x.y.alias("y")))
    best = F.slice(F.array_sort(F.filter(parts, lambda x: x.c < 0)), 1, n)
    return (_both(pairs.select("a", "b").distinct(), embedding).select("a", "b", F.posexplode(best).alias("no", "x"))
            .select("a", "b", (F.col("no") + 1).alias("rank"), F.col("x.k").alias("k"), F.round("x.y", 6).alias("weight"))
            .join(_places(embedding), "k").select("a", "b", "rank", "atom", "gi", "weight"))


def fingerprint_heat(embedding: DataFrame) -> DataFrame:
    """Cells of the atoms a position touches most, densest first, at most a dozen atoms."""
    peak = embedding.groupBy("position_id", "atom").agg(F.round(F.max("v"), 9).alias("peak")).where(F.col("peak") > HEAT_FLOOR)
    rank = F.row_number().over(Window.partitionBy("position_id").orderBy(F.desc("peak"), "atom"))
    shown = peak.withColumn("rank", rank).where(F.col("rank") <= HEAT_ROWS)
    return embedding.join(shown, ["position_id", "atom"]).select("position_id", "rank", "atom", "gi", F.round("v", 6).alias("cell"))


def gap_rich(gaps: DataFrame, as_of: str, p: Params = Params()) -> DataFrame:
    return gaps.where(F.col("rule_id").isin(*RETRIEVAL_RULES) & _recent(F.col("due_by"), as_of, p.theta)).groupBy(
        "position_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RETRIEVAL_MIN).select("position_id")


def retrieval_eval(pairs: DataFrame, rich: DataFrame, embedding: DataFrame, holdout: DataFrame) -> DataFrame:
    """Per reference: how many neighbours are gap-rich against the population's share."""
    population = embedding.agg(F.count_distinct("position_id")).scalar()
    share = rich.agg(F.count(F.lit(1))).scalar() / population
    rows = (pairs.join(rich.select(F.col("position_id").alias("b"), F.lit(1).alias("rich")), "b", "left")
            .join(holdout.select(F.col("position_id").alias("b"), F.lit(1).alias("held")).distinct(), "b", "left"))
    return rows.groupBy("a").agg(F.count("rich").alias("enriched"), F.count(F.lit(1)).alias("neighbors"),
                                 F.count("held").alias("holdout_hits")).withColumn("pop_share", share).select(
        F.col("a").alias("reference"), "enriched", "neighbors", F.round("pop_share", 6).alias("pop_share"),
        (F.col("enriched") / F.col("neighbors") > F.col("pop_share") * 1.5).alias("verdict"), "holdout_hits")


def watchlist(shortlist: DataFrame, as_of: str, previous: DataFrame | None = None) -> DataFrame:
    """One entry per watched position, from the reference nearest to it; entries of earlier runs
    stay unless their position is watched again."""
    best = shortlist.groupBy("b").agg(F.min(F.struct("euclid", "a")).alias("x"))
    rows = best.select(F.col("b").alias("position_id"),
                       F.concat(F.lit("trajectory similar to "), F.col("x.a"), F.lit(f" as of {as_of[:10]}")).alias("reason"),
                       F.lit("Trajectories").alias("panel"), F.col("x.a").alias("reference"), F.lit(as_of[:10]).alias("as_of"))
    return rows if previous is None else rows.unionByName(previous.join(rows, "position_id", "left_anti"))
