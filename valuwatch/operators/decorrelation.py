"""Peer decorrelation of marks, one DAG from marks to signals.

A position has one mark per date, so windows over a position are bounded by the calendar; peer
groups, which are not, are aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Book

WINDOW, THRESHOLD, PERIODS = 8, 0.45, 2
MIN_PEERS = 3
CLUSTER_MIN = 0.5
GROUP_TYPES = ("liquidityTier", "methodologyFamily")


def mark_returns(marks: DataFrame) -> DataFrame:
    """Log return between consecutive own dates, both marks positive, keyed by the later date."""
    w = Window.partitionBy("position_id").orderBy("day")
    rows = marks.withColumn("prev", F.lag("clean").over(w)).where("prev > 0 and clean > 0")
    return rows.select("position_id", "day", F.ln(F.col("clean") / F.col("prev")).alias("ret"))


def peer_groups(bridge: DataFrame) -> DataFrame:
    """Peer group key: values of the two group attributes in type order, each behind a pipe."""
    values = F.array_sort(F.collect_set(F.struct("ra_type", "ra_value")))
    return bridge.where(F.col("ra_type").isin(*GROUP_TYPES)).groupBy(F.col("entity_id").alias("position_id")).agg(
        F.array_join(F.transform(values, lambda x: F.concat(F.lit("|"), x.ra_value)), "").alias("grp"))


def peer_mean(returns: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean return of the other members of the group on the date; null with fewer than three others."""
    rows = returns.join(groups, "position_id")
    # whole 1e-12 steps add up the same in any order
    sums = rows.groupBy("grp", "day").agg(F.sum(F.col("ret").cast("decimal(20,12)")).alias("s"), F.count(F.lit(1)).alias("n"))
    peers = F.col("n") - 1
    mean = (F.col("s").cast("double") - F.col("ret")) / peers
    return rows.join(sums, ["grp", "day"]).select("position_id", "grp", "day", "ret", peers.alias("peers"),
                                                  F.when(peers >= MIN_PEERS, mean).alias("peer_ret"))


def rolling_pearson(paired: DataFrame, window: int = WINDOW) -> DataFrame:
    """Correlation with the peers over the last `window` own dates; without variance it is 0.

    Only full windows appear; one is evaluable if every date in it has peers.
    """
    w = Window.partitionBy("position_id").orderBy("day").rowsBetween(-(window - 1), 0)
    rows = paired.select("position_id", "grp", "day", F.count(F.lit(1)).over(w).alias("n"),
                         F.count("peer_ret").over(w).alias("with_peers"), F.covar_pop("ret", "peer_ret").over(w).alias("sxy"),
                         F.var_pop("ret").over(w).alias("sxx"), F.var_pop("peer_ret").over(w).alias("syy"))
    whole = F.col("with_peers") == window
    corr = F.when((F.col("sxx") <= 0) | (F.col("syy") <= 0), 0.0).otherwise(
        F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))))
    return rows.where(F.col("n") == window).select(
        "position_id", "grp", "day", whole.alias("evaluable"), F.when(whole, F.round(corr, 9)).alias("corr"))


def decorr_signals(rolling: DataFrame, threshold: float = THRESHOLD, periods: int = PERIODS) -> DataFrame:
    """First run of at least `periods` consecutive breaches per position, dated at its first row.

    A row that is not evaluable ends a run.
    """
    w = Window.partitionBy("position_id").orderBy("day")
    breach = F.coalesce(F.col("corr") < threshold, F.lit(False))
    rows = rolling.withColumn("breach", breach).withColumn(
        "island", F.sum(F.when(F.col("breach"), 0).otherwise(1)).over(w))
    runs = rows.where("breach").groupBy("position_id", "grp", "island").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("day", "corr")).alias("first")).where(F.col("n") >= periods)
    return runs.groupBy("position_id", "grp").agg(F.min("first").alias("first")).select(
        "position_id", F.col("first.day").alias("day"), F.bround("first.corr", 4).alias("correlation"),
        F.col("grp").alias("peer_group"))


def signal_events(signals: DataFrame) -> DataFrame:
    """Signals as event rows at 17:00 of their date, one per position, replacing earlier ones."""
    return signals.select(F.concat(F.lit("DS-"), "position_id").alias("event_id"), F.lit("DecorrelationSignal").alias("label"),
                          "position_id", (F.col("day").cast("timestamp_ntz") + F.expr("interval 17 hours")).alias("event_at"))


def with_signals(b: Book, signals: DataFrame) -> Book:
    """The book with its decorrelation signals replaced."""
    kept = b.event.where("label <> 'DecorrelationSignal'")
    return b.with_(event=kept.unionByName(signal_events(signals), allowMissingColumns=True))


def signals_verdict(signals: DataFrame, r10: DataFrame) -> DataFrame:
    status = r10.select("position_id", "status").groupBy("position_id").agg(F.max("status").alias("status"))
    return signals.join(status, "position_id", "left").select("position_id", "day", "correlation", "peer_group", "status")


def return_vectors(marks: DataFrame, w: int = WINDOW) -> DataFrame:
    """(id, v): returns between the last w+1 dates of all marks, for positions that have all of them."""
    # one row per date reaches the ordering
    dates = marks.select("day").distinct().select("day", F.row_number().over(Window.orderBy(F.desc("day"))).alias("no")).where(
        F.col("no") <= w + 1)
    own = Window.partitionBy("position_id").orderBy("day")
    rows = marks.join(dates, "day").select("position_id", "day", "no", "clean", F.lag("clean").over(own).alias("prev"),
                                           F.lag("no").over(own).alias("prev_no"))
    moves = rows.where("prev_no = no + 1 and prev > 0 and clean > 0").select(
        "position_id", "day", F.ln(F.col("clean") / F.col("prev")).alias("ret"))
    packed = moves.groupBy("position_id").agg(F.array_sort(F.collect_list(F.struct("day", "ret"))).alias("r"))
    return packed.where(F.size("r") == w).select(F.col("position_id").alias("id"), F.transform("r", lambda x: x.ret).alias("v"))


def correlation_edges(pairs: DataFrame, minimum: float = CLUSTER_MIN) -> DataFrame:
    return pairs.where(F.col("similarity") >= minimum).select("a", "b", F.col("similarity").alias("w"))


def behaviour_clusters(labels: DataFrame) -> DataFrame:
    """Communities of at least two: position_id, cluster, size; the member list is the table itself."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    return labels.join(sizes, "community").select(F.col("node").alias("position_id"), F.col("community").alias("cluster"), "size")


def cluster_attributes(bridge: DataFrame, clusters: DataFrame) -> DataFrame:
    """The attribute bridge with the clusters as one more instrument-agnostic attribute."""
    return bridge.unionByName(clusters.select(F.col("position_id").alias("entity_id"), F.lit("behaviourCluster").alias("ra_type"),
                                              F.concat(F.lit("cluster-"), "cluster").alias("ra_value")))


def discovery_reset(b: Book) -> Book:
    """The book without anything the discovery tier derives: its rules, signals and attributes."""
    return b.with_(event=b.event.where("label <> 'DecorrelationSignal'"),
                   attribute=b.attribute.where("ra_type <> 'behaviourCluster'"),
                   rules=tuple(r for r in b.rules if r.provenance != "discovery"))
