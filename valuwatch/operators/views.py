"""Ad-hoc SQL over the book, and loading layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Book
from ..session import scratch_dir
from ..sources.files import read_layer, write_layer
from . import graph

VIEWS = ("desk", "person", "instrument", "position", "event", "response", "attribute", "trade", "curve", "incident", "mark")


def register_views(b: Book) -> None:
    for name in VIEWS:
        getattr(b, name).createOrReplaceTempView(name)


def sql_views(b: Book, statement: str, **params) -> DataFrame:
    """A read query with named parameters (`:name`) over the book's views."""
    register_views(b)
    return b.spark.sql(statement, args=params)


def layer_nodes(b: Book) -> DataFrame:
    """Nodes with the properties that are stored: captions for all, times and measures of events and positions."""
    c = F.col
    events = b.event.select(
        c("event_id").alias("id"), "label", c("event_id").alias("caption"), c("event_at").alias("at"), c("source_at").alias("sourceAt"),
        c("effective_at").alias("effectiveAt"), c("deviation_bps").alias("deviationBps"), c("divergence_bps").alias("divergenceBps"), "outcome")
    positions = b.position.select(c("position_id").alias("id"), F.lit("Position").alias("label"), F.coalesce("name", "position_id").alias("caption"),
                                  c("opened_at").cast("timestamp_ntz").alias("openedAt"), c("valid_to").cast("timestamp_ntz").alias("validTo"))
    # events and positions stand above, with more than a caption
    rest = graph.nodes(b.with_(event=b.event.limit(0), position=b.position.limit(0)))
    methods = b.position.select(c("methodology_id").alias("id")).distinct().select("id", F.lit("ValuationMethodology").alias("label"), c("id").alias("caption"))
    return events.unionByName(positions, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True).unionByName(
        methods, allowMissingColumns=True)


def store_layer(b: Book, folder: str) -> str:
    return write_layer(layer_nodes(b), graph.edges(b), folder)


def reset_and_load(spark: SparkSession, folder: str) -> DataFrame:
    """Load a stored layer and report its nodes per label."""
    nodes, _ = read_layer(spark, folder)
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def layer_folder(b: Book) -> str:
    return f"{scratch_dir(b.spark)}/layer"
