"""File sources and sinks: trade panel, curve CSV, register XML, obligations, case events, layers."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bounded_rows, ts
from ..model import PARAM_NAMES, Rule

# Curve column names with their tenor in years, and the six date-time properties.
CURVE_COLUMNS = {"DGS1MO": 1 / 12, "DGS3MO": 0.25, "DGS6MO": 0.5, "DGS1": 1.0, "DGS2": 2.0, "DGS3": 3.0, "DGS5": 5.0,
                 "DGS7": 7.0, "DGS10": 10.0, "DGS20": 20.0, "DGS30": 30.0}
TIME_PROPERTIES = ("at", "sourceAt", "effectiveAt", "openedAt", "validFrom", "validTo")

CASE_SCHEMA = ("seq int, date date, date_precision string, event_label string, event_id string, description string, "
               "actor_role string, amount_usd_m double, graph_pattern string, rules_broken string, source string, "
               "confidence string")
OBLIGATION_SCHEMA = ("id string, name string, trigger_event string, trigger_condition string, required_control string, "
                     "required_by_role string, timing string, sla_days int, params_json string, "
                     "applies_to_attribute string, severity string, gap_definition string, "
                     "default_broken_by_TP boolean, default_broken_by_FP boolean")


def scan_trade_panel(panel: DataFrame, day: str, d0: str, d1: str, columns: list[str]) -> DataFrame:
    """Column and date-range scan; both reach the Parquet reader."""
    return panel.where(F.col(day).between(ts(d0), ts(d1))).select(*columns)


def read_curve(spark: SparkSession, path: str, d0: str, d1: str) -> DataFrame:
    """Wide curve CSV to (day, tenor_no, tenor_years, yield); blanks stay null."""
    names = list(CURVE_COLUMNS)
    schema = "observation_date date, " + ", ".join(f"{n} double" for n in names)
    wide = spark.read.schema(schema).option("header", True).csv(path).where(
        F.col("observation_date").between(F.lit(d0).cast("date"), F.lit(d1).cast("date")))
    points = F.array(*[F.struct(F.lit(i).alias("tenor_no"), F.lit(CURVE_COLUMNS[n]).alias("tenor_years"),
                                F.col(n).alias("yield")) for i, n in enumerate(names)])
    return wide.select(F.col("observation_date").alias("day"), F.inline(points))


def liquidity_flags(spark: SparkSession, path: str, row_tag: str = "RefData") -> DataFrame:
    """Register records to (cusip, liquid): bonds with a US identifier, the latest file winning.

    Files of one snapshot carry its date in their name or in that of their folder; unzip first, archives do not split.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(
        "Id string, FinInstrmClssfctn string, Lqdty boolean").load(path)
    kept = rows.select("*", F.col("_metadata.file_path").alias("snapshot")).where(
        "FinInstrmClssfctn = 'BOND' and Id like 'US%'")
    return kept.groupBy(F.substring("Id", 3, 9).alias("cusip")).agg(F.max_by("Lqdty", "snapshot").alias("liquid"))


def load_obligations(spark: SparkSession, path: str) -> DataFrame:
    """Obligation CSV with its JSON parameters as typed columns; R8 forbids the same desk by default."""
    types = {"thresholdBps": "double", "pctOfBidAsk": "double", "n": "int", "windowDays": "int",
             "divergenceBps": "double", "unexplainedThreshold": "double", "consecutiveDays": "int",
             "periodMonths": "int", "regimeSlaDays": "int", "sameDeskAllowed": "boolean", "slaDays": "int"}
    raw = spark.read.schema(OBLIGATION_SCHEMA).option("header", True).option("escape", '"').csv(path)
    p = F.from_json("params_json", ", ".join(f"{k} {v}" for k, v in types.items()))
    out = raw.withColumn("p", p).select(
        F.col("id").alias("rule_id"), "name", "timing", F.coalesce("p.slaDays", "sla_days").alias("sla_days"), "severity",
        "required_control", "required_by_role", "trigger_event", "gap_definition",
        F.nullif("applies_to_attribute", F.lit("")).alias("applies_to"),
        *[F.col(f"p.{public}").alias(field) for field, public in PARAM_NAMES.items()])
    return out.withColumn("same_desk_allowed", F.when(F.col("rule_id") == "R8", F.coalesce(
        "same_desk_allowed", F.lit(False))).otherwise(F.col("same_desk_allowed")))


def obligation_faults(spark: SparkSession, path: str) -> DataFrame:
    """Obligation rows kept apart because their parameters are no JSON object: rule_id, params_json."""
    raw = spark.read.schema(OBLIGATION_SCHEMA).option("header", True).option("escape", '"').csv(path)
    parsed = F.from_json("params_json", "map<string,string>")
    return raw.where(F.coalesce(F.col("params_json"), F.lit("")) != "").where(parsed.isNull()).select(F.col("id").alias("rule_id"), "params_json")


def rules_from(obligations: DataFrame) -> tuple[Rule, ...]:
    """Obligation rows as rule values; an obligation table is a short control table."""
    return tuple(sorted((Rule(**r.asDict()) for r in bounded_rows(obligations, 1000, "obligations")),
                        key=lambda r: (len(r.rule_id), r.rule_id)))


def load_case_events(spark: SparkSession, path: str) -> DataFrame:
    """Case rows; a description may run over several lines."""
    return spark.read.schema(CASE_SCHEMA).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


#: Properties of a stored node beside its id and label.
NODE_PROPERTIES = {"caption": "string", "at": "timestamp_ntz", "sourceAt": "timestamp_ntz", "effectiveAt": "timestamp_ntz",
                   "openedAt": "timestamp_ntz", "validTo": "timestamp_ntz", "deviationBps": "bigint", "divergenceBps": "bigint", "outcome": "string"}


def write_layer(nodes: DataFrame, edges: DataFrame, folder: str) -> str:
    """Store a new version of a layer, and its name, which readers find from then on.

    Nodes (id, label and any of NODE_PROPERTIES) are JSON lines by label, edges Parquet by type and endpoint
    labels.  Versions are never overwritten, so what an earlier reader still reads stays.  The pointer is a
    one-row file that is added last; a version without one does not exist for readers.
    """
    version = f"v-{uuid.uuid4().hex}"
    have = [c for c in NODE_PROPERTIES if c in nodes.columns]
    nodes.select("id", "label", *have).write.mode("errorifexists").partitionBy("label").json(f"{folder}/{version}/nodes")
    edges.write.mode("errorifexists").partitionBy("rel_type", "from_label", "to_label").parquet(f"{folder}/{version}/edges")
    spark = nodes.sparkSession
    spark.createDataFrame([(version, time.time_ns())], "version string, written bigint").coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return version


def current_version(spark: SparkSession, folder: str) -> str:
    """The version whose pointer was written last."""
    return spark.read.schema("version string, written bigint").parquet(f"{folder}/pointer").agg(
        F.max_by("version", F.struct("written", "version"))).first()[0]


def read_layer(spark: SparkSession, folder: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with typed properties, and edges, of a version (the current one if none is named)."""
    at = f"{folder}/{version or current_version(spark, folder)}"
    nodes = load_json_nodes(spark, f"{at}/nodes", {"id": "string", **NODE_PROPERTIES, "label": "string"})
    return nodes, (spark.read.schema("src string, dst string, rel_type string, from_label string, to_label string")
                   .parquet(f"{at}/edges"))


def load_json_nodes(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """JSON-lines nodes of one label; the date-time properties become timestamps."""
    schema = ", ".join(f"`{k}` {'string' if k in TIME_PROPERTIES else t}" for k, t in properties.items())
    rows = spark.read.schema(schema).json(path)
    return reduce(lambda df, c: df.withColumn(c, F.to_timestamp_ntz(c)),
                  [c for c in properties if c in TIME_PROPERTIES], rows)
