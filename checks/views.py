"""The test tables seen as an event log, labels, baskets and item vectors (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketweave.functions.events import type_name

# Start of the recent window and of the label window, epoch seconds; the time-weighted matrix runs from T0 to T2.
T0, T1, T2 = 1_704_067_200, 1_706_054_400, 1_706_400_000
VECTOR_DIMS = 64  # of the embeddings
# The catalogue of the event log has 100 items, so the limits are smaller than the defaults.
K_EDGES, N_CANDIDATES, N_ADDITIONAL, K_RECALL = 10, 20, 24, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(column: str) -> F.Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def fx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .where(kind != "error")
        .select(
            F.col("user_id").alias("session"),
            F.get_json_object("props", "$.k").cast("int").alias("aid"),
            _epoch("ts").alias("ts"),
            F.when(kind == "signup", 1).when(kind == "purchase", 2).otherwise(0).alias("type"),
            "event_id",
        )
    )


def history(events):
    return events.where(F.col("ts") < T1)


def observed(events):
    return events.where((F.col("ts") >= T1) & (F.col("ts") < T2))


def known(events):
    return events.where(F.col("ts") < T2)


def labels(events):
    """Next clicked item, and the distinct carted and ordered items, of sessions seen in the recent window."""
    seen = observed(events).select("session").distinct()
    later = events.where(F.col("ts") >= T2).join(seen, "session", "left_semi")
    first = Window.partitionBy("session").orderBy("ts", "event_id")
    clicks = (
        later.where(F.col("type") == 0)
        .withColumn("n", F.row_number().over(first))
        .where("n = 1")
        .select("session", F.lit("clicks").alias("type"), F.array("aid").alias("ground_truth"))
    )
    buys = (
        later.where(F.col("type") > 0)
        .groupBy("session", "type")
        .agg(F.array_sort(F.collect_set("aid")).alias("ground_truth"))
        .select("session", type_name("type").alias("type"), "ground_truth")
    )
    return clicks.unionByName(buys)


def fx_history(spark, sf_dir):
    return history(fx_events(spark, sf_dir))


def fx_observed(spark, sf_dir):
    return observed(fx_events(spark, sf_dir))


def fx_known(spark, sf_dir):
    return known(fx_events(spark, sf_dir))


def fx_labels(spark, sf_dir):
    return labels(fx_events(spark, sf_dir))


def fx_baskets(spark, sf_dir):
    """Order lines as events of customers: a wide catalogue. The tie-break is the tuple of line columns."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    flag = F.col("l_returnflag")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("session"),
        F.col("l_partkey").alias("aid"),
        _epoch("o_orderdate").alias("ts"),
        F.when(flag == "A", 1).when(flag == "R", 2).otherwise(0).alias("type"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
        ).alias("event_id"),
    )


def fx_item_vectors(spark, sf_dir):
    """The given embeddings, standing in for trained and reduced vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("aid"), *[F.col("embedding")[i].cast("double").alias(f"svd_{i}") for i in range(VECTOR_DIMS)]
    )
