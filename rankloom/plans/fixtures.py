"""Nested ranking input and scored rows derived from the driver's tables.

A row is a user; requests are the user's signups, candidates the user's orders for each request,
histories the user's other events, newest first, with the requests that come after them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.spec import Layout, Sequence

HISTORIES = ("click", "view", "purchase")
LAYOUT = Layout(
    request_meta=("impr_time", "search_id", "scene_id"),
    candidate_scalars=("item_id",),
    candidate_bags=("item_parts",),
    labels=("label",),
    sequences=tuple(Sequence(k, {"id": f"{k}_id", "time": f"{k}_time"}, "time", f"{k}_members") for k in HISTORIES),
    request_time="impr_time",
)
KEYS = ("user_id",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", ms.alias("t"), "value")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events(spark, sf_dir).where("event_type = 'signup'")
    return rows.select("user_id", order.cast("long").alias("request_id"), F.col("t").alias("impr_time"), F.col("event_id").cast("string").alias("search_id"), (F.col("event_id") % 7).alias("scene_id"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    label = (F.col("o_orderstatus") == "F").cast("long")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("item_id"), label.alias("label"))
    return rows.join(parts, F.col("item_id") == F.col("l_orderkey"), "left").select("user_id", "item_id", "label", F.coalesce(F.col("p.l_partkey"), F.array().cast("array<long>")).alias("parts"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agg rows: one per user with signups and orders."""
    req = requests(spark, sf_dir)
    by_user = req.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("request_id", "impr_time", "search_id", "scene_id"))).alias("r"))
    items = orders(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "label", "parts"))).alias("o"))
    rows = by_user.join(items, "user_id")
    repeated = F.flatten(F.transform("r", lambda r: F.transform("o", lambda o: F.struct(r["request_id"].alias("request_id"), o.alias("o")))))
    rows = rows.withColumn("c", repeated)
    past = events(spark, sf_dir).where(F.col("event_type").isin(*HISTORIES)).select("user_id", "event_type", F.struct((-F.col("t")).alias("age"), "event_id", "t").alias("e"))
    past = past.groupBy("user_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("event_type") == k, F.col("e")))).alias(k) for k in HISTORIES))
    rows = rows.join(past, "user_id", "left")
    out = [
        "user_id",
        F.col("r.request_id").alias("context_indices"),
        F.col("r.impr_time").alias("impr_time"),
        F.col("r.search_id").alias("search_id"),
        F.col("r.scene_id").alias("scene_id"),
        F.col("c.request_id").alias("target_indices"),
        F.transform("c", lambda c: F.array(c["o"]["item_id"])).alias("item_id"),
        F.transform("c", lambda c: c["o"]["parts"]).alias("item_parts"),
        F.transform("c", lambda c: F.array(c["o"]["label"])).alias("label"),
    ]
    for k in HISTORIES:
        with_members = F.transform(k, lambda e: F.struct(e["event_id"].alias("id"), e["t"].alias("time"), F.transform(F.filter("r", lambda r: r["impr_time"] >= e["t"]), lambda r: r["request_id"]).alias("members")))
        rows = rows.withColumn(f"s_{k}", F.filter(with_members, lambda e: F.size(e["members"]) > 0))
        out += [F.col(f"s_{k}.id").alias(f"{k}_id"), F.col(f"s_{k}.time").alias(f"{k}_time"), F.col(f"s_{k}.members").alias(f"{k}_members")]
    return rows.select(*out)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows from lineitem: task logit and label, group and scenario."""
    logit = (F.col("l_quantity") - 25) / 10 - (F.col("l_discount") - 0.05) * 20
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("line"), logit.alias("logit"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_linestatus").alias("scenario"), F.col("l_suppkey").alias("user_id"))
    return rows.withColumn("logit", F.round("logit", 6))
