"""The journal graph seen in the star schema: orders are entries, parts are entities, line items are mentions.

A journal is an order priority; a part belongs to every journal. ``VIEWS`` gives the same projection to the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table

SELF = "red plate"
GROUP = "1-URGENT"

VIEWS = """
WITH ep AS (SELECT o_orderpriority AS group_id, o_orderkey AS uuid, o_orderdate AS valid_at, 'Order ' || o_orderkey AS name,
  'Order ' || o_orderkey || ' for customer ' || o_custkey || '. Status ' || o_orderstatus || ' now' AS content FROM orders),
grp AS (SELECT DISTINCT o_orderpriority AS group_id FROM orders),
en AS (SELECT group_id, p_partkey AS uuid, p_name AS name, p_type AS type FROM part, grp),
m AS (SELECT o_orderpriority AS group_id, l_orderkey * 10 + l_linenumber AS uuid, l_orderkey AS episode_uuid, l_partkey AS entity_uuid, l_linenumber AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pairs AS (SELECT DISTINCT group_id, episode_uuid, entity_uuid FROM m),
nodes AS (SELECT m.group_id, episode_uuid, min(m.pos) AS pos, m.entity_uuid AS uuid, name, type FROM m JOIN en ON m.group_id = en.group_id AND m.entity_uuid = en.uuid GROUP BY ALL)
"""


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    text = F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" for customer "), F.col("o_custkey"), F.lit(". Status "), F.col("o_orderstatus"), F.lit(" now"))
    return o.select(F.col("o_orderpriority").alias("group_id"), F.col("o_orderkey").alias("uuid"), F.col("o_orderdate").cast("timestamp").alias("valid_at"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("name"), text.alias("content"))


def groups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderpriority").alias("group_id")).distinct()


def entities(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return p.crossJoin(groups(spark, folder)).select("group_id", "uuid", "name", "type")  # five journals


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return joined.select(F.col("o_orderpriority").alias("group_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uuid"), F.col("l_orderkey").alias("episode_uuid"), F.col("l_partkey").alias("entity_uuid"), F.col("l_linenumber").alias("pos"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    first = mentions(spark, folder).groupBy("group_id", "episode_uuid", F.col("entity_uuid").alias("uuid")).agg(F.min("pos").alias("pos"))
    return first.join(entities(spark, folder), ["group_id", "uuid"]).select("group_id", "episode_uuid", "pos", "uuid", "name", "type")
