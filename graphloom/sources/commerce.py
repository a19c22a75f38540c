"""The commerce and conversation tables as one graph."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.sources.mapping import EdgeType, Graph, NodeType, read_tables

EVENTS = ("click", "view", "purchase", "signup", "error")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "conversations")
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def commerce_graph(spark: SparkSession, folder: str) -> Graph:
    """Foreign keys as edges; event kinds as labels of one table and as types of one edge table."""
    tables = read_tables(spark, folder, TABLES)
    tables["users"] = tables["events"].select("user_id").distinct()
    labels = {
        "Region": NodeType("region", "r_regionkey"),
        "Nation": NodeType("nation", "n_nationkey"),
        "Customer": NodeType("customer", "c_custkey"),
        "Supplier": NodeType("supplier", "s_suppkey"),
        "Part": NodeType("part", "p_partkey"),
        "Order": NodeType("orders", "o_orderkey"),
        "Document": NodeType("documents", "doc_id"),
        "Label": NodeType("labels", "doc_id"),
        "Vector": NodeType("embeddings", "vec_id"),
        "Page": NodeType("pages", "page_id"),
        "Message": NodeType("conversations", ("conv_id", "turn")),
        "User": NodeType("users", "user_id"),
        "Event": NodeType("events", "event_id"),
    } | {k.capitalize(): NodeType("events", "event_id", "event_type", k) for k in EVENTS}
    types = {
        "PLACED": EdgeType("orders", "o_custkey", "o_orderkey", "o_orderkey", "Customer", "Order"),
        "CUSTOMER_IN": EdgeType("customer", "c_custkey", "c_nationkey", "c_custkey", "Customer", "Nation"),
        "SUPPLIER_IN": EdgeType("supplier", "s_suppkey", "s_nationkey", "s_suppkey", "Supplier", "Nation"),
        "IN_REGION": EdgeType("nation", "n_nationkey", "n_regionkey", "n_nationkey", "Nation", "Region"),
        "CONTAINS": EdgeType("lineitem", "l_orderkey", "l_partkey", LINE, "Order", "Part"),
        "SUPPLIED": EdgeType("lineitem", "l_suppkey", "l_partkey", LINE, "Supplier", "Part"),
        "FULFILLED_BY": EdgeType("lineitem", "l_orderkey", "l_suppkey", LINE, "Order", "Supplier"),
        "HAS_LABEL": EdgeType("labels", "doc_id", "doc_id", "doc_id", "Document", "Label"),
        "DID": EdgeType("events", "user_id", "event_id", "event_id", "User", "Event"),
    } | {f"DID_{k.upper()}": EdgeType("events", "user_id", "event_id", "event_id", "User", "Event", "event_type", k) for k in EVENTS}
    tables["follows"] = tables["conversations"].select(
        F.struct("conv_id", "turn").alias("_from"), F.struct("conv_id", (F.col("turn") + 1).cast(tables["conversations"].schema["turn"].dataType).alias("turn")).alias("_to")
    )
    types["NEXT"] = EdgeType("follows", "_from", "_to", "_from", "Message", "Message")
    return Graph(tables, labels, types)
