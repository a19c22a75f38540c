"""Shortest paths by breadth-first search over DataFrames."""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.match import MOST_HOPS, OUT, _directed
from graphloom.sources.mapping import Graph


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names (a temporary one in local runs without it)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint()


def shortest_paths(graph: Graph, type: str, pairs: DataFrame, direction: str = OUT, most: int | None = None) -> DataFrame:
    """(source, target, hops, nodes) for the pairs (source, target) that a path of at most ``most`` edges (None: any number) joins.

    All pairs are searched together; a level keeps one path to each new node of each source (the one whose node
    list is smallest), and the search ends when every pair is answered or no node is new.
    """
    edges = _directed(graph.edges(type), direction).select(F.col("_src").alias("_s"), F.col("_dst").alias("_d")).distinct()
    pairs = pairs.select("source", "target").distinct()
    seen = _cut(pairs.select("source").distinct().select("source", F.col("source").alias("end"), F.lit(0).alias("hops"), F.array("source").alias("nodes")))
    level = seen
    for n in count(1) if most is None else range(1, most + 1):
        step = level.join(edges, F.col("end") == F.col("_s")).select("source", F.col("_d").alias("end"), F.lit(n).alias("hops"), F.concat("nodes", F.array("_d")).alias("nodes"))
        step = step.groupBy("source", "end").agg(F.min("hops").alias("hops"), F.min("nodes").alias("nodes"))
        level = _cut(step.join(seen.select("source", "end"), ["source", "end"], "left_anti"))
        if level.isEmpty():
            break
        seen = _cut(seen.unionByName(level))
        if pairs.join(seen.select("source", F.col("end").alias("target")), ["source", "target"], "left_anti").isEmpty():
            break
    return pairs.join(seen.withColumnRenamed("end", "target"), ["source", "target"]).select("source", "target", "hops", "nodes")


def k_shortest_paths(graph: Graph, type: str, pairs: DataFrame, k: int, direction: str = OUT, most: int = MOST_HOPS) -> DataFrame:
    """(source, target, rank, hops, nodes): the ``k`` shortest paths without repeated nodes of each pair, at most ``most`` edges long."""
    edges = _directed(graph.edges(type), direction).select(F.col("_src").alias("_s"), F.col("_dst").alias("_d")).distinct()
    pairs = pairs.select("source", "target").distinct()
    level = pairs.withColumns({"end": F.col("source"), "nodes": F.array("source")})
    found = []
    for n in range(1, most + 1):
        level = level.where("end <> target").join(edges, F.col("end") == F.col("_s")).where(~F.array_contains("nodes", F.col("_d")))
        level = level.select("source", "target", F.col("_d").alias("end"), F.concat("nodes", F.array("_d")).alias("nodes"))
        found.append(level.where("end = target").select("source", "target", F.lit(n).alias("hops"), "nodes"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("source", "target").orderBy("hops", "nodes")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("source", "target", "rank", "hops", "nodes")
