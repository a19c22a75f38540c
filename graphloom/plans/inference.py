"""What kind of graph tables hold: type fields, the labels that edges lead to, and a graph built from that.

Everything is worked out over whole tables: shares and distinct values in one pass a table, ends of edges by joins
with the nodes' keys.  Only names, type values and counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.schema import label_name, type_column
from graphloom.sources.mapping import EdgeType, Graph, NodeType, key_of

# The names of fields that may tell node or edge types apart, and the share of rows that must carry one.
NODE_FIELDS = ("type", "_type", "entityType", "label", "labels", "kind")
EDGE_FIELDS = ("type", "relation", "relType", "_type")
CARRIED = 0.8


def type_fields(tables: Mapping[str, DataFrame], fields: Sequence[str] = NODE_FIELDS) -> DataFrame:
    """(table, field, rows, filled, different) for every table and every one of ``fields`` that it has; an empty table has no row."""
    parts = []
    for name, df in tables.items():
        own = [f for f in fields if f in df.columns and df.schema[f].dataType.typeName() == "string"]
        if own:
            counts = [F.struct(F.lit(f).alias("field"), F.count("*").alias("rows"), F.count(f).alias("filled"), F.count_distinct(f).alias("different")) for f in own]
            one = df.agg(F.array(*counts).alias("f")).select(F.lit(name).alias("table"), F.explode("f").alias("f"))
            parts.append(one.select("table", "f.*").where("rows > 0"))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, field string, rows long, filled long, different long")
    return reduce(DataFrame.unionByName, parts)


def storage_style(nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame]) -> str:
    """How types are stored: "pg" (a table for each), "lpg" (shared tables with a type field), "hybrid" or "unknown".

    A table of nodes is shared if at least CARRIED of its rows carry a type field of several values, one of edges if
    they carry one at all.  Empty tables of nodes say nothing, those of edges count as tables of their own.
    """
    some = {name for name, df in nodes.items() if not df.isEmpty()}
    shared = set()
    if nodes:
        shared |= {("node", r["table"]) for r in type_fields(nodes).where((F.col("filled") >= CARRIED * F.col("rows")) & (F.col("different") > 1)).collect()}
    if edges:
        shared |= {("edge", r["table"]) for r in type_fields(edges, EDGE_FIELDS).where(F.col("filled") >= CARRIED * F.col("rows")).collect()}
    n = len(some) + len(edges)
    return "unknown" if not n else "pg" if not shared else "lpg" if len(shared) == n else "hybrid"


def end_labels(graph: Graph, edges: DataFrame, source: str | Sequence[str], target: str | Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """(label, sources, targets): how many different ends of the edges on each side are nodes of each label.

    A compound key is only looked for among compound ones.
    """
    ends = {side: edges.select(key_of(columns).alias("_end")).where("_end is not null").distinct() for side, columns in (("sources", source), ("targets", target))}
    parts = []
    for label in labels or sorted(graph.labels):
        keys = graph.nodes(label).select(F.col("_id").alias("_key")).distinct()
        for side, own in ends.items():
            fits = own.schema["_end"].dataType.typeName() == "struct", keys.schema["_key"].dataType.typeName() == "struct"
            hits = own.join(keys, F.col("_end") == F.col("_key"), "left_semi") if fits[0] == fits[1] else own.limit(0)
            parts.append(hits.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), F.lit(side).alias("side"), "n"))
    hits = reduce(DataFrame.unionByName, parts)
    return hits.groupBy("label").agg(*[F.sum(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in ("sources", "targets")])


def edge_ends(graph: Graph, edges: DataFrame, source: str | Sequence[str], target: str | Sequence[str], labels: Sequence[str] | None = None) -> tuple[str | None, str | None]:
    """The labels that an edge type leads from and to: those that hold most of the ends (ties: the first by name), None without any."""
    found = end_labels(graph, edges, source, target, labels).collect()

    def best(side: str) -> str | None:
        some = sorted((-r[side], r["label"]) for r in found if r[side])
        return some[0][1] if some else None

    return best("sources"), best("targets")


def infer_graph(tables: Mapping[str, DataFrame], nodes: Mapping[str, str | Sequence[str]], edges: Mapping[str, tuple[str, str]]) -> Graph:
    """A graph over tables: ``nodes`` names the nodes' tables and keys, ``edges`` the edges' tables and their end columns.

    A table with a type column (type_column()) gives a label for each of its values, another one a label of the
    table's name.  Edge tables with a type field give a type for each value, others one of the table's name in
    capitals.  Ends are inferred where the edges' keys are found among the nodes'.
    """
    labels: dict[str, NodeType] = {}
    for name, key in nodes.items():
        by = type_column(tables[name])
        if by is None:
            labels[label_name(name)] = NodeType(name, key)
        else:
            values = tables[name].select(by).where(F.col(by).isNotNull()).distinct()
            labels |= {r[0]: NodeType(name, key, by, r[0]) for r in values.collect()}
    graph = Graph(tables, labels, {})
    types: dict[str, EdgeType] = {}
    for name, (source, target) in edges.items():
        by = next((f for f in EDGE_FIELDS if f in tables[name].columns), None)
        kinds = [r[0] for r in tables[name].select(by).where(F.col(by).isNotNull()).distinct().collect()] if by else [None]
        for kind in kinds:
            rows = tables[name].where(F.col(by) == kind) if kind is not None else tables[name]
            ends = edge_ends(graph, rows, source, target)
            types[name.upper() if kind is None else kind] = EdgeType(name, source, target, (source, target), *ends, by if kind is not None else None, kind)
    return Graph(tables, labels, types)
