"""A graph over ordinary tables: how labels and relationship types map to DataFrames.

Nodes come from a table of their own or from rows of a shared table that a type column tells apart.  Edges come
from an edge table (of their own or shared, with a type column), from a foreign key of any table, or from a
struct or array embedded in the node's row.  All of them become flat DataFrames with columns ``_id`` or
``_src``, ``_dst`` and ``_eid`` beside their properties, so that Spark prunes and pushes down as in any query.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class GraphError(ValueError):
    """What is wrong with a mapping or a pattern; ``code`` names the kind."""

    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class NodeType:
    """Rows of ``table`` (those whose type_field is or, if it is a list of labels, holds type_value), identified by ``key``.

    ``fields`` renames properties: conceptual name to column.  ``count`` is an estimate for choosing among labels.
    """

    table: str
    key: str | Sequence[str]
    type_field: str | None = None
    type_value: str | None = None
    fields: Mapping[str, str] = field(default_factory=dict)
    count: int | None = None


@dataclass(frozen=True)
class EdgeType:
    """Rows of ``table`` as edges from ``source`` to ``target`` (key columns); ``key`` identifies the edge.

    ``embedded`` instead names a struct or array column of the nodes' table: the edge leads to what it holds.
    """

    table: str
    source: str | Sequence[str]
    target: str | Sequence[str]
    key: str | Sequence[str] = ()
    from_label: str | None = None
    to_label: str | None = None
    type_field: str | None = None
    type_value: str | None = None
    embedded: str | None = None


def key_of(columns: str | Sequence[str]) -> Column:
    """One column for a key; a compound key is a struct."""
    names = [columns] if isinstance(columns, str) else list(columns)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


@dataclass(frozen=True)
class Graph:
    """Named tables with node and edge types; immutable, updates give a new graph."""

    tables: Mapping[str, DataFrame]
    labels: Mapping[str, NodeType]
    types: Mapping[str, EdgeType]

    def node_type(self, label: str) -> NodeType:
        if label not in self.labels:
            raise GraphError(f"no label {label}; there are {', '.join(sorted(self.labels))}", "MAPPING_NOT_FOUND")
        return self.labels[label]

    def edge_type(self, name: str) -> EdgeType:
        if name not in self.types:
            raise GraphError(f"no relationship type {name}; there are {', '.join(sorted(self.types))}", "MAPPING_NOT_FOUND")
        return self.types[name]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise GraphError(f"no table {name}", "INVALID_MAPPING")
        return self.tables[name]

    def same_nodes(self, a: str, b: str) -> bool:
        """Whether ids of two labels mean the same nodes: rows of one table under one key."""
        x, y = self.labels.get(a), self.labels.get(b)
        if x is None or y is None:
            return a == b or x is y
        return x.table == y.table and _names(x.key) == _names(y.key)

    def nodes(self, label: str | Sequence[str]) -> DataFrame:
        """_id and properties of the nodes that have all the labels; the smallest label is scanned, others are checked by key."""
        names = [label] if isinstance(label, str) else sorted(label, key=lambda x: (self.node_type(x).count is None, self.node_type(x).count or 0))
        first = self._scan(self.node_type(names[0]))
        return reduce(lambda df, other: df.join(self._scan(self.node_type(other)).select("_id"), "_id", "left_semi"), names[1:], first)

    def all_nodes(self) -> DataFrame:
        """The nodes of all labels with their label in _label; properties that a label lacks are null."""
        parts = [self._scan(t).withColumn("_label", F.lit(k)).withColumn("_id", F.col("_id").cast("string")) for k, t in sorted(self.labels.items())]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _scan(self, t: NodeType) -> DataFrame:
        df = self.table(t.table)
        if t.type_field:
            listed = df.schema[t.type_field].dataType.typeName() == "array"
            df = df.where(F.array_contains(t.type_field, t.type_value) if listed else F.col(t.type_field) == t.type_value)
        renamed = {v: k for k, v in t.fields.items()}
        return df.select(key_of(t.key).alias("_id"), *[F.col(c).alias(renamed.get(c, c)) for c in df.columns if c != "_id"])

    def edges(self, name: str | Sequence[str]) -> DataFrame:
        """_src, _dst, _eid, _type and properties of one type's edges, or of several types' without properties."""
        if not isinstance(name, str):
            parts = [self.edges(n).select("_src", "_dst", F.col("_eid").cast("string").alias("_eid"), "_type") for n in name]
            return reduce(DataFrame.unionByName, parts)
        t = self.edge_type(name)
        df = self.table(t.table)
        if t.type_field:
            df = df.where(F.col(t.type_field) == t.type_value)
        if t.embedded:
            return self._embedded(df, t, name)
        return df.select(key_of(t.source).alias("_src"), key_of(t.target).alias("_dst"), key_of(t.key or (*_names(t.source), *_names(t.target))).alias("_eid"), F.lit(name).alias("_type"), *df.columns).where("_src is not null and _dst is not null")

    def _embedded(self, df: DataFrame, t: EdgeType, name: str) -> DataFrame:
        source = key_of(t.source)
        if df.schema[t.embedded].dataType.typeName() == "array":
            df = df.select(source.alias("_src"), F.posexplode(t.embedded).alias("_place", "_value"))
        else:
            df = df.select(source.alias("_src"), F.lit(0).alias("_place"), F.col(t.embedded).alias("_value")).where("_value is not null")
        return df.select("_src", F.struct("_src", "_place").alias("_dst"), F.struct("_src", "_place").alias("_eid"), F.lit(name).alias("_type"), "_value")

    def with_table(self, name: str, df: DataFrame) -> Graph:
        return replace(self, tables={**self.tables, name: df})


def _names(columns: str | Sequence[str]) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)


def _get(d: Mapping, name: str, default=None):
    """A value under its camelCase or its snake_case name."""
    snake = "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
    return d.get(name, d.get(snake, default))


def graph_from_mapping(mapping: Mapping | str, tables: Mapping[str, DataFrame], key: str = "_key") -> Graph:
    """A graph from an exported mapping (a dict or JSON text): physicalMapping with entities and relationships.

    Entity styles COLLECTION and LABEL, relationship styles DEDICATED_COLLECTION, GENERIC_WITH_TYPE and EMBEDDED;
    names may be in camelCase or snake_case.  Edge tables have ``_from`` and ``_to``, which hold "table/key" ids.
    """
    mapping = json.loads(mapping) if isinstance(mapping, str) else mapping
    physical = _get(mapping, "physicalMapping") or mapping
    labels, types = {}, {}
    for label, e in (_get(physical, "entities") or {}).items():
        renames = {p: f for p, v in (_get(e, "properties") or {}).items() if isinstance(v, Mapping) and (f := _get(v, "field")) and f != p}
        style = _get(e, "style", "COLLECTION")
        if style not in ("COLLECTION", "LABEL"):
            raise GraphError(f"unknown entity style {style}", "INVALID_MAPPING")
        typed = (_get(e, "typeField"), _get(e, "typeValue")) if style == "LABEL" else (None, None)
        labels[label] = NodeType(_get(e, "collectionName"), "_id", *typed, fields=renames, count=_get(e, "estimatedCount"))
    for name, r in (_get(physical, "relationships") or {}).items():
        style = _get(r, "style", "DEDICATED_COLLECTION")
        ends = (_get(r, "domain"), _get(r, "range"))
        if style == "EMBEDDED":
            path = _get(r, "embeddedPath") or _get(r, "embeddedArray")
            owner = labels[ends[0]].table if ends[0] in labels else _get(r, "collectionName")
            types[name] = EdgeType(owner, "_id", "_id", from_label=ends[0], to_label=ends[1], embedded=path)
            continue
        if style not in ("DEDICATED_COLLECTION", "GENERIC_WITH_TYPE"):
            raise GraphError(f"unknown relationship style {style}", "INVALID_MAPPING")
        typed = (_get(r, "typeField"), _get(r, "typeValue")) if style == "GENERIC_WITH_TYPE" else (None, None)
        types[name] = EdgeType(_get(r, "edgeCollectionName") or _get(r, "collectionName"), "_from", "_to", "_id", *ends, *typed)
    known = {n: df.withColumn("_id", F.concat(F.lit(f"{n}/"), F.col(key))) if "_id" not in df.columns and key in df.columns else df for n, df in tables.items()}
    return Graph(known, labels, types)


def mapping_of(graph: Graph) -> dict:
    """The mapping that graph_from_mapping() reads: entities and relationships with their styles, fields and ends."""
    entities, relationships = {}, {}
    for label, t in graph.labels.items():
        e = {"style": "LABEL" if t.type_field else "COLLECTION", "collectionName": t.table}
        e |= {"typeField": t.type_field, "typeValue": t.type_value} if t.type_field else {}
        e |= {"properties": {p: {"field": f} for p, f in t.fields.items()}} if t.fields else {}
        entities[label] = e | ({"estimatedCount": t.count} if t.count is not None else {})
    for name, t in graph.types.items():
        if t.embedded:
            r = {"style": "EMBEDDED", "embeddedPath": t.embedded, "collectionName": t.table}
        else:
            r = {"style": "GENERIC_WITH_TYPE" if t.type_field else "DEDICATED_COLLECTION", "edgeCollectionName": t.table}
            r |= {"typeField": t.type_field, "typeValue": t.type_value} if t.type_field else {}
        relationships[name] = r | {k: v for k, v in (("domain", t.from_label), ("range", t.to_label)) if v}
    return {"physicalMapping": {"entities": entities, "relationships": relationships}}


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
