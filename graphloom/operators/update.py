"""Updates that give a new graph: tables are DataFrames and stay as they are.

A created row takes the columns of its table; those that are not given are null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.mapping import EdgeType, Graph, GraphError, NodeType, _names, key_of


def _fitted(rows: DataFrame, table: DataFrame, fixed: Mapping[str, object]) -> DataFrame:
    """rows with the columns of ``table`` in its types."""
    extra = set(rows.columns) - set(table.columns)
    if extra:
        raise GraphError(f"no columns {', '.join(sorted(extra))}", "INVALID_ARGUMENT")
    value = lambda f: F.lit(fixed[f.name]) if f.name in fixed else F.col(f.name) if f.name in rows.columns else F.lit(None)
    return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in table.schema])


def _fixed(t: NodeType | EdgeType) -> dict[str, object]:
    return {t.type_field: t.type_value} if t.type_field else {}


def create_nodes(graph: Graph, label: str, rows: DataFrame) -> Graph:
    """CREATE (n:label {…}): a node for each row; a shared table's type column is set."""
    t = graph.node_type(label)
    table = graph.table(t.table)
    return graph.with_table(t.table, table.unionByName(_fitted(rows, table, _fixed(t))))


def foreign_key(graph: Graph, t: EdgeType) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """(node key columns, columns that refer to the other end) if the edge type is a foreign key in a node's row."""
    for n in graph.labels.values():
        key = _names(n.key)
        if n.table == t.table and key in (_names(t.source), _names(t.target)):
            return key, _names(t.target) if key == _names(t.source) else _names(t.source)
    return None


def _referred(graph: Graph, t: EdgeType, rows: DataFrame) -> Graph:
    """Sets foreign keys of existing nodes: a key that is null is set, an equal one stays, another one is an error when the graph is used.

    A row of such a table is a node, so no row is added; ends without a node have no edge.  Two different ends for one
    node are an error too.
    """
    key, refer = foreign_key(graph, t)
    table = graph.table(t.table)
    given = rows.where(" and ".join(f"`{c}` is not null" for c in (*key, *refer))).groupBy(*key).agg(F.min(F.struct(*refer)).alias("_new"), F.max(F.struct(*refer)).alias("_most"))
    given = given.select(*[F.col(c).alias(f"_key_{c}") for c in key], "_new", "_most")
    out = table.join(given, [F.col(c) == F.col(f"_key_{c}") for c in key], "left")
    old = F.struct(*[F.col(c).cast(given.schema["_new"].dataType[c].dataType).alias(c) for c in refer])
    unset = F.lit(True)
    for c in refer:
        unset = unset & F.col(c).isNull()
    wrong = F.col("_new").isNotNull() & ((F.col("_new") != F.col("_most")) | (~unset & (old != F.col("_new"))))
    refused = F.raise_error(F.lit(f"a node has one edge of this type at most: {t.table}"))
    new = {c: F.when(wrong, refused.cast(table.schema[c].dataType)).when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).cast(table.schema[c].dataType) for c in refer}
    return graph.with_table(t.table, out.withColumns(new).select(*table.columns))


def create_edges(graph: Graph, type: str, rows: DataFrame) -> Graph:
    """CREATE (a)-[:type {…}]->(b): an edge for each row with the source and target key columns.

    An edge that is a foreign key is set in its node's row, which must have none or the same.
    """
    t = graph.edge_type(type)
    if t.embedded:
        raise GraphError("embedded edges are part of their node", "UNSUPPORTED")
    if foreign_key(graph, t):
        return _referred(graph, t, rows)
    table = graph.table(t.table)
    return graph.with_table(t.table, table.unionByName(_fitted(rows, table, _fixed(t))))


def merge_nodes(graph: Graph, label: str, rows: DataFrame, on: list[str], on_create: Mapping[str, Column] | None = None, on_match: Mapping[str, Column] | None = None) -> Graph:
    """MERGE (n:label {on}) ON CREATE SET … ON MATCH SET …: rows without a node that agrees in ``on`` are created once.

    on_match expressions see the node's columns.  Rows that repeat their ``on`` values count once.
    """
    t = graph.node_type(label)
    table = graph.table(t.table)
    keys = rows.select(*on).dropDuplicates().withColumn("_hit", F.lit(True))
    mine = table if not t.type_field else table.where(F.col(t.type_field) == t.type_value)
    fresh = keys.join(mine.select(*on), on, "left_anti").drop("_hit").withColumns(dict(on_create or {}))
    marked = table.join(keys, on, "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.coalesce(F.col(t.type_field) == t.type_value, F.lit(False)) if t.type_field else F.lit(True))
    changes = {c: F.when(hit, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in (on_match or {}).items()}
    kept = marked.withColumns(changes).select(*table.columns) if changes else table
    return graph.with_table(t.table, kept.unionByName(_fitted(fresh, table, _fixed(t))))


def merge_edges(graph: Graph, type: str, rows: DataFrame) -> Graph:
    """MERGE (a)-[:type]->(b): ends without such an edge get one; properties of ``rows`` are set on creation only.

    An edge that is a foreign key is set in its node's row; a node that refers to another one already is an error.
    """
    t = graph.edge_type(type)
    if foreign_key(graph, t):
        return _referred(graph, t, rows)
    ends = [*_names(t.source), *_names(t.target)]
    table = graph.table(t.table)
    mine = table if not t.type_field else table.where(F.col(t.type_field) == t.type_value)
    fresh = rows.dropDuplicates(ends).join(mine.select(*ends), ends, "left_anti")
    return graph.with_table(t.table, table.unionByName(_fitted(fresh, table, _fixed(t))))


def _changed(graph: Graph, label: str, ids: DataFrame, changes: Mapping[str, Column]) -> Graph:
    """The label's nodes whose id is in ``ids`` (column _id) with changed columns."""
    t = graph.node_type(label)
    table = graph.table(t.table)
    hits = ids.select(F.col("_id").alias("_hit_id")).distinct()
    rows = table.withColumn("_key_value", key_of(t.key)).join(hits, F.col("_key_value") == F.col("_hit_id"), "left")
    mine = F.coalesce(F.col(t.type_field) == t.type_value, F.lit(False)) if t.type_field else F.lit(True)
    hit = F.col("_hit_id").isNotNull() & mine
    new = {c: F.when(hit, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in changes.items()}
    return graph.with_table(t.table, rows.withColumns(new).select(*table.columns))


def set_properties(graph: Graph, label: str, ids: DataFrame, values: Mapping[str, Column], replace_all: bool = False) -> Graph:
    """SET n.p = e (several at once see the old values), or SET n = {…} with ``replace_all``: other properties become null."""
    t = graph.node_type(label)
    values = {t.fields.get(k, k): v for k, v in values.items()}
    unknown = set(values) - set(graph.table(t.table).columns)
    if unknown:
        raise GraphError(f"no columns {', '.join(sorted(unknown))}", "INVALID_ARGUMENT")
    if replace_all:
        keep = {*_names(t.key), t.type_field}
        values = {c: F.lit(None) for c in graph.table(t.table).columns if c not in keep} | values
    return _changed(graph, label, ids, values)


def add_properties(graph: Graph, label: str, maps: DataFrame, values: str) -> Graph:
    """SET n += map: each node (column _id of ``maps``) takes the values of a struct column; its other properties stay.

    A field that is null in the struct becomes null, as a map's null removes the property.  An id that repeats takes
    the largest struct.
    """
    t = graph.node_type(label)
    table = graph.table(t.table)
    names = {t.fields.get(f, f): f for f in maps.schema[values].dataType.fieldNames()}
    unknown = set(names) - set(table.columns)
    if unknown:
        raise GraphError(f"no columns {', '.join(sorted(unknown))}", "INVALID_ARGUMENT")
    one = maps.groupBy(F.col("_id").alias("_hit_id")).agg(F.max(values).alias("_map"))
    rows = table.withColumn("_key_value", key_of(t.key)).join(one, F.col("_key_value") == F.col("_hit_id"), "left")
    mine = F.coalesce(F.col(t.type_field) == t.type_value, F.lit(False)) if t.type_field else F.lit(True)
    hit = F.col("_hit_id").isNotNull() & mine
    new = {c: F.when(hit, F.col("_map")[f]).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, f in names.items()}
    return graph.with_table(t.table, rows.withColumns(new).select(*table.columns))


def remove_properties(graph: Graph, label: str, ids: DataFrame, names: list[str]) -> Graph:
    """REMOVE n.p: the property becomes null."""
    return set_properties(graph, label, ids, {n: F.lit(None) for n in names})


def set_each(graph: Graph, label: str, lists: DataFrame, items: str, values: Mapping[str, Column]) -> Graph:
    """FOREACH (x IN items | SET x.p = e): ``items`` is a list of node ids in each row of ``lists``."""
    return set_properties(graph, label, lists.select(F.explode(items).alias("_id")), values)


def delete_nodes(graph: Graph, label: str, ids: DataFrame, detach: bool = False) -> Graph:
    """DELETE n, or DETACH DELETE n: with it edges of all types go whose end has the label and one of the ids.

    Rows of a table that holds only edges with that end are deleted.  Where a row is a node too (a foreign key), or
    carries edges of other types between other ends, only the columns that refer to the node become null.  Without
    ``detach`` edges stay; connected() tells which nodes have some.
    """
    t = graph.node_type(label)
    gone = ids.select(F.col("_id").alias("_gone")).distinct()
    kept = graph.table(t.table).withColumn("_key_value", key_of(t.key))
    if t.type_field:
        gone = kept.where(F.col(t.type_field) == t.type_value).join(gone, F.col("_key_value") == F.col("_gone"), "left_semi").select(F.col("_key_value").alias("_gone")).distinct()
        mine = F.coalesce(F.col(t.type_field) == t.type_value, F.lit(False))
        kept = kept.join(gone, (F.col("_key_value") == F.col("_gone")) & mine, "left_anti")
    else:
        kept = kept.join(gone, F.col("_key_value") == F.col("_gone"), "left_anti")
    out = graph.with_table(t.table, kept.drop("_key_value"))
    for table, end in sorted(_ends(graph, label)) if detach else ():
        rows = out.table(table)
        nodes = {_names(n.key) for n in graph.labels.values() if n.table == table}
        if end in nodes:
            continue  # the row is the node itself
        others = [e for e in graph.types.values() if e.table == table and not e.embedded and end not in (_names(e.source), _names(e.target))]
        rows = rows.withColumn("_end_value", key_of(end))
        if nodes or others:
            rows = rows.join(gone, F.col("_end_value") == F.col("_gone"), "left")
            rows = rows.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in end}).drop("_gone")
        else:
            rows = rows.join(gone, F.col("_end_value") == F.col("_gone"), "left_anti")
        out = out.with_table(table, rows.drop("_end_value"))
    return out


def _ends(graph: Graph, label: str) -> set[tuple[str, tuple[str, ...]]]:
    """(table, columns) of all edge ends that refer to nodes of a label; an end without a declared label refers to any."""
    fits = lambda at: at is None or graph.same_nodes(at, label)
    edges = [e for e in graph.types.values() if not e.embedded]
    return {(e.table, _names(end)) for e in edges for end, at in ((e.source, e.from_label), (e.target, e.to_label)) if fits(at)}


def connected(graph: Graph, label: str, ids: DataFrame) -> DataFrame:
    """The ids (column _id) of nodes that an edge of any type leaves or enters: those that DELETE without DETACH may not delete."""
    out = None
    for e in graph.types.values():
        if e.embedded:
            continue
        for column, at in (("_src", e.from_label), ("_dst", e.to_label)):
            if at is None or graph.same_nodes(at, label):
                edges = graph.edges(next(k for k, v in graph.types.items() if v is e)).select(F.col(column).alias("_id"))
                out = edges if out is None else out.unionByName(edges)
    ids = ids.select("_id").distinct()
    return ids.limit(0) if out is None else ids.join(out, "_id", "left_semi")


def delete_edges(graph: Graph, type: str, ids: DataFrame) -> Graph:
    """DELETE r: edges of one type by their ids (column _eid)."""
    t = graph.edge_type(type)
    rows = graph.table(t.table).withColumn("_edge_value", key_of(t.key or (*_names(t.source), *_names(t.target))))
    gone = ids.select(F.col("_eid").alias("_gone")).distinct()
    own = F.coalesce(F.col(t.type_field) == t.type_value, F.lit(False)) if t.type_field else F.lit(True)
    return graph.with_table(t.table, rows.join(gone, (F.col("_edge_value") == F.col("_gone")) & own, "left_anti").drop("_edge_value"))
