"""Graph patterns as joins.

A Pattern is a DataFrame of variable bindings: the node variable ``c`` has the columns ``c___id`` and ``c__name``
for its properties, an edge variable ``r`` has ``r___eid`` and so on.  Every step is an ordinary lazy join, so that
Catalyst prunes columns, pushes filters to the scans and picks the joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.mapping import Graph, GraphError
from graphloom.sources.mapping import _names as _columns

OUT, IN, ANY = "out", "in", "any"
#: Hops of a variable-length pattern without an upper bound.
MOST_HOPS = 10


def same_value(column: Column, value) -> Column:
    """Inline property match: text literals are compared without case, everything else exactly."""
    return F.lower(column) == value.lower() if isinstance(value, str) else column == value


def _names(label: str | Sequence[str] | None) -> tuple[str, ...]:
    return () if label is None else _columns(label)


def prefixed(df: DataFrame, var: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{var}__{c}") for c in df.columns])


def _filtered(df: DataFrame, properties: Mapping | None, same: Callable[[Column, object], Column] = same_value) -> DataFrame:
    for name, value in (properties or {}).items():
        known = name in df.columns
        df = df.where(same(F.col(name), value) if known else F.lit(False))
    return df


def exactly(column: Column, value) -> Column:
    """Inline match of edge properties; a plain comparison is pushed down to the scan."""
    return column == value


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges with _src as the end that a pattern comes from; undirected self-loops come once."""
    turned = [F.col({"_src": "_dst", "_dst": "_src"}.get(c, c)).alias(c) for c in edges.columns]
    if direction == OUT:
        return edges
    if direction == IN:
        return edges.select(*turned)
    return edges.unionByName(edges.where("_src <> _dst").select(*turned))


@dataclass(frozen=True)
class Pattern:
    """Bindings ``df`` over ``graph``; ``last`` is the variable that the next hop leaves, ``edges`` those of this MATCH."""

    graph: Graph
    df: DataFrame
    last: str | None = None
    edges: tuple[tuple[str, frozenset[str]], ...] = ()
    labels: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Column:
        """The column of "var.property" or "var.property.field…"; null if there is no such property; "var" alone is the node's id."""
        var, _, prop = name.partition(".")
        first, *rest = (prop or "_id").split(".")
        column = f"{var}__{first}"
        if column in self.df.columns:
            value, kind = F.col(column), self.df.schema[column].dataType
            for step in rest:
                if kind.typeName() == "struct" and step in kind.fieldNames():
                    value, kind = value.getField(step), kind[step].dataType
                elif kind.typeName() == "map":
                    value, kind = value.getItem(step), kind.valueType
                else:
                    return F.lit(None)
            return value
        if any(c.startswith(f"{var}__") for c in self.df.columns):
            return F.lit(None)
        raise GraphError(f"no variable {var}", "UNSUPPORTED")

    def where(self, condition: Column) -> Pattern:
        return replace(self, df=self.df.where(condition))

    def with_columns(self, **columns: Column) -> Pattern:
        return replace(self, df=self.df.withColumns(columns))

    def select(self, **columns: Column) -> DataFrame:
        return self.df.select(*[v.alias(k) for k, v in columns.items()])

    def at(self, var: str) -> Pattern:
        """The next hop leaves ``var``."""
        return replace(self, last=var)

    def match(self) -> Pattern:
        """Begins another MATCH: its edges may repeat those before."""
        return replace(self, edges=())

    def node(self, label: str | Sequence[str], var: str, properties: Mapping | None = None) -> Pattern:
        """A further node without an edge: every binding with every node, unless ``var`` is bound (then a label test)."""
        nodes = _filtered(self.graph.nodes(label), properties)
        if f"{var}___id" in self.df.columns:
            if not self._may_be(var, _names(label)):
                return replace(self, df=self.df.limit(0), last=var)
            own = nodes.select(F.col("_id").alias("_own"))
            return replace(self, df=self.df.join(own, F.col(f"{var}___id") == F.col("_own"), "left_semi"), last=var)
        return replace(self, df=self.df.crossJoin(prefixed(nodes, var)), last=var, labels={**self.labels, var: _names(label)})

    def _may_be(self, var: str, labels: Sequence[str]) -> bool:
        """Whether nodes of a variable can have the labels: they can if all are rows of one table, or the variable's are not known."""
        return all(self.graph.same_nodes(a, b) for a in self.labels.get(var, ()) for b in labels)

    def _fitting(self, type: str, direction: str, label: Sequence[str]) -> list[str]:
        """The directions in which an edge type's declared ends fit the last variable and the end's labels."""
        t = self.graph.edge_type(type)
        out = []
        for way, near, far in ((OUT, t.from_label, t.to_label), (IN, t.to_label, t.from_label)):
            if direction in (way, ANY) and (near is None or self._may_be(self.last, [near])) and (far is None or all(self.graph.same_nodes(far, x) for x in label)):
                out.append(way)
        return out

    def _edges(self, type: str | Sequence[str], direction: str, label: Sequence[str]) -> tuple[DataFrame, tuple[str, ...]]:
        """Edges of the types from the last variable to nodes of the labels, and the labels that their ends are declared to have.

        Types and directions whose declared ends do not fit have no edges here; if none fits, the pattern is in error.
        """
        several = not isinstance(type, str)
        parts, ends = [], set()
        for name in type if several else [type]:
            t, fitting = self.graph.edge_type(name), self._fitting(name, direction, label)
            if fitting:
                parts.append(_directed(self.graph.edges([name] if several else name), fitting[0] if len(fitting) == 1 else ANY))
                ends |= {t.to_label if way == OUT else t.from_label for way in fitting}
        if not parts:
            raise GraphError(f"{type} does not lead from {'/'.join(self.labels.get(self.last, ('?',)))} to {'/'.join(label) or '?'} ({direction})", "ENDPOINT_MISMATCH")
        return reduce(DataFrame.unionByName, parts), tuple(ends) if len(ends) == 1 and None not in ends else ()

    def hop(self, type: str | Sequence[str], label: str | Sequence[str] | None, var: str, direction: str = OUT, edge: str | None = None, properties: Mapping | None = None, edge_properties: Mapping | None = None) -> Pattern:
        """One relationship from the last variable.

        A ``var`` that is bound closes a cycle.  Without a label the end node's table is not read: only its id
        is known.  Edges of one MATCH are pairwise different if they come from the same table.  Text in
        ``edge_properties`` is compared exactly.  The ends that an edge type declares must fit the labels: ids are keys
        of their own tables, so an edge to another label's key would be another node.
        """
        edge = edge or f"_r{len(self.edges)}"
        wanted = _names(label) or self.labels.get(var, ())
        rows, ends = self._edges(type, direction, wanted)
        rows = prefixed(_filtered(rows, edge_properties, exactly), edge)
        df = self.df.join(rows, F.col(f"{self.last}___id") == F.col(f"{edge}___src"))
        tables = frozenset(self.graph.edge_type(t).table for t in ([type] if isinstance(type, str) else type))
        for other, used in self.edges:
            if used & tables:
                mine, theirs = f"{edge}___eid", f"{other}___eid"
                same = df.schema[mine].dataType == df.schema[theirs].dataType
                # ids of several types' edges are texts
                df = df.where(F.col(mine) != F.col(theirs) if same else F.col(mine).cast("string") != F.col(theirs).cast("string"))
        end = F.col(f"{edge}___dst")
        if f"{var}___id" in df.columns:
            df = df.where(end == F.col(f"{var}___id"))
        elif label is None:
            df = df.withColumn(f"{var}___id", end)
        else:
            df = df.join(prefixed(_filtered(self.graph.nodes(label), properties), var), end == F.col(f"{var}___id"))
        return Pattern(self.graph, df, var, (*self.edges, (edge, tables)), {**self.labels, var: wanted or ends})

    def out(self, type, label, var, **more) -> Pattern:
        return self.hop(type, label, var, OUT, **more)

    def into(self, type, label, var, **more) -> Pattern:
        return self.hop(type, label, var, IN, **more)

    def both(self, type, label, var, **more) -> Pattern:
        return self.hop(type, label, var, ANY, **more)

    def embedded(self, type: str, var: str, optional: bool = False) -> Pattern:
        """The struct or the array elements that the last node's row holds; an object may be missing if ``optional``."""
        t = self.graph.edge_type(type)
        column = f"{self.last}__{t.embedded}"
        if self.df.schema[column].dataType.typeName() == "array":
            rows = self.df.withColumn(f"{var}__value", (F.explode_outer if optional else F.explode)(column))
        else:
            rows = self.df.withColumn(f"{var}__value", F.col(column))
            rows = rows if optional else rows.where(F.col(f"{var}__value").isNotNull())
        return replace(self, df=rows.withColumn(f"{var}___id", F.col(f"{self.last}___id")), last=var)

    def hops(self, type: str, label: str | None, var: str, least: int = 1, most: int | None = None, direction: str = OUT, path: str | None = None) -> Pattern:
        """A variable-length relationship: one row for each path of ``least`` to ``most`` edges that are all different.

        Zero hops bind the start itself.  ``path`` names a struct column (nodes: array of ids, edges: array of edge
        ids).  A filter on the start applies before the first hop, one on the end only to the end.
        """
        most = MOST_HOPS if most is None else most
        t = self.graph.edge_type(type)
        if not self._fitting(type, direction, _names(label) if most == 1 else ()):
            raise GraphError(f"{type} does not leave {'/'.join(self.labels.get(self.last, ('?',)))} ({direction})", "ENDPOINT_MISMATCH")
        if most > 1 and None not in (t.from_label, t.to_label) and not self.graph.same_nodes(t.from_label, t.to_label):
            raise GraphError(f"{type} joins different labels, so its edges do not follow one another", "ENDPOINT_MISMATCH")
        edges = _directed(self.graph.edges(type), direction).select(F.col("_src").alias("_s"), F.col("_dst").alias("_d"), F.col("_eid").alias("_e"))
        start = F.col(f"{self.last}___id")
        none = F.array().cast(f"array<{edges.schema['_e'].dataType.simpleString()}>")
        level = self.df.withColumns({"_end": start, "_nodes": F.array(start), "_edges": none})
        levels = [level] if least == 0 else []
        for n in range(1, most + 1):
            level = level.join(edges, F.col("_end") == F.col("_s")).where(~F.array_contains("_edges", F.col("_e")))
            level = level.withColumns({"_end": F.col("_d"), "_nodes": F.concat("_nodes", F.array("_d")), "_edges": F.concat("_edges", F.array("_e"))}).drop("_s", "_d", "_e")
            if n >= least:
                levels.append(level)
        if not levels:
            raise GraphError(f"no path has {least} to {most} edges", "INVALID_ARGUMENT")
        df = reduce(DataFrame.unionByName, levels)
        if f"{var}___id" in df.columns:
            df = df.where(F.col("_end") == F.col(f"{var}___id"))
        elif label is None:
            df = df.withColumn(f"{var}___id", F.col("_end"))
        else:
            df = df.join(prefixed(self.graph.nodes(label), var), F.col("_end") == F.col(f"{var}___id"))
        if path:
            df = df.withColumn(path, F.struct(F.col("_nodes").alias("nodes"), F.col("_edges").alias("edges")))
        return replace(self, df=df.drop("_end", "_nodes", "_edges"), last=var, labels={**self.labels, var: _names(label)})

    def named_path(self, name: str, nodes: Sequence[str], edges: Sequence[str]) -> Pattern:
        """A path of bound variables as a struct (nodes, edges) of ids."""
        value = F.struct(F.array(*[self[n] for n in nodes]).alias("nodes"), F.array(*[F.col(f"{e}___eid") for e in edges]).alias("edges"))
        return self.with_columns(**{name: value})

    # -------------------------------------------------------- subpatterns

    def _start(self, ids: DataFrame, var: str) -> Pattern:
        return Pattern(self.graph, ids, var, labels={k: v for k, v in self.labels.items() if k == var})

    def _sub(self, var: str, build: Callable[[Pattern], Pattern]) -> DataFrame:
        """The bindings of a subpattern that starts at ``var``, by that node's id in _start."""
        ids = self.df.select(F.col(f"{var}___id")).distinct()
        sub = build(self._start(ids, var)).df
        return sub.withColumnRenamed(f"{var}___id", "_start")

    def optional(self, var: str, build: Callable[[Pattern], Pattern]) -> Pattern:
        """OPTIONAL MATCH from ``var``: all matches, or nulls.  Conditions on the new variables go into ``build``."""
        ids = self.df.select(F.col(f"{var}___id")).distinct()
        sub = build(self._start(ids, var))
        rows = sub.df.withColumnRenamed(f"{var}___id", "_start")
        df = self.df.join(rows, F.col(f"{var}___id") == F.col("_start"), "left").drop("_start")
        return replace(self, df=df, labels={**sub.labels, **self.labels})

    def optional_node(self, label: str | Sequence[str], var: str, properties: Mapping | None = None, on: Callable[[Callable[[str], Column]], Column] | None = None) -> Pattern:
        """OPTIONAL MATCH of a node alone: every binding with every node that ``on`` allows (all without it), or nulls.

        ``on`` gets a function from "var.property" to its column, and gives a condition.  An equality in ``on`` makes an ordinary outer join of it; without one the nodes are meant to be few.
        """
        nodes = prefixed(_filtered(self.graph.nodes(label), properties), var)
        columns = {c: F.col(c) for c in nodes.columns}
        condition = on(lambda name: self[name] if name.partition(".")[0] != var else columns.get(f"{var}__{name.partition('.')[2] or '_id'}", F.lit(None))) if on else F.lit(True)
        return replace(self, df=self.df.join(nodes, condition, "left"), last=var, labels={**self.labels, var: _names(label)})

    def label_as(self, name: str, var: str, label: str) -> Pattern:
        """A boolean column: whether a bound node has the label, for use within conditions; null for a null node."""
        if not self._may_be(var, [label]):
            return self.with_columns(**{name: F.when(self[var].isNotNull(), F.lit(False))})
        own = self.graph.nodes(label).select(F.col("_id").alias("_own")).distinct().withColumn("_has", F.lit(True))
        df = self.df.join(own, F.col(f"{var}___id") == F.col("_own"), "left")
        return replace(self, df=df.withColumn(name, F.when(F.col(f"{var}___id").isNotNull(), F.coalesce("_has", F.lit(False)))).drop("_own", "_has"))

    def exists(self, var: str, build: Callable[[Pattern], Pattern], negate: bool = False) -> Pattern:
        """Keeps bindings for which the subpattern has (or, negated, has no) match."""
        sub = self._sub(var, build).select("_start")
        return replace(self, df=self.df.join(sub, F.col(f"{var}___id") == F.col("_start"), "left_anti" if negate else "left_semi"))

    def exists_as(self, name: str, var: str, build: Callable[[Pattern], Pattern]) -> Pattern:
        """A boolean column: whether the subpattern has a match, for use within conditions."""
        return self._joined(name, var, self._sub(var, build).groupBy("_start").agg(F.lit(True).alias(name)), F.lit(False))

    def count_as(self, name: str, var: str, build: Callable[[Pattern], Pattern]) -> Pattern:
        """The number of the subpattern's matches."""
        return self._joined(name, var, self._sub(var, build).groupBy("_start").agg(F.count("*").alias(name)), F.lit(0))

    def collect_as(self, name: str, var: str, build: Callable[[Pattern], Pattern], value: Callable[[Pattern], Column]) -> Pattern:
        """A list of ``value`` over the subpattern's matches, sorted, as there is no order among them; empty if none."""
        ids = self.df.select(F.col(f"{var}___id")).distinct()
        sub = build(self._start(ids, var))
        lists = sub.df.groupBy(F.col(f"{var}___id").alias("_start")).agg(F.array_sort(F.collect_list(value(sub))).alias(name))
        return self._joined(name, var, lists, F.array())

    def _joined(self, name: str, var: str, values: DataFrame, default: Column) -> Pattern:
        df = self.df.join(values, F.col(f"{var}___id") == F.col("_start"), "left").drop("_start")
        return replace(self, df=df.withColumn(name, F.coalesce(name, default)))


def match(graph: Graph, label: str | Sequence[str], var: str, properties: Mapping | None = None) -> Pattern:
    """Begins a pattern with the nodes of a label."""
    return Pattern(graph, prefixed(_filtered(graph.nodes(label), properties), var), var, labels={var: _names(label)})


def optional_match(graph: Graph, label: str | Sequence[str], var: str, properties: Mapping | None = None, build: Callable[[Pattern], Pattern] | None = None) -> Pattern:
    """Begins a query with OPTIONAL MATCH: all matches of the pattern that ``build`` goes on with, or one row of nulls."""
    found = match(graph, label, var, properties)
    found = build(found) if build else found
    one = found.df.sparkSession.range(1).select(F.lit(True).alias("_one"))
    return replace(found, df=one.join(found.df, F.lit(True), "left").drop("_one"))


def unwind(df: DataFrame, values: Column, name: str) -> DataFrame:
    """A row for each element of a list; none for an empty or null list."""
    return df.withColumn(name, F.explode(values))


def union(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of all parts, which have equal column names; without repeats if ``distinct``."""
    for p in parts[1:]:
        if sorted(p.columns) != sorted(parts[0].columns):
            raise GraphError("the parts of a union have different columns", "INVALID_ARGUMENT")
    out = reduce(DataFrame.unionByName, parts)
    return out.distinct() if distinct else out


def ordered(df: DataFrame, *keys: tuple[str, bool], skip: int = 0, limit: int | None = None) -> DataFrame:
    """Sorted by (column, descending): nulls last ascending and first descending; then skip and limit."""
    df = df.orderBy(*[F.col(k).desc_nulls_first() if down else F.col(k).asc_nulls_last() for k, down in keys])
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)
