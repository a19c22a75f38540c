"""What tables hold: property profiles, type columns, graph statistics, fingerprints and physical advice."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.mapping import Graph

# Texts that stand for a missing value, and names of columns that may tell types apart.
SENTINELS = ("NULL", "NONE", "NIL", "N/A", "NA", "UNKNOWN", "TBD", "TBA", "#N/A", "(NULL)")
SENTINEL_SHARE, NUMERIC_SHARE = 0.02, 0.8
FIRST_TIER = ("type", "_type", "entityType")
SECOND_TIER = ("label", "labels", "kind")

#: Nouns that end in "ie" in the singular, and those whose singular ends in "ies".
IN_IE = ("movie", "cookie", "calorie", "zombie", "selfie", "rookie", "genie", "pie", "tie", "lie")
UNCHANGED = ("series", "species")


def profile(df: DataFrame) -> DataFrame:
    """(property, kind, rows, filled, different, sentinels, numeric_like) of each atomic column, in one pass.

    ``different`` is an estimate.  ``sentinels`` counts texts that stand for a missing value, where they are at least
    SENTINEL_SHARE of the filled ones; numeric_like is whether NUMERIC_SHARE of the other ones read as numbers.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")}
    parts = []
    for name in kinds:
        c = F.col(name)
        s = c.cast("string")
        parts += [
            F.count(c).alias(f"{name}|filled"),
            F.approx_count_distinct(c).alias(f"{name}|different"),
            F.count_if(F.upper(F.trim(s)).isin(*SENTINELS)).alias(f"{name}|sentinels"),
            F.count_if(s.try_cast("double").isNotNull()).alias(f"{name}|numeric"),
        ]
    one = df.agg(F.count("*").alias("_rows"), *parts)
    def numeric_like(n: str) -> Column:
        rest = F.col(f"`{n}|filled`") - F.col(f"`{n}|sentinels`")
        return (rest > 0) & (F.col(f"`{n}|numeric`") >= NUMERIC_SHARE * rest)

    def sentinels(n: str) -> Column:
        found = F.col(f"`{n}|sentinels`")
        return F.when(found >= F.greatest(F.lit(1), F.floor(SENTINEL_SHARE * F.col(f"`{n}|filled`"))), found).otherwise(0)

    rows = [
        F.struct(
            F.lit(n).alias("property"), F.lit(k).alias("kind"), F.col("_rows").alias("rows"), F.col(f"`{n}|filled`").alias("filled"), F.col(f"`{n}|different`").alias("different"),
            sentinels(n).alias("sentinels"), numeric_like(n).alias("numeric_like"),
        )
        for n, k in kinds.items()
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def type_column(df: DataFrame) -> str | None:
    """The column that tells node types apart, if one does: a first-tier name, or a second-tier name with few, class-like values."""
    for name in FIRST_TIER:
        if name in df.columns and df.select(name).where(F.col(name).isNotNull()).distinct().limit(2).count() > 1:
            return name
    for name in SECOND_TIER:
        if name in df.columns and df.schema[name].dataType.typeName() == "string":
            rows, different, odd = df.agg(F.count(name), F.approx_count_distinct(name), F.count_if(~F.col(name).rlike(r"^[A-Za-z][A-Za-z0-9_]{0,39}$"))).first()
            if 1 < different <= max(50, rows / 2) and not odd:
                return name
    return None


def graph_statistics(graph: Graph) -> DataFrame:
    """(type, edges, sources, targets, out_degree, in_degree, cardinality) of each edge type; a mean degree over 1.5 counts as many."""
    parts = []
    for name in sorted(graph.types):
        if graph.types[name].embedded:
            continue
        e = graph.edges(name).agg(F.lit(name).alias("type"), F.count("*").alias("edges"), F.count_distinct("_src").alias("sources"), F.count_distinct("_dst").alias("targets"))
        parts.append(e)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("out_degree", F.try_divide("edges", "sources")).withColumn("in_degree", F.try_divide("edges", "targets"))
    many_out, many_in = F.col("out_degree") > 1.5, F.col("in_degree") > 1.5
    kind = F.when(many_out & many_in, "N:M").when(many_out, "1:N").when(many_in, "N:1").otherwise("1:1")
    return out.withColumn("cardinality", kind)


def label_counts(graph: Graph) -> DataFrame:
    """(label, nodes) of each label."""
    parts = [graph.nodes(k).agg(F.lit(k).alias("label"), F.count("*").alias("nodes")) for k in sorted(graph.labels)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shape_fingerprint(graph: Graph) -> str:
    """A digest of the tables' schemas."""
    text = "\n".join(f"{n} {df.schema.json()}" for n, df in sorted(graph.tables.items()))
    return hashlib.sha256(text.encode()).hexdigest()


def full_fingerprint(graph: Graph) -> str:
    """A digest of the schemas and of each table's rows, counted and summed by hash."""
    parts = [shape_fingerprint(graph)]
    for name, df in sorted(graph.tables.items()):
        flat = [c for c in df.columns if df.schema[c].dataType.typeName() != "map"]
        row = df.agg(F.count("*"), F.sum(F.xxhash64(*flat).cast("decimal(38,0)"))).first()
        parts.append(f"{name} {row[0]} {row[1]}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


@dataclass
class SchemaCache:
    """Remembers fingerprints and says what changed: no_cache, unchanged, stats_changed or shape_changed."""

    seen: dict[str, tuple[str, str]] = field(default_factory=dict)

    def change(self, name: str, graph: Graph) -> str:
        now = (shape_fingerprint(graph), full_fingerprint(graph))
        before = self.seen.get(name)
        self.seen[name] = now
        if before is None:
            return "no_cache"
        return "shape_changed" if before[0] != now[0] else "stats_changed" if before[1] != now[1] else "unchanged"


def label_name(table: str) -> str:
    """A label for a table's name: singular, in PascalCase."""
    words = [w for w in re.split(r"[_\-\s]+", table) if w]
    if words:
        w, low = words[-1], words[-1].lower()
        if low in UNCHANGED or low.endswith(("ss", "us", "is")) or not low.endswith("s"):
            pass
        elif low.endswith("ies") and low[:-1] not in IN_IE:
            words[-1] = w[:-3] + "y"
        else:
            words[-1] = w[:-2] if low.endswith(("sses", "xes", "zes", "ches", "shes", "tuses")) else w[:-1]
    return "".join(w[:1].upper() + w[1:] for w in words)


def advice(graph: Graph, rows: Mapping[str, int]) -> list[str]:
    """Layout advice from row counts: partition shared tables by their type column, bucket large edge tables by their source."""
    out = []
    for t in sorted({(x.table, x.type_field) for x in [*graph.labels.values(), *graph.types.values()] if x.type_field}):
        out.append(f"partition {t[0]} by {t[1]}")
    for name, e in sorted(graph.types.items()):
        if not e.embedded and rows.get(e.table, 0) > 10_000_000:
            out.append(f"bucket {e.table} by {e.source} for {name}")
    return out


def tenant_view(graph: Graph, column: str, value) -> Graph:
    """The graph of one tenant: every table with the tenant column is filtered by it; tables without it are global."""
    tables = {n: df.where(F.col(column) == value) if column in df.columns else df for n, df in graph.tables.items()}
    return Graph(tables, graph.labels, graph.types)
