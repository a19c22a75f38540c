"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os
import random
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions import vector

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = sql.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=repr)


def folder_with(tmp_path, name, select):
    """The smallest tables with one of them replaced by a DuckDB select, and a connection that has it."""
    for file in os.listdir(FOLDER):
        if file != f"{name}.parquet":
            shutil.copy(f"{FOLDER}/{file}", tmp_path / file)
    con = duckdb.connect()
    con.execute(f"COPY ({select}) TO '{tmp_path}/{name}.parquet'")
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return str(tmp_path), con


def test_near_point_ties_of_rounded_metres(spark, tmp_path):
    """The last places go by the rounded distance and then by id, however many customers are in one place."""
    copies = f"SELECT c_custkey + 150 * i AS c_custkey, c_name, c_nationkey, (round(9000.37 - 40 * i, 2))::DOUBLE AS c_acctbal, c_mktsegment FROM '{FOLDER}/customer.parquet', range(200) t(i)"
    folder, con = folder_with(tmp_path, "customer", copies)
    got = [(r["id"], r["metres"]) for r in queries.QUERIES["near_point"](spark, folder).collect()]
    assert got == con.execute(queries.ORACLE_SQL["near_point"]).fetchall()


def test_cosine_nearest_ties_of_rounded_scores(spark, tmp_path, monkeypatch):
    """Vectors that differ in the seventh digit are ties, in whichever block they lie."""
    monkeypatch.setattr(vector, "BLOCK", 100)
    monkeypatch.setattr(vector, "QUERIES", 3)
    turned = "list_transform(embedding, lambda x, j: (x * (1 + 4e-5 * sin(j * (i + 1))))::FLOAT)"
    folder, con = folder_with(tmp_path, "embeddings", f"SELECT vec_id + 500 * i AS vec_id, {turned} AS embedding, label FROM '{FOLDER}/embeddings.parquet', range(9) t(i) WHERE vec_id < 500")
    got = sorted(tuple(r) for r in queries.QUERIES["cosine_nearest"](spark, folder).collect())
    assert got == sorted(con.execute(queries.ORACLE_SQL["cosine_nearest"]).fetchall())


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_in_blocks(spark, monkeypatch, metric):
    """Every query against all vectors: nulls, zeros, gaps, other lengths, copies, text ids, blocks of a few rows."""
    monkeypatch.setattr(vector, "BLOCK", 7)
    monkeypatch.setattr(vector, "QUERIES", 2)
    draw = random.Random(5)
    rows = [(f"v{i:02}", [float(draw.randint(-2, 2)) for _ in range(3)]) for i in range(40)]
    rows += [("n1", None), ("n2", [1.0, None, 2.0]), ("z", [0.0, 0.0, 0.0]), ("s1", [1.0, 2.0]), ("s2", [2.0, 4.0]), ("e", []), (None, [1.0, 2.0, 3.0])]
    rows += [(f"c{i}", [1.0, 2.0, -1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    asked = [k for k, _ in rows if k and (k[1:] in ("03", "11", "4", "8") or k in ("n1", "n2", "z", "s1", "e"))]
    got = {}
    for r in vector.nearest(df.where(F.col("id").isin(asked)), df, "id", "v", 4, metric).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], None if r["score"] is None else round(r["score"], 9))

    def score(a, b):
        if a is None or b is None or None in a + b or len(a) != len(b):
            return None
        if metric == "l2":
            return round(math.dist(a, b), 9)
        norms = math.hypot(*a) * math.hypot(*b)
        return round(sum(x * y for x, y in zip(a, b)) / norms, 9) if norms else None

    of = dict(rows)
    for k in asked:
        all_ = [(x, score(of[k], of[x])) for x, _ in rows if x and x != k]
        all_.sort(key=lambda p: (p[1] is None, (-p[1] if metric == "cosine" else p[1]) if p[1] is not None else 0, p[0]))
        best = [got[k][i + 1] for i in range(4)]
        assert [s for _, s in best] == [s for _, s in all_[:4]]
        assert all(score(of[k], of[x]) == s for x, s in best)
        assert best == sorted(best, key=lambda p: all_.index(p)) or metric == "cosine"
