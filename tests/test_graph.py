"""One social graph in several physical forms gives the same rows."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar, search
from graphloom.operators import paths, update
from graphloom.operators.match import Pattern, match, ordered, union
from graphloom.plans import schema
from graphloom.sources.mapping import EdgeType, Graph, GraphError, NodeType, graph_from_mapping, mapping_of

USERS = [("u1", "Alice", "a@example.com", "MA", 30), ("u2", "Bob", None, "CA", 20), ("u3", "Cara", "c@example.com", "MA", 40), ("u4", "Dan", None, "NY", 21), ("u5", "Eve", None, "NY", 22), ("u6", "Finn", None, "MA", 23)]
FOLLOWS = [("e1", "u1", "u2"), ("e2", "u1", "u3"), ("e3", "u2", "u3")]


@pytest.fixture(scope="module", params=["own tables", "shared tables", "mapping"])
def graph(request, spark):
    users = spark.createDataFrame(USERS, "id string, name string, email string, state string, age long")
    follows = spark.createDataFrame(FOLLOWS, "k string, a string, b string")
    if request.param == "own tables":
        return Graph({"users": users, "follows": follows}, {"User": NodeType("users", "id")}, {"FOLLOWS": EdgeType("follows", "a", "b", "k", "User", "User")})
    if request.param == "shared tables":
        vertices = users.withColumn("type", F.lit("User")).unionByName(spark.createDataFrame([("d1", "Doc")], "id string, type string"), allowMissingColumns=True)
        edges = follows.withColumn("type", F.lit("FOLLOWS")).unionByName(spark.createDataFrame([("l1", "u1", "d1", "LIKES")], "k string, a string, b string, type string"))
        return Graph({"v": vertices, "e": edges}, {"User": NodeType("v", "id", "type", "User"), "Doc": NodeType("v", "id", "type", "Doc")}, {"FOLLOWS": EdgeType("e", "a", "b", "k", "User", "User", "type", "FOLLOWS")})
    mapping = {
        "physicalMapping": {
            "entities": {"User": {"style": "COLLECTION", "collectionName": "users"}},
            "relationships": {"FOLLOWS": {"style": "DEDICATED_COLLECTION", "edgeCollectionName": "follows", "domain": "User", "range": "User"}},
        }
    }
    edges = follows.select(F.col("k").alias("_key"), F.concat(F.lit("users/"), "a").alias("_from"), F.concat(F.lit("users/"), "b").alias("_to"))
    return graph_from_mapping(mapping, {"users": users.withColumn("_key", F.col("id")), "follows": edges})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hops(graph):
    p = match(graph, "User", "a").out("FOLLOWS", "User", "b")
    assert rows(p.select(a=p["a.name"], b=p["b.name"])) == [("Alice", "Bob"), ("Alice", "Cara"), ("Bob", "Cara")]
    q = match(graph, "User", "b").into("FOLLOWS", "User", "a")
    assert rows(q.select(a=q["a.name"], b=q["b.name"])) == rows(p.select(a=p["a.name"], b=p["b.name"]))
    r = match(graph, "User", "a").both("FOLLOWS", "User", "b")
    assert r.df.count() == 6


def test_two_hops_use_different_edges(graph):
    p = match(graph, "User", "a").both("FOLLOWS", "User", "b").both("FOLLOWS", "User", "c")
    assert p.where(p["a"] == p["c"]).df.count() == 0
    q = match(graph, "User", "a").both("FOLLOWS", "User", "b").match().both("FOLLOWS", "User", "c", edge="again")
    assert q.where(q["a"] == q["c"]).df.count() == 6


def test_optional_and_subqueries(graph):
    p = match(graph, "User", "a").optional("a", lambda q: q.out("FOLLOWS", "User", "b"))
    assert p.df.count() == 7
    assert rows(p.where(p["b"].isNull()).select(a=p["a.name"])) == [("Cara",), ("Dan",), ("Eve",), ("Finn",)]
    q = match(graph, "User", "a").count_as("n", "a", lambda q: q.out("FOLLOWS", None, "b")).collect_as("names", "a", lambda q: q.out("FOLLOWS", "User", "b"), lambda q: q["b.name"])
    assert rows(q.select(a=q["a.name"], n=F.col("n"), names=F.array_join("names", " ")))[:3] == [("Alice", 2, "Bob Cara"), ("Bob", 1, "Cara"), ("Cara", 0, "")]
    assert match(graph, "User", "a").exists("a", lambda q: q.out("FOLLOWS", None, "b"), negate=True).df.count() == 4


def test_variable_length_and_paths(graph):
    p = match(graph, "User", "a").hops("FOLLOWS", "User", "b", 0, None, path="p")
    assert rows(p.where(p["a.name"] == "Alice").select(b=p["b.name"], n=F.size("p.edges"))) == [("Alice", 0), ("Bob", 1), ("Cara", 1), ("Cara", 2)]
    ids = {r["name"]: r["_id"] for r in graph.nodes("User").collect()}
    pairs = graph.nodes("User").where("name = 'Alice'").select(F.col("_id").alias("source"), F.lit(ids["Cara"]).alias("target"))
    assert [r["hops"] for r in paths.shortest_paths(graph, "FOLLOWS", pairs).collect()] == [1]
    assert rows(paths.k_shortest_paths(graph, "FOLLOWS", pairs, 5, most=3).select("rank", "hops")) == [(1, 1), (2, 2)]
    none = graph.nodes("User").where("name = 'Dan'").select(F.col("_id").alias("source"), F.lit(ids["Cara"]).alias("target"))
    assert paths.shortest_paths(graph, "FOLLOWS", none).count() == 0


def test_properties(graph):
    assert match(graph, "User", "a", {"name": "aLICE"}).df.count() == 1
    assert match(graph, "User", "a", {"no_such": 1}).df.count() == 0
    p = match(graph, "User", "a")
    assert p.where(p["a.no_such"].isNull()).df.count() == 6
    assert rows(p.df.groupBy("a__state").agg(F.avg("a__age"))) == [("CA", 20.0), ("MA", 31.0), ("NY", 21.5)]
    assert [r[0] for r in ordered(p.select(e=p["a.email"]), ("e", False), limit=3).collect()] == ["a@example.com", "c@example.com", None]
    with pytest.raises(GraphError) as e:
        match(graph, "Nobody", "n")
    assert e.value.code == "MAPPING_NOT_FOUND"


def test_undirected_self_loop_comes_once(spark):
    n = spark.createDataFrame([(1,), (2,)], "id int")
    e = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    g = Graph({"n": n, "e": e}, {"N": NodeType("n", "id")}, {"E": EdgeType("e", "a", "b")})
    assert match(g, "N", "x").both("E", "N", "y").df.count() == 3


def test_updates(spark):
    users = spark.createDataFrame(USERS, "id string, name string, email string, state string, age long")
    follows = spark.createDataFrame(FOLLOWS, "k string, a string, b string")
    g = Graph({"users": users, "follows": follows}, {"User": NodeType("users", "id")}, {"FOLLOWS": EdgeType("follows", "a", "b", "k", "User", "User")})
    one = g.nodes("User").where("name = 'Alice'").select("_id")
    h = update.set_properties(g, "User", one, {"age": F.col("age") + 1, "state": F.lit("TX")})
    assert rows(h.nodes("User").where("name = 'Alice'").select("age", "state")) == [(31, "TX")]
    assert rows(g.nodes("User").where("name = 'Alice'").select("age", "state")) == [(30, "MA")]
    r = update.set_properties(g, "User", one, {"name": F.lit("A")}, replace_all=True)
    assert rows(r.nodes("User").where("id = 'u1'").select("name", "age")) == [("A", None)]
    d = update.delete_nodes(g, "User", one, detach=True)
    assert (d.nodes("User").count(), d.edges("FOLLOWS").count()) == (5, 1)
    assert update.delete_edges(g, "FOLLOWS", g.edges("FOLLOWS").where("_eid = 'e1'")).edges("FOLLOWS").count() == 2
    new = spark.createDataFrame([("u1",), ("u9",), ("u9",)], "id string")
    m = update.merge_nodes(g, "User", new, ["id"], {"name": F.lit("New")}, {"name": F.lit("Old")})
    assert rows(m.nodes("User").where("id in ('u1', 'u9')").select("id", "name")) == [("u1", "Old"), ("u9", "New")]
    assert update.merge_edges(g, "FOLLOWS", spark.createDataFrame([("u1", "u2"), ("u1", "u4")], "a string, b string")).edges("FOLLOWS").count() == 4
    with pytest.raises(GraphError):
        update.create_nodes(g, "User", spark.createDataFrame([(1,)], "no_such int"))


def test_embedded(spark):
    df = spark.createDataFrame([("u1", ("MA", 1), ["x", "y"]), ("u2", None, []), ("u3", ("NY", 2), None)], "id string, address struct<state: string, zip: int>, tags array<string>")
    g = Graph({"u": df}, {"User": NodeType("u", "id")}, {"HAS_ADDRESS": EdgeType("u", "id", "id", embedded="address"), "TAGGED": EdgeType("u", "id", "id", embedded="tags")})
    a = match(g, "User", "u").embedded("HAS_ADDRESS", "a")
    assert rows(a.select(u=a["u"], s=F.col("a__value.state"))) == [("u1", "MA"), ("u3", "NY")]
    assert match(g, "User", "u").embedded("HAS_ADDRESS", "a", optional=True).df.count() == 3
    assert match(g, "User", "u").embedded("TAGGED", "t").df.count() == 2
    assert g.edges("TAGGED").count() == 2


def test_unions(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(2, 1)], "y int, x int")
    assert union(a, b).count() == 2
    assert union(a, b, distinct=True).count() == 1
    with pytest.raises(GraphError):
        union(a, b.drop("x"))


def test_scalars(spark):
    df = spark.createDataFrame([("a.b\\E.c", [1, 2, 3], 7, -7, None)], "s string, xs array<int>, a long, b long, n long")
    got = df.select(
        scalar.split(F.col("s"), "."), scalar.last("xs"), scalar.tail(F.col("xs")), scalar.item(F.col("xs"), -1), scalar.item(F.col("xs"), 9), scalar.part(F.col("xs"), 1, 3),
        scalar.divide(F.col("b"), F.lit(2), True), scalar.divide(F.col("a"), F.lit(0), True), scalar.number_range(5, 1), scalar.number_range(5, 1, -2), scalar.matches(F.col("s"), "a"), scalar.xor(F.col("n") > 1, F.lit(True)), scalar.to_integer(F.lit("3.7")),
    ).first()
    assert list(got) == [["a", "b\\E", "c"], 3, [2, 3], 3, None, [2, 3], -3, None, [], [5, 3, 1], False, None, 3]


def test_search_and_schema(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "blue"), (3, None), (4, "")], "id int, text string")
    assert [r["id"] for r in search.ranked(search.bm25(docs, "id", "text", ["FISH", "blue"]), "id", 5).collect()] == [1, 2]
    assert search.fulltext(docs, "text", "blue,prefix:fi").count() == 1
    names = spark.createDataFrame([("Keanu Reeves",), ("Keanu",), (None,)], "value string")
    asked = spark.createDataFrame([("Keano Reeves",), ("reeves",), ("zzz",)], "mention string")
    assert {r["mention"]: (r["value"], round(r["score"], 3)) for r in search.resolve(asked, names).collect()} == {"Keano Reeves": ("Keanu Reeves", 0.825), "reeves": ("Keanu Reeves", 0.85)}
    assert schema.type_column(spark.createDataFrame([("A",), ("B",)], "type string")) == "type"
    assert schema.type_column(spark.createDataFrame([("a b",), ("B",)], "label string")) is None
    assert [schema.label_name(x) for x in ("users", "order_entries", "boxes", "class")] == ["User", "OrderEntry", "Box", "Class"]
    g = Graph({"docs": docs}, {"Doc": NodeType("docs", "id")}, {})
    cache = schema.SchemaCache()
    more = g.with_table("docs", docs.limit(2))
    assert [cache.change("g", x) for x in (g, g, more, g.with_table("docs", docs.drop("text")))] == ["no_cache", "unchanged", "stats_changed", "shape_changed"]
    assert Pattern(g, match(g, "Doc", "d").df, "d").df.count() == 4


def test_shortest_paths_have_no_bound_by_default(spark):
    edges = spark.createDataFrame([(i, i, i + 1) for i in range(12)], "k long, a long, b long")
    g = Graph({"edges": edges}, {}, {"NEXT": EdgeType("edges", "a", "b", "k")})
    pairs = spark.createDataFrame([(0, 12), (12, 0)], "source long, target long")
    assert [(r["target"], r["hops"]) for r in paths.shortest_paths(g, "NEXT", pairs).collect()] == [(12, 12)]
    assert paths.shortest_paths(g, "NEXT", pairs, most=11).count() == 0


def test_ends_must_fit(spark):
    from graphloom.sources.commerce import commerce_graph

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    g = commerce_graph(spark, "/root/testdata/sf0.001")
    for build in (
        lambda: match(g, "Supplier", "s").out("PLACED", "Order", "o"),
        lambda: match(g, "Part", "p").out("IN_REGION", "Region", "r"),
        lambda: match(g, "Customer", "c").out("PLACED", "Part", "p"),
        lambda: match(g, "Customer", "c").into("PLACED", "Order", "o"),
        lambda: match(g, "Customer", "c").hops("PLACED", "Order", "o", 1, 3),
        lambda: match(g, "Customer", "c").out("CUSTOMER_IN", None, "n").out("PLACED", "Order", "o"),
    ):
        with pytest.raises(GraphError) as e:
            build()
        assert e.value.code == "ENDPOINT_MISMATCH"
    # another label of the same table is the same node
    assert match(g, "User", "u").out("DID", "Click", "c").df.count() == g.nodes("Click").count()
    mixed = match(g, "Order", "o").out(["PLACED", "CONTAINS"], "Part", "p")  # PLACED does not leave an order
    assert mixed.df.count() == g.edges("CONTAINS").count()


def test_foreign_keys_take_one_edge(spark):
    a = spark.createDataFrame([(1, None), (2, 7)], "id int, ref int")
    b = spark.createDataFrame([(7,), (8,)], "id int")
    g = Graph({"a": a, "b": b}, {"A": NodeType("a", "id"), "B": NodeType("b", "id")}, {"R": EdgeType("a", "id", "ref", "id", "A", "B")})
    new = lambda *x: spark.createDataFrame(list(x), "id int, ref int")
    assert rows(update.create_edges(g, "R", new((1, 8), (2, 7), (9, 7), (None, 7))).table("a")) == [(1, 8), (2, 7)]
    for bad in (new((2, 8)), new((1, 7), (1, 8))):
        with pytest.raises(Exception, match="one edge of this type"):
            update.merge_edges(g, "R", bad).table("a").collect()
    d = update.delete_nodes(g, "B", spark.createDataFrame([(7,)], "_id int"), detach=True)
    assert rows(d.table("a")) == [(1, None), (2, None)] and rows(d.table("b")) == [(8,)]


def test_mapping_round_trip(spark, graph):
    again = mapping_of(graph)
    assert graph_from_mapping(again, {}).labels.keys() == graph.labels.keys()
    back = graph_from_mapping(again, {})
    assert {k: (t.from_label, t.to_label, t.type_value) for k, t in back.types.items()} == {k: (t.from_label, t.to_label, t.type_value) for k, t in graph.types.items()}


def test_inference(spark):
    from graphloom.plans import inference

    assert [schema.label_name(x) for x in ("movies", "status", "companies", "series", "statuses", "cookies")] == ["Movie", "Status", "Company", "Series", "Status", "Cookie"]
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    shared = spark.createDataFrame([(7, "Film"), (8, "Book"), (9, "Book")], "id long, type string")
    likes = spark.createDataFrame([(1, 7, "LIKES"), (2, 8, "READ"), (2, 9, "READ"), (1, None, "READ")], "a long, b long, relation string")
    knows = spark.createDataFrame([(1, 2), (5, 5)], "a long, b long")
    empty = people.limit(0)
    assert inference.storage_style({"people": people}, {"knows": knows}) == "pg"
    assert inference.storage_style({"things": shared}, {"likes": likes}) == "lpg"
    assert inference.storage_style({"people": people, "things": shared}, {"likes": likes}) == "hybrid"
    assert inference.storage_style({"people": empty}, {}) == "unknown"
    tables = {"people": people, "things": shared, "likes": likes, "knows": knows}
    g = inference.infer_graph(tables, {"people": "id", "things": "id"}, {"likes": ("a", "b"), "knows": ("a", "b")})
    assert set(g.labels) == {"Film", "Book"} | {schema.label_name("people")}
    assert {k: (t.from_label, t.to_label) for k, t in g.types.items()} == {"LIKES": ("People", "Film"), "READ": ("People", "Book"), "KNOWS": ("People", "People")}
    assert inference.edge_ends(g, knows.limit(0), "a", "b") == (None, None)
    assert inference.type_fields({"people": people}).count() == 0
