"""Every graph operator as a query over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import document, geo, scalar, search, vector
from graphloom.operators import paths, update
from graphloom.operators.match import Pattern, match, ordered, union, unwind
from graphloom.operators.match import optional_match as begin_optional
from graphloom.plans import inference, schema
from graphloom.sources.commerce import commerce_graph
from graphloom.sources.mapping import EdgeType, Graph, NodeType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the graph under its name."""

    def register(f: Callable[[Graph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(commerce_graph(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def big(x: Column) -> Column:
    return x.cast("bigint")


def r4(x: Column) -> Column:
    return F.round(x, 4)


# ---------------------------------------------------------------- scans and filters


@query("SELECT c_mktsegment AS segment, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1")
def orders_by_segment(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("PLACED", "Order", "o")
    return p.where(p["o.o_totalprice"] > 100000).df.groupBy(F.col("c__c_mktsegment").alias("segment")).agg(F.count("*").alias("n_orders"))


@query("SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
def scan_filter(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c")
    return p.where((p["c.c_acctbal"] > 5000) & (p["c.c_mktsegment"] != "BUILDING")).select(name=p["c.c_name"], balance=p["c.c_acctbal"])


@query("SELECT event_id AS id, value FROM events WHERE event_type = 'purchase'")
def label_scan(g: Graph) -> DataFrame:
    p = match(g, "Purchase", "e")
    return p.select(id=p["e"], value=p["e.value"])


@query("SELECT event_id AS id FROM events WHERE event_type = 'click'")
def multi_label_scan(g: Graph) -> DataFrame:
    p = match(g, ["Event", "Click"], "e")
    return p.select(id=p["e"])


@query("SELECT 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
def unlabelled_scan(g: Graph) -> DataFrame:
    small = Graph(g.tables, {k: g.labels[k] for k in ("Nation", "Region")}, {})
    return small.all_nodes().groupBy(F.col("_label").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE lower(n_name) = lower((SELECT min(n_name) FROM nation))")
def inline_properties_ignore_case(g: Graph) -> DataFrame:
    first = g.nodes("Nation").agg(F.min("n_name").alias("m"))
    p = match(g, "Nation", "n")
    df = p.df.join(F.broadcast(first), F.lower("n__n_name") == F.lower("m"))
    return df.select(F.col("n___id").alias("id"), F.col("n__n_name").alias("name"))


@query("SELECT count(*) AS n FROM orders WHERE lower(o_orderstatus) = 'f'")
def inline_property_literal(g: Graph) -> DataFrame:
    return match(g, "Order", "o", {"o_orderstatus": "f"}).df.agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id FROM part WHERE p_type LIKE 'S%' AND p_brand LIKE '%3' AND contains(p_type, 'A')")
def string_predicates(g: Graph) -> DataFrame:
    p = match(g, "Part", "p")
    return p.where(p["p.p_type"].startswith("S") & p["p.p_brand"].endswith("3") & p["p.p_type"].contains("A")).select(id=p["p"])


@query("SELECT s_suppkey AS id FROM supplier WHERE regexp_full_match(s_name, '.*[05]')")
def regex_match(g: Graph) -> DataFrame:
    p = match(g, "Supplier", "s")
    return p.where(scalar.matches(p["s.s_name"], ".*[05]")).select(id=p["s"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'P') AND NOT (o_totalprice < 50000 OR o_totalprice > 200000)")
def in_list_and_booleans(g: Graph) -> DataFrame:
    p = match(g, "Order", "o")
    price = p["o.o_totalprice"]
    return p.where(p["o.o_orderstatus"].isin("F", "P") & ~((price < 50000) | (price > 200000))).select(id=p["o"])


@query("SELECT o_orderkey AS id FROM orders WHERE (o_totalprice > 100000) <> (o_orderstatus = 'F')")
def xor_predicate(g: Graph) -> DataFrame:
    p = match(g, "Order", "o")
    return p.where(scalar.xor(p["o.o_totalprice"] > 100000, p["o.o_orderstatus"] == "F")).select(id=p["o"])


@query("SELECT doc_id AS id, toxic IS NULL AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR toxic = 1")
def null_checks(g: Graph) -> DataFrame:
    p = match(g, "Document", "d").optional("d", lambda q: q.out("HAS_LABEL", "Label", "l"))
    return p.where(p["l.toxic"].isNull() | (p["l.toxic"] == 1)).select(id=p["d"], unlabelled=p["l.toxic"].isNull())


@query("SELECT count(*) AS n FROM customer WHERE NULL IS NULL")
def missing_property_is_null(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c")
    return p.where(p["c.no_such_property"].isNull()).df.agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- expands


@query("SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def one_hop_in(g: Graph) -> DataFrame:
    p = match(g, "Order", "o", {"o_orderstatus": "P"}).into("PLACED", "Customer", "c")
    return p.select(o=p["o"], name=p["c.c_name"])


@query("""WITH e AS (SELECT a.conv_id, a.turn AS s, b.turn AS d FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, count(*) AS n FROM (SELECT conv_id, s AS turn FROM e UNION ALL SELECT conv_id, d FROM e) GROUP BY 1, 2""")
def one_hop_any(g: Graph) -> DataFrame:
    p = match(g, "Message", "m").both("NEXT", "Message", "k")
    return p.df.groupBy(F.col("m__conv_id").alias("conv_id"), F.col("m__turn").alias("turn")).agg(F.count("*").alias("n"))


@query("""SELECT r_name AS region, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def three_hop_region(g: Graph) -> DataFrame:
    p = match(g, "Order", "o").into("PLACED", "Customer", "c").out("CUSTOMER_IN", "Nation", "n").out("IN_REGION", "Region", "r")
    return p.df.groupBy(F.col("r__r_name").alias("region")).agg(F.count("*").alias("orders"), F.round(F.sum("o__o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1")
def hop_without_end_label(g: Graph) -> DataFrame:
    p = match(g, "Order", "o").into("PLACED", None, "c")
    return p.df.groupBy(F.col("c___id").alias("customer")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS u, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1")
def generic_type_edge(g: Graph) -> DataFrame:
    p = match(g, "User", "u").out("DID_PURCHASE", "Event", "e")
    return p.df.groupBy(F.col("u___id").alias("u")).agg(F.count("*").alias("n"), F.round(F.sum("e__value"), 3).alias("total"))


@query("SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def several_edge_types(g: Graph) -> DataFrame:
    p = match(g, "User", "u").out(["DID_CLICK", "DID_VIEW"], None, "e", edge="r")
    return p.df.groupBy(F.lower(F.replace(F.col("r___type"), F.lit("DID_"), F.lit(""))).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def embedded_object(g: Graph) -> DataFrame:
    held = g.table("events").withColumn("detail", F.from_json("props", "k bigint"))
    h = Graph({**g.tables, "events": held}, g.labels, {**g.types, "HAS_PROPS": EdgeType("events", "event_id", "event_id", embedded="detail")})
    p = match(h, "Event", "e").embedded("HAS_PROPS", "d")
    return p.where(F.col("d__value.k") > 50).select(id=p["e"], k=F.col("d__value.k"))


@query("SELECT p_brand AS brand, w AS word, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1, 2")
def embedded_array(g: Graph) -> DataFrame:
    held = g.table("part").withColumn("words", F.split("p_type", " "))
    h = Graph({**g.tables, "part": held}, g.labels, {**g.types, "HAS_WORD": EdgeType("part", "p_partkey", "p_partkey", embedded="words")})
    p = match(h, "Part", "p").embedded("HAS_WORD", "w")
    return p.df.groupBy(F.col("p__p_brand").alias("brand"), F.col("w__value").alias("word")).agg(F.count("*").alias("n"))


@query("SELECT c.n_name AS customer_nation, count(*) AS n FROM customer JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON s_nationkey = c.n_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 9000 GROUP BY 1")
def comma_pattern_join(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("CUSTOMER_IN", "Nation", "n").into("SUPPLIER_IN", "Supplier", "s")
    p = p.where((p["c.c_acctbal"] > 9000) & (p["s.s_acctbal"] > 9000))
    return p.df.groupBy(F.col("n__n_name").alias("customer_nation")).agg(F.count("*").alias("n"))


@query("SELECT a.r_name AS a, b.n_name AS b FROM region a, nation b WHERE a.r_regionkey > b.n_regionkey")
def cartesian_filter(g: Graph) -> DataFrame:
    p = match(g, "Region", "a").node("Nation", "b")
    return p.where(p["a"] > p["b.n_regionkey"]).select(a=p["a.r_name"], b=p["b.n_name"])


@query("""SELECT c_custkey AS customer, s_suppkey AS supplier, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = c_nationkey GROUP BY 1, 2""")
def cycle_same_nation(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("CUSTOMER_IN", "Nation", "n").at("c").out("PLACED", "Order", "o").out("FULFILLED_BY", "Supplier", "s").out("SUPPLIER_IN", "Nation", "n")
    return p.df.groupBy(F.col("c___id").alias("customer"), F.col("s___id").alias("supplier")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT *, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS e FROM lineitem)
SELECT a.l_orderkey AS o, count(*) AS pairs FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.e <> b.e JOIN part pa ON a.l_partkey = pa.p_partkey JOIN part pb ON b.l_partkey = pb.p_partkey GROUP BY 1""")
def edge_uniqueness(g: Graph) -> DataFrame:
    p = match(g, "Part", "a").into("CONTAINS", "Order", "o").out("CONTAINS", "Part", "b")
    return p.df.groupBy(F.col("o___id").alias("o")).agg(F.count("*").alias("pairs"))


@query("SELECT d.doc_id AS id, l.quality AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1")
def optional_match(g: Graph) -> DataFrame:
    def good(q: Pattern) -> Pattern:
        q = q.out("HAS_LABEL", "Label", "l")
        return q.where(q["l.quality"] == 1)

    p = match(g, "Document", "d").optional("d", good)
    return p.select(id=p["d"], quality=p["l.quality"])


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def pattern_predicate(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").exists("c", lambda q: q.out("PLACED", "Order", "o", properties={"o_orderstatus": "P"}))
    return p.select(id=p["c"])


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_pattern_predicate(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").exists("c", lambda q: q.out("PLACED", "Order", "o", properties={"o_orderstatus": "P"}), negate=True)
    return p.select(id=p["c"])


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def exists_within_or(g: Graph) -> DataFrame:
    def dear(q: Pattern) -> Pattern:
        q = q.out("PLACED", "Order", "o")
        return q.where(q["o.o_totalprice"] > 200000)

    p = match(g, "Customer", "c").exists_as("dear", "c", dear)
    return p.where((p["c.c_acctbal"] > 9000) | F.col("dear")).select(id=p["c"])


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS lines FROM customer")
def count_subquery(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").count_as("lines", "c", lambda q: q.out("PLACED", "Order", "o").out("CONTAINS", None, "p"))
    return p.select(id=p["c"], lines=F.col("lines"))


@query("SELECT n_name AS nation, coalesce((SELECT string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers FROM nation")
def pattern_comprehension(g: Graph) -> DataFrame:
    p = match(g, "Nation", "n").collect_as("s", "n", lambda q: q.into("SUPPLIER_IN", "Supplier", "s"), lambda q: q["s"])
    return p.select(nation=p["n.n_name"], suppliers=F.array_join("s", ","))


# ---------------------------------------------------------------- aggregation, pipelines, rows

ORDERS = "FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT count(*) AS n, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high {ORDERS}")
def aggregate_global(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("PLACED", "Order", "o")
    price = F.col("o__o_totalprice")
    return p.df.agg(F.count("*").alias("n"), F.count_distinct("c___id").alias("customers"), F.round(F.sum(price), 2).alias("total"), r4(F.avg(price)).alias("mean"), F.min(price).alias("low"), F.max(price).alias("high"))


@query(f"SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean {ORDERS} GROUP BY 1, 2")
def aggregate_grouped(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("PLACED", "Order", "o")
    return p.df.groupBy(F.col("c__c_mktsegment").alias("segment"), F.col("o__o_orderstatus").alias("status")).agg(F.count("*").alias("n"), r4(F.avg("o__o_totalprice")).alias("mean"))


@query("SELECT c_nationkey AS nation, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(*) + 1 AS more FROM customer GROUP BY 1")
def collect_distinct(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c")
    return p.df.groupBy(F.col("c__c_nationkey").alias("nation")).agg(F.array_join(scalar.distinct_list(F.col("c__c_mktsegment")), ",").alias("segments"), (F.count("*") + 1).alias("more"))


@query("SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def with_having(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("PLACED", "Order", "o")
    return p.df.groupBy(F.col("c___id").alias("c")).agg(F.count("*").alias("n")).where("n > 15")


@query("SELECT DISTINCT p_brand AS brand, p_size % 5 AS size FROM part")
def with_distinct(g: Graph) -> DataFrame:
    p = match(g, "Part", "p")
    return p.select(brand=p["p.p_brand"], size=p["p.p_size"] % 5).distinct()


@query("""WITH t AS (SELECT o_custkey AS c, sum(o_totalprice) AS total FROM orders GROUP BY 1 ORDER BY total DESC, c LIMIT 20)
SELECT n_name AS nation, count(*) AS n FROM t JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def with_order_limit_then_match(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("PLACED", "Order", "o")
    top = ordered(p.df.groupBy("c___id").agg(F.sum("o__o_totalprice").alias("total")), ("total", True), ("c___id", False), limit=20)
    q = Pattern(g, top, "c").out("CUSTOMER_IN", "Nation", "n")
    return q.df.groupBy(F.col("n__n_name").alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def order_skip_limit(g: Graph) -> DataFrame:
    p = match(g, "Order", "o")
    return ordered(p.select(id=p["o"], price=p["o.o_totalprice"]), ("price", True), ("id", False), skip=10, limit=25)


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def union_all(g: Graph) -> DataFrame:
    n, r = match(g, "Nation", "n"), match(g, "Region", "r")
    regions = r.select(name=r["r.r_name"])
    return union(n.select(name=n["n.n_name"]), regions, regions)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(g: Graph) -> DataFrame:
    c, s = match(g, "Customer", "c"), match(g, "Supplier", "s")
    return union(c.select(nation=c["c.c_nationkey"]), s.select(nation=s["s.s_nationkey"]), distinct=True)


@query("SELECT x, c_name AS name FROM (SELECT unnest([1, 5, 7, -1]) AS x) JOIN customer ON c_custkey = x")
def unwind_parameter(g: Graph) -> DataFrame:
    ids = unwind(g.tables["region"].sparkSession.range(1), F.array(*map(F.lit, (1, 5, 7, -1))), "x")
    nodes = match(g, "Customer", "c").df
    return nodes.join(F.broadcast(ids), F.col("c___id") == F.col("x")).select("x", F.col("c__c_name").alias("name"))


# ---------------------------------------------------------------- expressions


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state,
CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders""")
def case_expressions(g: Graph) -> DataFrame:
    p = match(g, "Order", "o")
    s, t = p["o.o_orderstatus"], p["o.o_totalprice"]
    return p.select(id=p["o"], state=F.when(s == "F", "done").when(s == "O", "open").otherwise("other"), band=F.when(t > 200000, "high").when(t > 100000, "mid").otherwise("low"))


@query("""SELECT s_suppkey AS id, round(abs(s_acctbal), 2) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, sign(s_acctbal) AS s, round(sqrt(abs(s_acctbal)), 4) AS q,
round(ln(abs(s_acctbal) + 1), 4) AS l, round(log10(abs(s_acctbal) + 1), 4) AS g, (s_suppkey // 7) AS whole, s_suppkey % 7 AS rest, round(pow(s_suppkey, 2), 0) AS p, round(pi(), 6) AS pi, round(exp(1), 6) AS e FROM supplier""")
def math_functions(g: Graph) -> DataFrame:
    p = match(g, "Supplier", "s")
    b, k = p["s.s_acctbal"], p["s"]
    return p.select(
        id=k, a=F.round(F.abs(b), 2), c=F.ceil(b).cast("double"), f=F.floor(b).cast("double"), s=F.signum(b).cast("tinyint"), q=r4(F.sqrt(F.abs(b))), l=r4(F.ln(F.abs(b) + 1)), g=r4(F.log10(F.abs(b) + 1)),
        whole=scalar.divide(k, F.lit(7), True), rest=k % 7, p=F.round(F.pow(k, F.lit(2)), 0), pi=F.round(scalar.pi(), 6), e=F.round(scalar.e(), 6),
    )


@query("""SELECT p_partkey AS id, upper(p_brand) AS u, lower(p_brand) AS l, substring(p_name, 2, 3) AS s, left(p_name, 2) AS a, right(p_name, 2) AS b, replace(p_name, 'a', 'A') AS r,
reverse(p_name) AS v, trim('  ' || p_name || ' ') AS t, length(p_name) AS n, string_split(p_type, ' ')[1] AS w FROM part""")
def string_functions(g: Graph) -> DataFrame:
    p = match(g, "Part", "p")
    n = p["p.p_name"]
    return p.select(
        id=p["p"], u=F.upper(p["p.p_brand"]), l=F.lower(p["p.p_brand"]), s=scalar.substring(n, 1, 3), a=F.left(n, F.lit(2)), b=F.right(n, F.lit(2)), r=F.replace(n, F.lit("a"), F.lit("A")),
        v=F.reverse(n), t=F.trim(F.concat(F.lit("  "), n, F.lit(" "))), n=big(F.length(n)), w=scalar.head(scalar.split(p["p.p_type"], " ")),
    )


@query("""SELECT n_nationkey AS id, array_to_string(range(0, n_nationkey + 1, 2), ',') AS evens, n_nationkey // 2 + 1 AS n, (n_nationkey // 2) * 2 AS last,
array_to_string(list_transform(list_filter(range(0, n_nationkey + 1, 2), lambda x: x % 4 = 0), lambda x: x * x), ',') AS squares FROM nation""")
def list_functions(g: Graph) -> DataFrame:
    p = match(g, "Nation", "n")
    k = p["n"].cast("bigint")
    evens = scalar.number_range(F.lit(0).cast("bigint"), k, 2)
    squares = scalar.list_of(evens, lambda x: x % 4 == 0, lambda x: x * x)
    text = lambda xs: F.array_join(xs.cast("array<string>"), ",")
    return p.select(id=p["n"], evens=text(evens), n=F.size(evens), last=scalar.last(evens), squares=text(squares))


@query("""WITH s AS (SELECT o_custkey AS c, list(o_totalprice) AS l FROM orders GROUP BY 1)
SELECT c, len(list_filter(l, lambda x: x > 1000)) = len(l) AS every, len(list_filter(l, lambda x: x > 200000)) > 0 AS some, len(list_filter(l, lambda x: x > 300000)) = 0 AS nothing, len(list_filter(l, lambda x: x > 150000)) = 1 AS single FROM s""")
def quantifiers(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("PLACED", "Order", "o")
    df = p.df.groupBy(F.col("c___id").alias("c")).agg(F.collect_list("o__o_totalprice").alias("l"))
    xs = F.col("l")
    return df.select("c", scalar.every(xs, lambda x: x > 1000).alias("every"), scalar.some(xs, lambda x: x > 200000).alias("some"), scalar.none(xs, lambda x: x > 300000).alias("nothing"), scalar.single(xs, lambda x: x > 150000).alias("single"))


@query("""SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, CAST(trunc(l_quantity * 1.37) AS BIGINT) AS i, CAST(l_orderkey AS VARCHAR) AS t, TRY_CAST('12.5' AS DOUBLE) AS f, TRY_CAST('x' AS DOUBLE) AS none, TRY_CAST('true' AS BOOLEAN) AS b FROM lineitem""")
def type_conversion(g: Graph) -> DataFrame:
    df = g.edges("CONTAINS")
    return df.select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), scalar.to_integer(F.col("l_quantity") * 1.37).alias("i"),
        scalar.to_string(F.col("l_orderkey")).alias("t"), scalar.to_float(F.lit("12.5")).alias("f"), scalar.to_float(F.lit("x")).alias("none"), scalar.to_boolean(F.lit("true")).alias("b"),
    )


# ---------------------------------------------------------------- paths

STEPS = "SELECT a.conv_id, a.turn AS s, b.turn AS d FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


@query(f"""WITH RECURSIVE e AS ({STEPS}), w AS (SELECT conv_id, s, d, 1 AS n FROM e UNION ALL SELECT w.conv_id, w.s, e.d, n + 1 FROM w JOIN e ON w.conv_id = e.conv_id AND w.d = e.s WHERE n < 3)
SELECT n AS hops, count(*) AS paths FROM w GROUP BY 1""")
def variable_length(g: Graph) -> DataFrame:
    p = match(g, "Message", "a").hops("NEXT", "Message", "b", 1, 3, path="p")
    return p.df.groupBy(F.size("p.edges").alias("hops")).agg(F.count("*").alias("paths"))


@query(f"""WITH e AS ({STEPS}) SELECT (SELECT count(*) FROM conversations) + (SELECT count(*) FROM e) + (SELECT count(*) FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.d = b.s) AS paths""")
def variable_length_from_zero(g: Graph) -> DataFrame:
    return match(g, "Message", "a").hops("NEXT", "Message", "b", 0, 2).df.agg(F.count("*").alias("paths"))


@query("SELECT c_custkey AS c, o_orderkey AS o, 2 AS nodes, 1 AS length FROM orders JOIN customer ON o_custkey = c_custkey")
def named_path(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("PLACED", "Order", "o", edge="r").named_path("p", ["c", "o"], ["r"])
    return p.select(c=p["c"], o=p["o"], nodes=F.size("p.nodes"), length=F.size("p.edges"))


@query("SELECT conv_id, max(turn) AS hops FROM conversations GROUP BY 1 HAVING max(turn) >= 1")
def shortest_path_first_to_last(g: Graph) -> DataFrame:
    ends = g.table("conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).where("last >= 1")
    kind = g.table("conversations").schema["turn"].dataType
    pairs = ends.select(F.struct("conv_id", F.lit(0).cast(kind).alias("turn")).alias("source"), F.struct("conv_id", F.col("last").cast(kind).alias("turn")).alias("target"))
    out = paths.shortest_paths(g, "NEXT", pairs)
    return out.select(F.col("source.conv_id").alias("conv_id"), F.col("hops").cast(kind).alias("hops"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS s, s_nationkey AS d FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_acctbal > 9500 AND s_acctbal > 9000),
w AS (SELECT s AS source, d AS here, [s, d] AS nodes, 1 AS hops FROM e WHERE s <> d UNION ALL SELECT source, d, list_append(nodes, d), hops + 1 FROM w JOIN e ON w.here = e.s WHERE NOT list_contains(nodes, d) AND hops < 3 AND w.here <> (SELECT max(d) FROM e))
SELECT source, rank, hops FROM (SELECT source, hops, row_number() OVER (PARTITION BY source ORDER BY hops, nodes) AS rank FROM w WHERE here = (SELECT max(d) FROM e)) WHERE rank <= 4""")
def k_shortest(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c").out("PLACED", "Order", "o").out("FULFILLED_BY", "Supplier", "s")
    trade = p.where((p["c.c_acctbal"] > 9500) & (p["s.s_acctbal"] > 9000)).select(a=p["c.c_nationkey"], b=p["s.s_nationkey"]).distinct()
    h = Graph({**g.tables, "trade": trade}, g.labels, {**g.types, "TRADES": EdgeType("trade", "a", "b", ("a", "b"))})
    pairs = trade.select(F.col("a").alias("source")).distinct().join(F.broadcast(trade.agg(F.max("b").alias("target"))), F.lit(True)).where("source <> target")
    return paths.k_shortest_paths(h, "TRADES", pairs, 4, most=3).select("source", F.col("rank").cast("bigint").alias("rank"), "hops")


# ---------------------------------------------------------------- functions of extensions

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query("""WITH q AS (SELECT vec_id AS query, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id,
round(list_sum(list_transform(list_zip(qe, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(qe, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score
FROM q, embeddings WHERE vec_id <> query) SELECT query, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def cosine_nearest(g: Graph) -> DataFrame:
    v = g.table("embeddings")
    # the SQL ranks by the rounded score
    out = vector.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 5, digits=6)
    return out.select("query", "vec_id", "score", big(F.col("rank")).alias("rank"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))), 5) AS d
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def l2_to_next(g: Graph) -> DataFrame:
    v = g.table("embeddings")
    other = v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("e2"))
    return v.join(other, F.col("vec_id") + 1 == F.col("b")).select(F.col("vec_id").alias("a"), "b", F.round(vector.l2_distance(F.col("embedding"), F.col("e2")), 5).alias("d"))


PLACE = "(n_nationkey * 7 % 120 - 60)::DOUBLE AS lat, (n_nationkey * 29 % 360 - 180)::DOUBLE AS lon"


def _places(g: Graph, var: str) -> DataFrame:
    k = F.col("n_nationkey")
    return g.table("nation").select(k.alias(var), (k * 7 % 120 - 60).cast("double").alias(f"{var}_lat"), (k * 29 % 360 - 180).cast("double").alias(f"{var}_lon"))


@query(f"""WITH p AS (SELECT n_nationkey AS k, {PLACE} FROM nation) SELECT a.k AS a, b.k AS b, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
+ cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))), 1) AS metres FROM p a, p b WHERE a.k < b.k""")
def geo_distances(g: Graph) -> DataFrame:
    a, b = _places(g, "a"), _places(g, "b")
    d = geo.geo_distance(geo.geo_point(F.col("a_lon"), F.col("a_lat")), geo.geo_point(F.col("b_lon"), F.col("b_lat")))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(d, 1).alias("metres"))


@query(f"WITH p AS (SELECT n_nationkey AS k, {PLACE} FROM nation) SELECT k, (lon BETWEEN -99.5 AND 99.5 AND lat BETWEEN -29.5 AND 39.5) AS within FROM p")
def geo_within_polygon(g: Graph) -> DataFrame:
    corners = F.array(*[geo.geo_point(F.lit(x), F.lit(y)) for x, y in ((-99.5, -29.5), (99.5, -29.5), (99.5, 39.5), (-99.5, 39.5))])
    return _places(g, "k").select("k", geo.geo_contains(corners, geo.geo_point(F.col("k_lon"), F.col("k_lat"))).alias("within"))


@query("SELECT o_orderkey AS id, o_orderstatus AS s, 'x' AS tag, o_totalprice AS total, 'orders' AS collection, o_orderkey::VARCHAR AS key, 3 AS n, 'F' AS f FROM orders WHERE o_orderstatus = 'F'")
def document_functions(g: Graph) -> DataFrame:
    df = match(g, "Order", "o", {"o_orderstatus": "F"}).df.select(
        F.struct(F.col("o___id").alias("id"), F.col("o__o_orderstatus").alias("s"), F.lit(1).alias("tag")).alias("a"), F.struct(F.lit("x").alias("tag"), F.col("o__o_totalprice").alias("total")).alias("b"), F.concat(F.lit("orders/"), F.col("o___id")).alias("ref")
    )
    df = df.withColumn("m", document.merge(df, "a", "b")).withColumn("who", document.parse_identifier(F.col("ref")))
    df = df.withColumn("k", document.keep(df, "m", "id", "s"))
    df = df.withColumn("z", document.zipped(document.attributes(df, "k"), document.values(df, "k"))).withColumn("u", document.unset(df, "m", "id"))
    return df.select("m.id", "k.s", "u.tag", document.value(F.col("m"), "total").alias("total"), "who.collection", "who.key", F.size(document.attributes(df, "u")).alias("n"), F.col("z")["s"].alias("f"))


@query("SELECT l.doc_id AS id, d.lang AS lang FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def document_lookup(g: Graph) -> DataFrame:
    out = document.lookup(g.table("labels").select("doc_id"), "doc_id", g.table("documents").select("doc_id", "lang"), "doc_id", "d")
    return out.select(F.col("doc_id").alias("id"), F.col("d.lang").alias("lang"))


@query(r"SELECT doc_id AS id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'the') AND len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: starts_with(t, 'lice'))) > 0")
def fulltext_search(g: Graph) -> DataFrame:
    return search.fulltext(g.table("documents"), "text", "the,prefix:lice").select(F.col("doc_id").alias("id"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT doc_id, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (SELECT unnest(['idiot', 'license']) AS term)), h AS (SELECT * FROM p WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM h JOIN f USING (term), c GROUP BY 1""")
def bm25_scores(g: Graph) -> DataFrame:
    return search.bm25(g.table("documents"), "doc_id", "text", ["idiot", "license"]).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents), c AS (SELECT count(*) AS n FROM w),
p AS (SELECT doc_id, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (SELECT unnest(['idiot', 'license']) AS term)), h AS (SELECT * FROM p WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id AS id, round(sum(sqrt(tf) * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM h JOIN f USING (term), c GROUP BY 1""")
def tfidf_scores(g: Graph) -> DataFrame:
    return search.tfidf(g.table("documents"), "doc_id", "text", ["idiot", "license"]).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))


@query("""WITH m(mention) AS (VALUES ('Customer#000000001'), ('NATION_3'), ('nation_')), v AS (SELECT DISTINCT c_name AS value FROM customer UNION SELECT n_name FROM nation),
s AS (SELECT mention, value, CASE WHEN lower(mention) = lower(value) THEN 1.0 ELSE greatest(CASE WHEN contains(lower(value), lower(mention)) THEN 0.85 ELSE 0 END, CASE WHEN contains(lower(mention), lower(value)) THEN 0.7 ELSE 0 END,
CASE WHEN 1 - levenshtein(lower(mention), lower(value)) / greatest(length(mention), length(value), 1)::DOUBLE >= 0.7 THEN 0.9 * (1 - levenshtein(lower(mention), lower(value)) / greatest(length(mention), length(value), 1)::DOUBLE) ELSE 0 END) END::DOUBLE AS score FROM m, v)
SELECT mention, value, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, value) AS k FROM s WHERE score >= 0.5) WHERE k = 1""")
def entity_resolution(g: Graph) -> DataFrame:
    spark = g.table("nation").sparkSession
    mentions = spark.createDataFrame([("Customer#000000001",), ("NATION_3",), ("nation_",)], "mention string")
    values = g.nodes("Customer").select(F.col("c_name").alias("value")).unionByName(g.nodes("Nation").select(F.col("n_name").alias("value")))
    return search.resolve(mentions, values).select("mention", "value", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- updates


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT n_nationkey + 10000000, n_name, NULL FROM nation")
def create_nodes(g: Graph) -> DataFrame:
    rows = g.nodes("Nation").select((F.col("n_nationkey") + 10000000).alias("c_custkey"), F.col("n_name").alias("c_name"))
    p = match(update.create_nodes(g, "Customer", rows), "Customer", "c")
    return p.select(id=p["c"], name=p["c.c_name"], balance=p["c.c_acctbal"])


@query("SELECT o_orderkey AS o, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) + 1 AS parts, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS suppliers FROM orders")
def create_edges(g: Graph) -> DataFrame:
    rows = g.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_partkey"), F.lit(-1).alias("l_linenumber"))
    h = update.create_edges(g, "CONTAINS", rows)
    p = match(h, "Order", "o").count_as("parts", "o", lambda q: q.out("CONTAINS", None, "x")).count_as("suppliers", "o", lambda q: q.out("FULFILLED_BY", None, "x"))
    return p.select(o=p["o"], parts=F.col("parts"), suppliers=F.col("suppliers"))


@query("""SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 25 WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_nationkey END AS nation FROM supplier""")
def create_foreign_key_edges(g: Graph) -> DataFrame:
    h = update.remove_properties(g, "Supplier", g.nodes("Supplier").where("_id % 2 = 0 or _id % 3 = 0").select("_id"), ["s_nationkey"])
    h = update.create_edges(h, "SUPPLIER_IN", g.table("supplier").where("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_suppkey") % 25).alias("s_nationkey")))
    p = match(h, "Supplier", "s")
    return p.select(id=p["s"], name=p["s.s_name"], nation=p["s.s_nationkey"])


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey < 10 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT -2, 7.0 UNION ALL SELECT -1, 7.0""")
def merge_nodes(g: Graph) -> DataFrame:
    ids = g.nodes("Customer").where("_id % 2 = 0 and _id < 10").select("_id").unionByName(g.table("region").sparkSession.createDataFrame([(-1,), (-1,), (-2,)], "_id long"))
    h = update.merge_nodes(g, "Customer", ids.select(F.col("_id").alias("c_custkey")), ["c_custkey"], {"c_acctbal": F.lit(7.0)}, {"c_acctbal": F.col("c_acctbal") + 1})
    p = match(h, "Customer", "c")
    return p.select(id=p["c"], balance=p["c.c_acctbal"])


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE n_regionkey END AS region FROM nation")
def merge_edges(g: Graph) -> DataFrame:
    even = g.nodes("Nation").where("_id % 2 = 0").select("_id")
    h = update.remove_properties(g, "Nation", even, ["n_regionkey"])
    rows = g.table("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, 0).otherwise(F.col("n_regionkey")).alias("n_regionkey"))
    h = update.merge_edges(h, "IN_REGION", rows.unionByName(rows).where("n_nationkey < 1000000"))
    p = match(h, "Nation", "n").optional("n", lambda q: q.out("IN_REGION", "Region", "r"))
    return p.select(id=p["n"], name=p["n.n_name"], region=p["r"])


@query("""SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM (SELECT l_orderkey, l_partkey FROM lineitem UNION ALL (SELECT o_orderkey, 0 FROM orders EXCEPT SELECT l_orderkey, l_partkey FROM lineitem)) GROUP BY 1, 2""")
def merge_table_edges(g: Graph) -> DataFrame:
    rows = g.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).cast("long").alias("l_partkey"))
    e = update.merge_edges(g, "CONTAINS", rows.unionByName(rows)).edges("CONTAINS")
    return e.groupBy(F.col("_src").alias("o"), F.col("_dst").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS balance, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END AS nation FROM supplier")
def set_and_remove(g: Graph) -> DataFrame:
    ids = g.nodes("Supplier").where("s_acctbal < 0").select("_id")
    h = update.set_properties(g, "Supplier", ids, {"s_acctbal": F.lit(0.0)})
    p = match(update.remove_properties(h, "Supplier", ids, ["s_nationkey"]), "Supplier", "s")
    return p.select(id=p["s"], balance=p["s.s_acctbal"], nation=p["s.s_nationkey"])


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey IN (1, 2) THEN 'Z' ELSE o_orderstatus END AS status FROM orders")
def set_for_each(g: Graph) -> DataFrame:
    lists = match(g, "Customer", "c").out("PLACED", "Order", "o").where(F.col("c___id").isin(1, 2)).df.groupBy("c___id").agg(F.collect_list("o___id").alias("items"))
    p = match(update.set_each(g, "Order", lists, "items", {"o_orderstatus": F.lit("Z")}), "Order", "o")
    return p.select(id=p["o"], status=p["o.o_orderstatus"])


@query("SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 0) AS nodes, (SELECT count(*) FROM lineitem WHERE l_suppkey % 3 <> 0) AS edges")
def detach_delete(g: Graph) -> DataFrame:
    h = update.delete_nodes(g, "Supplier", g.nodes("Supplier").where("_id % 3 = 0").select("_id"), detach=True)
    return h.nodes("Supplier").agg(F.count("*").alias("nodes")).join(F.broadcast(h.edges("SUPPLIED").agg(F.count("*").alias("edges"))), F.lit(True))


@query("""SELECT 'Supplier' AS what, count(*) AS n FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders
UNION ALL SELECT 'SUPPLIED', count(*) FROM lineitem WHERE l_suppkey % 3 <> 0 UNION ALL SELECT 'FULFILLED_BY', count(*) FROM lineitem WHERE l_suppkey % 3 <> 0 UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem
UNION ALL SELECT 'SUPPLIER_IN', count(*) FROM supplier WHERE s_suppkey % 3 <> 0""")
def detach_delete_all_types(g: Graph) -> DataFrame:
    h = update.delete_nodes(g, "Supplier", g.nodes("Supplier").where("_id % 3 = 0").select("_id"), detach=True)
    nodes = [h.nodes(k).agg(F.lit(k).alias("what"), F.count("*").alias("n")) for k in ("Supplier", "Part", "Order")]
    return union(*nodes, *[h.edges(k).agg(F.lit(k).alias("what"), F.count("*").alias("n")) for k in ("SUPPLIED", "FULFILLED_BY", "CONTAINS", "SUPPLIER_IN")])


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS nation FROM customer")
def detach_delete_foreign_keys(g: Graph) -> DataFrame:
    h = update.delete_nodes(g, "Nation", g.nodes("Nation").where("_id % 5 = 0").select("_id"), detach=True)
    p = match(h, "Customer", "c").optional("c", lambda q: q.out("CUSTOMER_IN", "Nation", "n"))
    return p.select(id=p["c"], nation=p["n"])


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IS NOT NULL OR s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def nodes_with_edges(g: Graph) -> DataFrame:
    return update.connected(g, "Supplier", g.nodes("Supplier").select("_id")).select(F.col("_id").alias("id"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN -c_acctbal ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 2 = 0 THEN 'EVEN' ELSE c_mktsegment END AS segment FROM customer")
def set_map(g: Graph) -> DataFrame:
    maps = g.nodes("Customer").where("_id % 2 = 0").select("_id", F.struct((-F.col("c_acctbal")).alias("c_acctbal"), F.lit("EVEN").alias("c_mktsegment")).alias("m"))
    p = match(update.add_properties(g, "Customer", maps, "m"), "Customer", "c")
    return p.select(id=p["c"], name=p["c.c_name"], balance=p["c.c_acctbal"], segment=p["c.c_mktsegment"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_name END AS name, CASE WHEN c_custkey % 2 <> 0 THEN c_acctbal END AS balance FROM customer")
def set_all_properties(g: Graph) -> DataFrame:
    ids = g.nodes("Customer").where("_id % 2 = 0").select("_id")
    p = match(update.set_properties(g, "Customer", ids, {"c_name": F.lit("x")}, replace_all=True), "Customer", "c")
    return p.select(id=p["c"], name=p["c.c_name"], balance=p["c.c_acctbal"])


# ---------------------------------------------------------------- endpoints, labels, optional nodes


@query("SELECT n_nationkey AS n, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def undirected_typed_ends(g: Graph) -> DataFrame:
    p = match(g, "Nation", "n").both("CUSTOMER_IN", "Customer", "c")
    return p.df.groupBy(F.col("n___id").alias("n")).agg(F.count("*").alias("customers"))


@query("SELECT l_orderkey AS o, count(*) AS n FROM (SELECT l.l_orderkey FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey WHERE l.l_linenumber <> m.l_linenumber OR l.l_partkey <> m.l_partkey OR l.l_suppkey <> m.l_suppkey) GROUP BY 1")
def several_types_then_one(g: Graph) -> DataFrame:
    p = match(g, "Order", "o").out(["FULFILLED_BY", "PLACED"], "Supplier", "s", edge="a").at("o").out("CONTAINS", "Part", "p", edge="b")
    return p.df.groupBy(F.col("o___id").alias("o")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS o, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1")
def edge_properties_exact(g: Graph) -> DataFrame:
    p = match(g, "Order", "o").out("CONTAINS", None, "x", edge_properties={"l_returnflag": "R"})
    lower = match(g, "Order", "o").out("CONTAINS", None, "x", edge_properties={"l_returnflag": "r"})
    return union(p.df.select("o___id"), lower.df.select("o___id")).groupBy(F.col("o___id").alias("o")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, c_name AS name FROM customer")
def nested_property(g: Graph) -> DataFrame:
    rows = g.table("customer").select("c_custkey", F.struct(F.struct("c_mktsegment", "c_name").alias("b"), F.create_map(F.lit("k"), "c_name").alias("m")).alias("a"))
    p = match(g.with_table("customer", rows), "Customer", "x")
    return p.where(p["x.a.none.b"].isNull()).select(id=p["x"], segment=p["x.a.b.c_mktsegment"], name=p["x.a.m.k"])


@query("SELECT event_id AS id, event_type = 'click' AS click, false AS part FROM events")
def label_in_expression(g: Graph) -> DataFrame:
    p = match(g, "Event", "e").label_as("click", "e", "Click").label_as("part", "e", "Part")
    return p.select(id=p["e"], click=F.col("click"), part=F.col("part"))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def label_in_list(g: Graph) -> DataFrame:
    rows = g.table("customer").withColumn("kinds", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.array(F.lit("Customer"), F.lit("Builder"))).otherwise(F.array(F.lit("Customer"))))
    h = Graph({**g.tables, "customer": rows}, {"Builder": NodeType("customer", "c_custkey", "kinds", "Builder")}, {})
    p = match(h, "Builder", "b")
    return p.select(id=p["b"])


@query("SELECT r_regionkey AS region, n_nationkey AS nation FROM region LEFT JOIN nation ON n_nationkey = r_regionkey * 10")
def optional_node(g: Graph) -> DataFrame:
    p = match(g, "Region", "r").optional_node("Nation", "n", on=lambda v: v("n.n_nationkey") == v("r.r_regionkey") * 10)
    return p.select(region=p["r"], nation=p["n"])


@query("SELECT 'none' AS which, NULL::BIGINT AS id UNION ALL SELECT 'some', c_custkey FROM customer WHERE c_acctbal > 9000")
def leading_optional(g: Graph) -> DataFrame:
    none = begin_optional(g, "Customer", "c", {"c_name": "nobody"}, lambda q: q.out("PLACED", "Order", "o"))
    some = begin_optional(g, "Customer", "c", build=lambda q: q.where(q["c.c_acctbal"] > 9000))
    return union(none.select(which=F.lit("none"), id=none["c"]), some.select(which=F.lit("some"), id=some["c"]))


@query("SELECT s_suppkey AS s, n_nationkey AS n, r_regionkey AS r FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey > 10 LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 2")
def several_optionals(g: Graph) -> DataFrame:
    p = match(g, "Supplier", "s").optional("s", lambda q: (m := q.out("SUPPLIER_IN", "Nation", "n")).where(m["n"] > 10))
    p = p.optional("n", lambda q: (m := q.out("IN_REGION", "Region", "r")).where(m["r"] < 2))
    return p.select(s=p["s"], n=p["n"], r=p["r"])


# ---------------------------------------------------------------- schema and statistics


@query("""SELECT 'PLACED' AS type, count(*) AS edges, count(DISTINCT o_custkey) AS sources, count(DISTINCT o_orderkey) AS targets, CASE WHEN count(*) / count(DISTINCT o_custkey) > 1.5 THEN '1:N' ELSE '1:1' END AS cardinality FROM orders
UNION ALL SELECT 'SUPPLIER_IN', count(*), count(DISTINCT s_suppkey), count(DISTINCT s_nationkey), CASE WHEN count(*) / count(DISTINCT s_nationkey) > 1.5 THEN 'N:1' ELSE '1:1' END FROM supplier
UNION ALL SELECT 'SUPPLIED', count(*), count(DISTINCT l_suppkey), count(DISTINCT l_partkey), 'N:M' FROM lineitem""")
def edge_statistics(g: Graph) -> DataFrame:
    h = Graph(g.tables, g.labels, {k: g.types[k] for k in ("PLACED", "SUPPLIER_IN", "SUPPLIED")})
    return schema.graph_statistics(h).select("type", "edges", "sources", "targets", "cardinality")


@query("SELECT 'Customer' AS label, count(*) AS nodes FROM customer UNION ALL SELECT 'Click', count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events")
def label_statistics(g: Graph) -> DataFrame:
    return schema.label_counts(Graph(g.tables, {k: g.labels[k] for k in ("Customer", "Click", "User")}, {}))


@query("""SELECT 'o_orderkey' AS property, 'long' AS kind, count(*) AS rows, count(o_orderkey) AS filled, true AS numeric_like FROM orders UNION ALL SELECT 'o_custkey', 'long', count(*), count(o_custkey), true FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', count(*), count(o_orderstatus), false FROM orders UNION ALL SELECT 'o_totalprice', 'double', count(*), count(o_totalprice), true FROM orders
UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(*), count(o_orderdate), false FROM orders UNION ALL SELECT 'o_orderpriority', 'string', count(*), count(o_orderpriority), false FROM orders""")
def property_profile(g: Graph) -> DataFrame:
    return schema.profile(g.table("orders")).select("property", "kind", "rows", "filled", "numeric_like")


@query("SELECT lang, count(*) AS n FROM documents WHERE source = 'src1' GROUP BY 1")
def tenant_scope(g: Graph) -> DataFrame:
    p = match(schema.tenant_view(g, "source", "src1"), "Document", "d")
    return p.df.groupBy(F.col("d__lang").alias("lang")).agg(F.count("*").alias("n"))


@query("""SELECT 'events' AS "table", 'type' AS field, count(*) AS rows, count(event_type) AS filled, count(DISTINCT event_type) AS different FROM events
UNION ALL SELECT 'parts', 'kind', count(*), count(p_brand), count(DISTINCT p_brand) FROM part""")
def type_fields(g: Graph) -> DataFrame:
    shared = {"events": g.table("events").withColumnRenamed("event_type", "type"), "parts": g.table("part").withColumnRenamed("p_brand", "kind"), "nation": g.table("nation")}
    return inference.type_fields(shared)


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), t AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
SELECT 'Order' AS label, (SELECT count(*) FROM s WHERE k IN (SELECT o_orderkey FROM orders)) AS sources, (SELECT count(*) FROM t WHERE k IN (SELECT o_orderkey FROM orders)) AS targets
UNION ALL SELECT 'Part', (SELECT count(*) FROM s WHERE k IN (SELECT p_partkey FROM part)), (SELECT count(*) FROM t WHERE k IN (SELECT p_partkey FROM part))
UNION ALL SELECT 'Message', 0, 0""")
def edge_end_labels(g: Graph) -> DataFrame:
    return inference.end_labels(g, g.table("lineitem"), "l_orderkey", "l_partkey", ["Order", "Part", "Message"])


@query("""SELECT event_type AS label, count(*) AS nodes FROM events WHERE event_type IS NOT NULL GROUP BY 1 UNION ALL SELECT 'Customer', count(*) FROM customer
UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Customer-ORDERS-Order', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL""")
def inferred_graph(g: Graph) -> DataFrame:
    tables = {"events": g.table("events").withColumnRenamed("event_type", "type"), "customers": g.table("customer"), "orders": g.table("orders")}
    h = inference.infer_graph(tables, {"events": "event_id", "customers": "c_custkey", "orders": "o_orderkey"}, {"orders": ("o_custkey", "o_orderkey")})
    e = h.types["ORDERS"]
    # customers' and orders' keys overlap, so the side's label is the one that holds more of its ends
    edges = h.edges("ORDERS").agg(F.lit(f"{e.from_label}-ORDERS-{e.to_label}").alias("label"), F.count("*").alias("nodes"))
    return schema.label_counts(Graph(h.tables, h.labels, {})).unionByName(edges)


@query("""SELECT 'state' AS property, count(*) AS rows, count(*) FILTER (o_orderkey % 3 <> 0) AS filled, count(*) FILTER (o_orderkey % 3 = 1) AS sentinels, true AS numeric_like FROM orders
UNION ALL SELECT 'rare', count(*), count(*), 0, false FROM orders""")
def property_sentinels(g: Graph) -> DataFrame:
    k = F.col("o_orderkey")
    df = g.table("orders").select(F.when(k % 3 == 1, " n/a").when(k % 3 == 2, k.cast("string")).alias("state"), F.when(k == 7, "TBD").otherwise("x").alias("rare"))
    return schema.profile(df).select("property", "rows", "filled", big(F.col("sentinels")).alias("sentinels"), "numeric_like")


# ---------------------------------------------------------------- places, lists and documents

SPOT = "c_custkey AS id, (c_custkey * 7 % 120 - 60 + c_acctbal % 1)::DOUBLE AS lat, (c_custkey * 29 % 360 - 180)::DOUBLE AS lon FROM customer"
METRES = """2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(10.3) - radians(lat)) / 2), 2)
+ cos(radians(lat)) * cos(radians(10.3)) * pow(sin((radians(20.7) - radians(lon)) / 2), 2))))"""


def _spots(g: Graph) -> DataFrame:
    k = F.col("c_custkey")
    return g.table("customer").select(k.alias("id"), (k * 7 % 120 - 60 + F.col("c_acctbal") % 1).cast("double").alias("lat"), (k * 29 % 360 - 180).cast("double").alias("lon"))


@query(f"SELECT id, round(metres, 1) AS metres FROM (SELECT id, {METRES} AS metres FROM (SELECT {SPOT})) ORDER BY metres, id LIMIT 100")
def near_point(g: Graph) -> DataFrame:
    # the SQL orders by its output column, the rounded metres
    return geo.near(_spots(g), "lat", "lon", (10.3, 20.7), "id", digits=1).select("id", "metres")


@query(f"SELECT id, round(metres, 1) AS metres FROM (SELECT id, {METRES} AS metres FROM (SELECT {SPOT})) WHERE metres <= 3000000")
def within_radius(g: Graph) -> DataFrame:
    return geo.within(_spots(g), "lat", "lon", (10.3, 20.7), 3_000_000).select("id", F.round("metres", 1).alias("metres"))


@query(f"""SELECT id, metres >= 1000000 AND metres < 5000000 AS ring, lon <= 30 AND lon + 10 >= -20 AND lat <= 40 AND lat + 5 >= 0 AS meets
FROM (SELECT id, lat, lon, {METRES} AS metres FROM (SELECT {SPOT}))""")
def geo_ranges(g: Graph) -> DataFrame:
    spot, middle = geo.geo_point(F.col("lon"), F.col("lat")), geo.geo_point(F.lit(20.7), F.lit(10.3))
    own = F.struct(F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 10).alias("east"), (F.col("lat") + 5).alias("north"))
    box = F.struct(F.lit(-20.0).alias("west"), F.lit(0.0).alias("south"), F.lit(30.0).alias("east"), F.lit(40.0).alias("north"))
    return _spots(g).select("id", geo.geo_in_range(spot, middle, 1e6, 5e6, with_high=False).alias("ring"), geo.box_intersects(own, box).alias("meets"))


@query("""WITH l AS (SELECT l_orderkey AS o, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS xs FROM lineitem GROUP BY 1)
SELECT o, xs[-2] AS second_last, len(xs[2:3]) AS middle, len(xs) - 1 AS rest, xs[2] AS after_first, 2 * len(xs) AS both FROM l""")
def list_access(g: Graph) -> DataFrame:
    rows = g.table("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"]).alias("xs"))
    xs = F.col("xs")
    sizes = [big(F.size(x)).alias(n) for n, x in (("middle", scalar.part(xs, 1, 3)), ("rest", scalar.tail(xs)), ("both", document.flatten(F.array(xs, xs))))]
    return rows.select("o", scalar.item(xs, -2).alias("second_last"), scalar.head(scalar.tail(xs)).alias("after_first"), *sizes)


@query("""SELECT c_custkey AS id, c_nationkey > 10 AS has_nation, false AS has_none, c_name AS name, strftime(TIMESTAMP '2020-01-02 03:04:05' + to_days((c_custkey % 300)::INTEGER), '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM customer""")
def node_properties(g: Graph) -> DataFrame:
    p = match(g, "Customer", "c")
    df = p.df.withColumn("c__c_nationkey", F.when(F.col("c__c_nationkey") > 10, F.col("c__c_nationkey")))
    df = df.withColumn("all", scalar.properties(df, "c"))
    at = F.expr("timestamp_ntz '2020-01-02 03:04:05' + make_interval(0, 0, 0, cast(c___id % 300 as int))")
    return df.select(F.col("c___id").alias("id"), document.has(df, "all", "c_nationkey").alias("has_nation"), document.has(df, "all", "none").alias("has_none"), "all.c_name", at.alias("t")).select(
        "id", "has_nation", "has_none", F.col("c_name").alias("name"), scalar.iso(F.col("t")).alias("at")
    )
