"""URL rules by host suffix and path prefix.

Each URL is expanded into the host-suffix and path-prefix expressions that some rule could have written; an
equi-join on a short prefix of the expression's digest retrieves candidate rules, the full digest confirms
them, and the longest rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that the join uses.
SHORT = 8

#: The rules of op8: (rule, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def host_of(url: Column) -> Column:
    """Between the first "://" and the next "/", "?", "#" or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end, as it is written; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Splits rules at their first "/" and adds digests.  Of equal rules with several verdicts, block wins."""
    r = rules.where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    r = r.select("rule", "verdict", host.alias("rule_host"), path.alias("rule_path"))
    digest = F.sha2(F.concat_ws(" ", "rule_host", "rule_path"), 256)
    return r.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, SHORT))


def expressions(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """All "suffix prefix" strings of a URL with a suffix of one of ``labels`` labels and a prefix of one of ``lengths`` characters."""
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= F.size(F.split(host, r"\."))),
        lambda n: F.array_join(F.slice(F.split(host, r"\."), -n, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
        lambda n: F.substring(path, F.lit(1), n),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit(" "), p))))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``urls``.

    A rule fits its host and all subdomains if the path starts with the rule's path.  Of the rules that fit,
    the one with the most characters wins; of equally long ones that with the longer host.  Where none fits
    (also null, empty or malformed URLs) rule is null and the verdict is ``default``.  Rows that repeat are
    all kept.  Other columns stay; columns of ``urls`` named like the four new ones are replaced.

    Distinct URLs are judged once, so a URL that makes up a third of the rows is one row of the expansion.
    The numbers of labels and the path lengths that occur among the rules bound the expressions of a URL;
    those two lists of small numbers are all that reaches the driver.
    """
    r = prepared_rules(rules)
    n = r.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    rest = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    urls = urls.select(*rest)
    if not n["labels"]:
        return urls.select("*", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    one = urls.select(F.col(url).alias("_url")).where("_url is not null").distinct()
    one = one.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    one = one.withColumn("_text", F.explode(expressions(F.col("_host"), F.col("_path"), sorted(n["labels"]), sorted(n["lengths"]))))
    one = one.withColumn("_digest", F.sha2("_text", 256)).withColumn("_short", F.substring("_digest", 1, SHORT))
    hit = one.join(r, F.col("_short") == F.col("short")).where("_digest = digest")
    best = hit.groupBy("_url").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host"), F.col("rule"))).alias("_best")
    )
    out = urls.join(best, F.col(url) == F.col("_url"), "left")
    return out.select(
        *[urls[c] for c in rest],
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
    )


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = f"""
WITH u AS (
  SELECT page_id, url, row_number() OVER () AS rid,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, rhost, rpath, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
m AS (
  SELECT u.rid, r.rule, r.verdict, row_number() OVER (PARTITION BY u.rid ORDER BY length(r.rule) DESC, length(r.rhost) DESC, r.rule DESC) AS k
  FROM u JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.rid = m.rid AND m.k = 1
"""
