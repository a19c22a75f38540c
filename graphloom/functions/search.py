"""Full-text ranking and fuzzy entity lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """The analyzer: lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fulltext(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text has all words of the query; "prefix:ab" asks for a word that starts with ab."""
    for word in query.lower().split(","):
        word = word.strip()
        if word.startswith("prefix:"):
            df = df.where(_has_start(terms(F.col(text)), word.removeprefix("prefix:")))
        else:
            df = df.where(F.array_contains(terms(F.col(text)), word))
    return df


def _has_start(words: Column, start: str) -> Column:
    return F.exists(words, lambda t: t.startswith(start))


def _postings(df: DataFrame, id: str, text: str, query: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(id, len, term, tf) of the query's terms, and one row (n, mean) of the corpus."""
    words = df.select(id, terms(F.col(text)).alias("_w"))
    asked = sorted({q.lower() for q in query})
    total = words.agg(F.count("*").alias("n"), F.avg(F.size("_w")).alias("mean"))
    hits = words.select(id, F.size("_w").alias("len"), F.explode(F.filter("_w", lambda w: w.isin(asked))).alias("term"))
    return hits.groupBy(id, "len", "term").agg(F.count("*").alias("tf")), total


def bm25(df: DataFrame, id: str, text: str, query: Sequence[str], k: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the rows that have a term of the query; statistics cover all rows.

    Only postings of the query's terms leave a task; the corpus totals are one row and document frequencies a
    row for each query term, so their joins are broadcasts of proven size.
    """
    posts, total = _postings(df, id, text, query)
    df_ = posts.groupBy("term").agg(F.count("*").alias("df"))
    scored = posts.join(F.broadcast(df_), "term").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.groupBy(id).agg(F.sum(weight).alias("score"))


def tfidf(df: DataFrame, id: str, text: str, query: Sequence[str], normalize: bool = False) -> DataFrame:
    """(id, score): square root of the term frequency by log idf, over the square root of the length if ``normalize``."""
    posts, total = _postings(df, id, text, query)
    df_ = posts.groupBy("term").agg(F.count("*").alias("df"))
    scored = posts.join(F.broadcast(df_), "term").crossJoin(F.broadcast(total))
    weight = F.sqrt("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) / (F.sqrt("len") if normalize else F.lit(1.0))
    return scored.groupBy(id).agg(F.sum(weight).alias("score"))


def similarity(mention: Column, value: Column) -> Column:
    """1 for equal texts, .85 if the value holds the mention, .7 the other way, else at most .9 by edit distance (from .7 up); without case."""
    m, v = F.lower(mention), F.lower(value)
    near = 1 - F.levenshtein(m, v) / F.greatest(F.length(m), F.length(v), F.lit(1))
    fuzzy = F.when(near >= 0.7, 0.9 * near).otherwise(0.0)
    return F.when(m == v, 1.0).otherwise(F.greatest(F.when(v.contains(m), 0.85).otherwise(0.0), F.when(m.contains(v), 0.7).otherwise(0.0), fuzzy))


def resolve(mentions: DataFrame, values: DataFrame, mention: str = "mention", value: str = "value", least: float = 0.5) -> DataFrame:
    """(mention, value, score): each mention's best value of at least ``least``; ties by value.

    Mentions are a stated, small set (those of one question); values are read once, and equal values count once.
    """
    one = values.select(F.col(value).alias("value")).where("value is not null").distinct()
    pairs = one.join(F.broadcast(mentions.select(F.col(mention).alias("mention"))), F.lit(True))
    pairs = pairs.withColumn("score", similarity(F.col("mention"), F.col("value"))).where(F.col("score") >= least)
    best = pairs.groupBy("mention").agg(F.min_by(F.struct("value", "score"), F.struct((-F.col("score")).alias("s"), "value")).alias("best"))
    return best.select("mention", "best.value", "best.score")


def ranked(scores: DataFrame, id: str, k: int) -> DataFrame:
    """The k best of (id, score) with their rank; ties by id."""
    top = scores.orderBy(F.desc("score"), id).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id)))
