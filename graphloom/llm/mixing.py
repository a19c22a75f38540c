"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

The documents' tokens are summed over the cells of source, language and topic.  Each round scales the cells so
that one margin after the other meets its target; after the last round a cell's weight is its raked tokens over
its own, and documents are sampled with probabilities in proportion to the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import discard, release, stored

MARGINS = ("source", "lang", "topic")
#: Rounds of raking, and the exponent that makes targets of the shares that the data have.
ROUNDS, TEMPER = 8, 0.7
#: Rounds after which the driver lets go of the ended rounds' plans and broadcasts.
COLLECTED = 4
#: What stands for a null in a margin.
NONE = "(none)"


def n_tokens(text: Column) -> Column:
    """White-space separated words; 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse kind of content: tables, texts strewn with signs, short texts, prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike(r"\*\*\*|%%%|###|\$\$\$|&&&|!!"), "signs")
        .when(F.coalesce(F.length(text), F.lit(0)) < 500, "short")
        .otherwise("prose")
    )


def tempered_targets(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """(value, share): the margin's shares of tokens, raised to ``temper`` and scaled to 1."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    powers = sums.select("value", F.pow(F.col("t").cast("double"), F.lit(temper)).alias("p"))
    return powers.crossJoin(powers.agg(F.sum("p").alias("all"))).select("value", (F.col("p") / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Adds raked: the cells' tokens after ``rounds`` rounds over the margins in the order of ``targets``.

    cells has the margins and tokens; targets has (value, share) for each margin.  A value without a target
    gets no tokens; a target without tokens is left out, so that the total is kept by the others.  Sums are
    partial before each shuffle.  Targets are joined once, and the table is stored after every margin: it is read
    both for the sums and for what they scale, so a plan of several margins would double with each of them.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    now, shares = cells.withColumn("raked", F.col("tokens").cast("double")), {m: f"_share{k}" for k, m in enumerate(targets)}
    for margin, share in shares.items():
        target = targets[margin].select(F.col("value").alias("_value"), F.col("share").alias(share))
        now = now.join(target, F.col(margin) == F.col("_value"), "left").drop("_value")
    now = stored(now, "raked")
    for n in range(rounds):
        for margin, share in shares.items():
            before = now
            sums = now.groupBy(F.col(margin).alias("_value"), F.col(share).alias("_share")).agg(F.sum("raked").alias("_sum")).where("_sum > 0")
            factor = sums.select("_value", (F.col("_share") * total / F.col("_sum")).alias("_factor"))
            now = now.join(factor, F.col(margin) == F.col("_value"), "left").withColumn("raked", F.col("raked") * F.coalesce("_factor", F.lit(0.0))).drop("_value", "_factor")
            now = stored(now, "raked")
            discard(before)
        if n % COLLECTED == COLLECTED - 1:
            release(spark)
    return now.drop(*shares.values())


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", margins: dict[str, Column] | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temper: float = TEMPER) -> DataFrame:
    """docs with n_tokens, the margins, weight, probability and kept (columns of docs with these names are replaced).

    ``margins`` maps names to columns (source, lang and topic_of(text) unless given), nulls count as the value
    "(none)".  ``targets`` maps margins to (value, share) tables; without them shares are tempered.  A
    document is kept if the first 32 bits of its id's MD5, as a number from 0 to 1, are under its probability,
    which is its cell's weight over the largest weight: the expected mix is the raked one.  Equal ids share
    their fate, a null id counts as an empty one; documents without tokens are weighed as their cell is.
    """
    margins = margins or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(text))}
    new = {"n_tokens": n_tokens(F.col(text).cast("string"))} | {k: F.coalesce(v.cast("string"), F.lit(NONE)) for k, v in margins.items()}
    own = {f"_mix_{k}": v for k, v in new.items()}
    cells = stored(docs.select(*[v.alias(k) for k, v in new.items()]).groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")), "cells")
    # a cell without tokens takes no part in the raking and has the weight 0
    some = cells.where("tokens > 0")
    if targets is None:
        targets = {k: stored(tempered_targets(some, k, temper), "targets") for k in margins}
    raked = rake(some, targets, rounds).withColumn("weight", F.col("raked") / F.col("tokens"))
    most = raked.agg(F.max("weight")).first()[0] or 1.0
    raked = raked.select(*[F.col(k).alias(f"_cell_{k}") for k in margins], F.col("weight").alias("_cell_weight"))
    out = docs.withColumns(own)
    same = [F.col(f"_mix_{k}") == F.col(f"_cell_{k}") for k in margins]
    out = out.join(raked, same, "left").withColumn("_mix_weight", F.coalesce("_cell_weight", F.lit(0.0)))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    rest = [c for c in docs.columns if c not in {*new, "weight", "probability", "kept"} or c in (id, text)]
    share = F.col("_mix_weight") / most
    return out.select(*[docs[c] for c in rest], *[F.col(f"_mix_{k}").alias(k) for k in new], F.col("_mix_weight").alias("weight"), share.alias("probability"), (draw < share).alias("kept"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight, probability and fate of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = mix(docs)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def oracle(rounds: int = ROUNDS, temper: float = TEMPER) -> str:
    """The SQL of op10: the rounds are written out."""
    parts = [
        r"""d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '\*\*\*|%%%|###|\$\$\$|&&&|!!') THEN 'signs'
    WHEN coalesce(length(text), 0) < 500 THEN 'short' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "r0 AS (SELECT *, tokens::DOUBLE AS raked, (SELECT sum(tokens) FROM c)::DOUBLE AS total FROM c)",
    ]
    for k in MARGINS:
        parts.append(f"t_{k} AS (SELECT {k}, pow(t, {temper}) / sum(pow(t, {temper})) OVER () AS share FROM (SELECT {k}, sum(tokens)::DOUBLE AS t FROM c GROUP BY {k}))")
    n = 0
    for _ in range(rounds):
        for k in MARGINS:
            n += 1
            parts.append(f"r{n} AS MATERIALIZED (SELECT r.* REPLACE (raked * (t.share * total / sum(raked) OVER (PARTITION BY r.{k})) AS raked) FROM r{n - 1} r JOIN t_{k} t ON r.{k} = t.{k})")
    parts.append(f"w AS (SELECT source, lang, topic, raked / tokens AS weight FROM r{n})")
    return (
        "WITH " + ",\n".join(parts) + """
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(w.weight, 0), 6) AS weight,
  round(coalesce(w.weight, 0) / (SELECT max(weight) FROM w), 6) AS probability,
  (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0) < coalesce(w.weight, 0) / (SELECT max(weight) FROM w) AS kept
FROM d LEFT JOIN w ON d.source = w.source AND d.lang = w.lang AND d.topic = w.topic"""
    )


OP10_SQL = oracle()
