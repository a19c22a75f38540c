"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Equal lines become one line first.  A line's signature is made of the smallest hashes of its character
shingles, which begin at every character; bands are groups of signature values.  Lines that share a band are candidates, an exact
Jaccard similarity of the sets of all shingles verifies them, and distributed components keep the first line of each.

No bucket is expanded into all its pairs.  First every line is compared with the first line of each of its buckets.
Where a bucket's lines are not one component after that, a small bucket's lines of different components are compared
with each other, a large one's lines with some more of its lines, which joins most of them.  What is still of several
components is searched exactly by prefix filter: lines that are near share one of the few rarest shingles of each, so all
lines of different components with such a shingle in common are compared, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.components import connected_components
from graphloom.llm.shared import discard, release, stored

#: Characters of a shingle, signature values of a short line, values of a band, bands of a long line, least similarity.
SHINGLE, SIGNATURE, RUN, BANDS, SIMILAR = 9, 14, 3, 7, 0.8
#: A long line's signature is sought among the hashes under a bound that this many of the line's are expected to pass.
PASSING = 3 * BANDS * RUN
#: Shingles of short and of long lines: those between have both kinds of signature, so that lines of about a length meet.
LONG, SHORT = 64, 80
#: Lines with at most this many shingles also have bands of single values, so many that near ones always share one.
FEW = 10
#: Lines of a bucket up to which all are compared, and the lines of a block in the exact search of larger ones.
SMALL, BLOCK = 32, 1024
#: Lines of a large bucket, on average, that all of its lines are compared with before the exact search.
LEADERS = 16
#: Longs of a line's bitmap of shingles, and of a part of it that is summed in one row.
WORDS, PART = 32, 4
#: Rows up to which a table (a few longs a row) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    """Marks a stored table for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def normal(line: Column) -> Column:
    """What lines are compared by: no white space around.  Only a line that has some is looked at letter by letter."""
    blanks = " \t\r\f\x0b"
    around = reduce(or_, (f(line, F.lit(x)) for x in blanks for f in (F.startswith, F.endswith)))
    return F.when(around, F.trim(line, F.lit(blanks))).otherwise(line)


def _at(data: Column | str, i: Column) -> Column:
    """The hash of the shingle at the 0-based place i of UTF-32 data, where places are found at once."""
    return F.xxhash64(F.substr(data, i * 4 + 1, F.lit(4 * SHINGLE)))


def _places(line: str) -> Column:
    """The places where shingles begin; a line shorter than a shingle is one."""
    return F.sequence(F.lit(0), F.greatest(F.char_length(line) - SHINGLE, F.lit(0)))


def shingle_hashes(line: str) -> Column:
    """The distinct hashes of the shingles at every character of a line, in no order."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(line) - SHINGLE, F.lit(0)) * 4 + 1, F.lit(4))
    return F.array_distinct(_let(F.encode(line, "UTF-32"), lambda data: F.transform(at, lambda i: F.xxhash64(F.substr(data, i, F.lit(4 * SHINGLE))))))


def short_bands(lines: DataFrame) -> DataFrame:
    """(lid, band) of the lines (lid, norm) with fewer than SHORT shingles.

    The signature is the SIGNATURE smallest shingle hashes, sorted; bands are its runs of RUN.  Of up to FEW shingles
    single values are bands too: two sets with a similarity of SIMILAR or more, one of n shingles, share one of the
    n - SIMILAR * n + 1 smallest of each.
    """
    lines = lines.where(F.char_length("norm") < SHORT + SHINGLE - 1)
    of = lines.select("lid", F.slice(F.sort_array(shingle_hashes("norm")), 1, SIGNATURE).alias("s")).withColumn("n", F.size("s"))
    run = ", ".join(f"s[i + {k}]" for k in range(RUN))
    runs = F.expr(f"if(n < {FEW - 1}, array(), transform(sequence(0, n - {RUN}), i -> xxhash64({run})))")
    single = F.expr(f"if(n > {FEW}, array(), transform(slice(s, 1, cast(n - ceil({SIMILAR} * n - 1e-9) + 1 as int)), x -> xxhash64(x)))")
    return of.select("lid", F.explode(F.array_distinct(F.concat(runs, single))).alias("band"))


def long_bands(lines: DataFrame) -> DataFrame:
    """(lid, band) of the lines (lid, norm) with LONG shingles or more.

    One permutation hashing: hashes are dealt into BANDS * RUN classes by their remainders (BANDS and RUN have no common
    factor), the smallest hash of each class is a signature value, and RUN classes are a band; one with a class that has
    no hash is none.  The signature's shingles are of SHINGLE bytes of UTF-8, at every byte: the same as of characters in ASCII
    text, and in other text a letter that differs changes a smaller part of them.  Every
    shingle is hashed in generated code, and only hashes under a bound leave it.  All steps keep a line's task.
    """
    lines = lines.where(F.char_length("norm") >= LONG + SHINGLE - 1).repartition("lid")
    n = F.octet_length("norm") - SHINGLE + 1
    most = (F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), PASSING / n)).cast("long")
    rows = lines.select("lid", F.col("norm").cast("binary").alias("data"), most.alias("most"), F.sequence(F.lit(1), n).alias("places"))
    rows = rows.select("lid", "data", "most", F.explode("places").alias("i")).select("lid", "most", F.xxhash64(F.substr("data", F.col("i"), F.lit(SHINGLE))).alias("h"))
    rows = rows.where("h <= most").select("lid", "h", F.pmod("h", F.lit(BANDS)).alias("k"), F.pmod("h", F.lit(RUN)).alias("r"))
    least = [F.min(F.when(F.col("r") == r, F.col("h"))).alias(f"h{r}") for r in range(RUN)]
    bands = rows.groupBy("lid", "k").agg(*least).dropna()
    return bands.select("lid", F.xxhash64("k", *[f"h{r}" for r in range(RUN)]).alias("band"))


def lines_of(docs: DataFrame, id: str, text: str, fold: bool = False) -> DataFrame:
    """(id, tkey, pos, norm): every line that is not blank, in lower case with ``fold``; tkey tells texts of equal ids apart."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    # the text is hashed before its lines come apart, and their case goes after the blank ones, so that neither is done twice
    rows = rows.select("id", F.xxhash64("text").alias("tkey"), F.split("text", "\n").alias("parts"))
    rows = rows.select("id", "tkey", F.posexplode("parts").alias("pos", "line"))
    rows = rows.select("id", "tkey", "pos", normal(F.col("line")).alias("norm")).where("norm <> ''")
    return rows.withColumn("norm", F.lower("norm")) if fold else rows


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(cx, cy) of the pairs (x, y, cx, cy) whose shingle sets have a Jaccard similarity of SIMILAR or more; texts has (lid, norm)."""
    x, y = (texts.select(F.col("lid").alias(k), F.col("norm").alias(f"t{k}")) for k in "xy")
    both = pairs.join(x, "x").join(y, "y").select("cx", "cy", *[shingle_hashes(f"t{k}").alias(f"h{k}") for k in "xy"])
    both = both.select("cx", "cy", (F.size("hx") + F.size("hy")).alias("n"), F.size(F.array_intersect("hx", "hy")).alias("i"))
    return both.where(F.col("i") >= SIMILAR * (F.col("n") - F.col("i")) - 1e-9).select("cx", "cy")


def sketches(lines: DataFrame) -> DataFrame:
    """(lid, places, sketch): a bitmap of WORDS * 64 bits of each line's (lid, norm) shingles, hashed in generated code."""
    rows = lines.repartition("lid").select("lid", F.encode("norm", "UTF-32").alias("data"), F.size(_places("norm")).alias("places"), _places("norm").alias("at"))
    rows = rows.select("lid", "data", "places", F.explode("at").alias("i")).select("lid", "places", _at(F.col("data"), F.col("i")).alias("h"))
    word, bit = F.pmod(F.shiftrightunsigned("h", 6), F.lit(WORDS)).cast("int"), F.expr("shiftleft(1L, cast(h & 63 as int))")
    rows = rows.select("lid", "places", F.floor(word / PART).cast("int").alias("part"), (word % PART).alias("r"), bit.alias("bit"))
    rows = rows.groupBy("lid", "part").agg(F.max("places").alias("places"), *[F.bit_or(F.when(F.col("r") == r, F.col("bit"))).alias(f"b{r}") for r in range(PART)])
    bits = [F.coalesce(F.max(F.when(F.col("part") == k // PART, F.col(f"b{k % PART}"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(WORDS)]
    return rows.groupBy("lid").agg(F.max("places").alias("places"), *bits).select("lid", "places", F.struct(*[f"w{k}" for k in range(WORDS)]).alias("sketch"))


def _may_be_near(x: str, y: str, size: str = "places") -> Column:
    """False only of lines whose similarity is under SIMILAR; ``size`` is the number of shingles, or a bound of it.

    Sets of n shingles together that reach it differ in (1 - SIMILAR) / (1 + SIMILAR) * n of them at most, and each
    bit in which two bitmaps differ is another such shingle.
    """
    bits = sum((F.bit_count(F.col(f"sketch{x}.w{k}").bitwiseXOR(F.col(f"sketch{y}.w{k}"))) for k in range(WORDS)), F.lit(0))
    return bits <= (1 - SIMILAR) / (1 + SIMILAR) * (F.col(f"{size}{x}") + F.col(f"{size}{y}")) + 1e-9


def _once(pairs: DataFrame) -> DataFrame:
    """The pairs (x, y, cx, cy), each once and x the larger."""
    turned = F.col("x") < F.col("y")
    ends = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x", "y"), ("y", "x"), ("cx", "cy"), ("cy", "cx"))]
    return pairs.select(*ends).distinct()


def _prefix_pairs(late: DataFrame, texts: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """Pairs (x, y, cx, cy) of lines (lid, c) of different components c, among them every pair whose Jaccard similarity reaches SIMILAR.

    A line's shingles are ordered by how many lines have them, rarest first.  Of n shingles SIMILAR * n at least
    are in a near line too, so two near lines share one of the first n - SIMILAR * n + 1 of each.  The lengths and
    the places of a shared shingle bound what can still be shared, and so do the bitmaps ``drawn`` of the lines.
    """
    drawn = sketches(late.join(texts, "lid").select("lid", "norm")) if drawn is None else drawn
    rows = late.join(texts.select("lid", "norm"), "lid").repartition("lid").select("lid", "c", F.explode(shingle_hashes("norm")).alias("h"))
    # a shingle that one line alone has stays in the order, but finds nothing; counted in a window, as no join of all shingles is needed then
    of = Window.partitionBy("h")
    rows = rows.select("lid", "c", "h", F.count("*").over(of).alias("m"), (F.min("c").over(of) < F.max("c").over(of)).alias("mixed"))
    sets = rows.groupBy("lid", "c").agg(F.array_sort(F.collect_list(F.struct("m", "h", "mixed"))).alias("s")).withColumn("n", F.size("s"))
    sets = sets.join(drawn.drop("places"), "lid")
    first = F.slice("s", F.lit(1), (F.col("n") - F.ceil(SIMILAR * F.col("n") - 1e-9) + 1).cast("int"))
    posted = sets.select("lid", "c", "n", "sketch", F.posexplode(first).alias("place", "e")).where("e.mixed")
    posted = posted.select("lid", "c", "n", "sketch", "place", "e.h", F.ceil(F.col("e.m") / BLOCK).cast("int").alias("blocks"))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("lid"), F.col("blocks")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posted = posted.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "lid", "c", "n", "place", "sketch")
    posted = stored(posted, "posted")
    x, y = (posted.select("h", "i", "j", *[F.col(k).alias(f"{k}{t}") for k in ("block", "lid", "c", "n", "place", "sketch")]) for t in "xy")
    # y is the line of fewer shingles, of which still more must be shared
    y = y.where(F.col("ny") - F.col("placey") >= 2 * SIMILAR / (1 + SIMILAR) * F.col("ny") - 1e-9)
    both = x.join(y, ["h", "i", "j"]).where("(nx > ny or nx = ny and lidx > lidy) and cx <> cy and (i = j or blockx <> blocky)")
    shared = F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey"))
    both = both.where((shared >= SIMILAR / (1 + SIMILAR) * (F.col("nx") + F.col("ny")) - 1e-9) & (F.col("ny") >= SIMILAR * F.col("nx") - 1e-9) & _may_be_near("x", "y", "n"))
    return _once(both.select(F.col("lidx").alias("x"), F.col("lidy").alias("y"), "cx", "cy"))


def _components(pairs: DataFrame, texts: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node, component) of the verified pairs (x, y, cx, cy), joined with the components found before, of which x is in cx and y in cy.

    Only the components of the pairs are joined anew; a line alone is its own component.
    """
    pairs = stored(pairs, "pairs")
    both = pairs.select(F.explode(F.array("x", "y")).alias("lid")).distinct()
    links = _verified(pairs, texts.join(_small(both), "lid", "left_semi"))
    fresh = stored(connected_components(links.select(F.col("cx").alias("a"), F.col("cy").alias("b"))), "roots")
    discard(pairs)
    if roots is None:
        return fresh
    moved = _small(fresh.select(F.col("node").alias("component"), F.col("component").alias("to")))
    alone = fresh.join(roots.select("node"), "node", "left_anti")
    out = roots.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(alone)
    out = stored(out, "roots")
    for done in (roots, fresh):
        discard(done)
    return out


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, lid, n, c): the lines of buckets whose lines are of several components c."""
    own = members.join(roots, F.col("lid") == F.col("node"), "left").select("band", "lid", "n", F.coalesce("component", "lid").alias("c"))
    split = own.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band")
    return stored(own.join(split, "band"), "mixed")


def _line_roots(lines: DataFrame) -> DataFrame:
    """(node, component) of the lines (lid, norm) that are near another one."""
    posted = stored(short_bands(lines).unionByName(long_bands(lines)), "posted")
    release(lines.sparkSession)
    shared = posted.groupBy("band").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "lo", "n")
    shared = stored(shared, "bands")
    members = stored(posted.join(_small(shared), "band"), "members")
    wanted = stored(members.select("lid").distinct(), "wanted")
    texts = stored(lines.select("lid", "norm").join(_small(wanted), "lid", "left_semi"), "texts")

    release(lines.sparkSession)
    drawn = stored(sketches(texts), "sketches")
    x, y = (drawn.select(F.col("lid").alias(t), *[F.col(k).alias(f"{k}{t}") for k in ("places", "sketch")]) for t in "xy")
    firsts = members.select(F.col("lid").alias("x"), F.col("lo").alias("y")).where("x <> y").distinct()
    firsts = firsts.join(x, "x").join(y, "y").where(_may_be_near("x", "y"))
    roots = _components(firsts.select("x", "y", F.col("x").alias("cx"), F.col("y").alias("cy")), texts)
    release(lines.sparkSession)
    mixed = _mixed(members, roots)
    x, y = (mixed.join(drawn, "lid").select("band", F.col("lid").alias(t), *[F.col(k).alias(f"{k}{t}") for k in ("n", "c", "places", "sketch")]) for t in "xy")
    y = y.where((F.col("ny") <= SMALL) | (F.pmod(F.xxhash64(F.lit(2), "y"), F.ceil(F.col("ny") / LEADERS)) == 0))
    few = x.join(y, "band").where(((F.col("nx") > SMALL) | (F.col("x") > F.col("y"))) & (F.col("x") != F.col("y")) & (F.col("cx") != F.col("cy")) & _may_be_near("x", "y"))
    roots = _components(_once(few.select("x", "y", "cx", "cy")), texts, roots)
    large = _mixed(mixed.where(F.col("n") > SMALL).select("band", "lid", "n"), roots)
    late = stored(large.select("lid", "c").distinct(), "late")
    if not late.isEmpty():
        roots = _components(_prefix_pairs(late, texts, drawn), texts, roots)
    for done in (posted, shared, members, wanted, texts, mixed, drawn, large, late):
        discard(done)
    return roots


def line_components(docs: DataFrame, id: str = "doc_id", text: str = "text", fold: bool = False) -> DataFrame:
    """(id, tkey, pos, component, kept): every line that is not blank.

    Lines are equal if normal() makes them equal, and near if their shingle sets reach SIMILAR and they share a band
    (98 of 100 pairs do at a similarity of 0.8, more above, and all with at most FEW shingles), however many lines
    the band has.  ``fold`` compares without
    case.  ``kept`` marks the first line of a component by id (null first), text hash and place.  Null and empty
    texts have no lines; rows that repeat both id and text share their lines' fate.  A line's key is its 128-bit hash.
    """
    occurrences = lines_of(docs, id, text, fold)
    marks = stored(occurrences.withColumns({"k1": F.xxhash64("norm"), "k2": F.xxhash64(F.lit(1), "norm")}), "marks")
    place = F.struct("id", "tkey", "pos")
    lines = marks.groupBy("k1", "k2").agg(F.first("norm").alias("norm"), F.min(place).alias("first"))
    lines = stored(lines.withColumn("lid", F.monotonically_increasing_id()), "lines")
    release(docs.sparkSession)
    roots = _line_roots(lines.select("lid", "norm"))
    # only lines that are near another one have to look for their component's first line
    firsts = lines.select("k1", "k2", "lid", "first").join(_small(roots), F.col("lid") == F.col("node"), "left")
    keep = firsts.where("node is not null").groupBy("component").agg(F.min("first").alias("keep"))
    keep = stored(keep.select(F.col("component").alias("root"), "keep"), "keep")
    firsts = firsts.select("k1", "k2", "first", F.coalesce("component", "lid").alias("component"))
    fate = firsts.join(_small(keep), F.col("component") == F.col("root"), "left")
    fate = stored(fate.select("k1", "k2", "component", F.coalesce("keep", "first").alias("keep")), "fate")
    for done in (lines, roots, keep):
        discard(done)
    release(docs.sparkSession)
    out = marks.select("id", "tkey", "pos", "k1", "k2").join(fate, ["k1", "k2"])
    return out.select("id", "tkey", "pos", "component", place.eqNullSafe(F.col("keep")).alias("kept"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", fold: bool = True) -> DataFrame:
    """docs with each component's lines removed but for the first; all columns stay.  ``fold`` compares without case.

    Blank lines stay.  A document that loses a line and has no line left that is not blank is dropped; one
    without any such line from the start (null, empty, blank) stays.
    """
    lines = line_components(docs, id, text, fold)
    fates = F.array_sort(F.collect_list(F.struct("pos", "kept"))).alias("_fates")
    fates = lines.groupBy(F.col("id").alias("_fate_id"), F.col("tkey").alias("_fate_key")).agg(fates).where(F.exists("_fates", lambda x: ~x["kept"]))
    key = F.xxhash64(docs[text].cast("string"))
    rows = docs.join(fates, docs[id].eqNullSafe(fates["_fate_id"]) & (key == fates["_fate_key"]), "left")
    gone = F.transform(F.filter("_fates", lambda x: ~x["kept"]), lambda x: x["pos"])
    parts = F.split(docs[text].cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    fresh = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    alive = F.col("_fates").isNull() | F.exists("_fates", lambda x: x["kept"])
    fresh = F.when(F.col("_fates").isNull(), docs[text]).otherwise(fresh)
    return rows.where(alive).select(*[fresh.alias(c) if c == text else docs[c] for c in docs.columns])


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and fate of every line of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_components(docs, fold=True)
    return out.select(F.col("id").alias("doc_id"), F.col("pos").alias("line_no"), F.col("component").alias("component_id"), "kept")
