"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints that link differ in at most ``budget`` bits, so of ``budget + 2`` blocks at least two agree.  For
every pair of blocks the bits are reordered with those two in front; equal fronts are the same trie node, with
no error spent.  Below that node the sub-trie is joined with itself: node pairs go down together, a pair of
unlike children costs one bit, and a pair beyond the budget is cut off.  Buckets hold distinct fingerprints, so
a group of copies, however large, is one entry of a bucket.

A wide budget cuts off next to nothing below a node, and nodes grow with the input.  Where links are verified by their
texts' shingle sets, only fingerprints whose sets are of about one size are compared in a node, in blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.components import connected_components
from graphloom.llm.shared import discard, stored

SEED = 42
BITS = 64
#: Shingles hashed at a time, and node pairs held at a time.
BLOCK, FRONTIER = 1 << 16, 1 << 20
#: Keys that size_join() compares at a time, with how many, and the links after which it renews its components.
ROWS, COLUMNS, RENEWED = 64, 4096, 1 << 16
_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 if it has no word.

    A-Z are lowered, words end at ASCII white space, shingles count as often as they occur and a text of fewer
    words is one shingle.
    """
    return fingerprint_and_size(text, words, False)[0]


def fingerprint_and_size(text: str | None, words: int = 4, sized: bool = True) -> tuple[int, int]:
    """fingerprint() and, with ``sized``, the number of different shingles (of their hashes): 1 if the text has no word."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0, 1
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    width = min(words, len(parts))
    first, last = starts[: len(parts) - width + 1], (starts + lengths)[width - 1 :]
    count, digest, hashes = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest, []
    for at in range(0, len(first), BLOCK):
        pairs = zip(first[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), "<u8", min(BLOCK, len(first) - at))
        if sized:
            hashes.append(h)
        if len(h) < 256:
            count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            octets = h.view(np.uint8).reshape(-1, 8)
            for k in range(8):
                count[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _TABLE
    size = 1 + int(np.count_nonzero(np.diff(np.sort(np.concatenate(hashes))))) if sized else 1
    return sum(1 << i for i in np.flatnonzero(2 * count > len(first)).tolist()), size


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", words: int = 4, size: str | None = None) -> DataFrame:
    """Adds the fingerprint of ``text`` as a long (its 64 bits); null and empty texts have 0.

    ``size`` names a further long column: how many different shingles the text has.
    """
    new = [name, *[size] * bool(size)]
    rest = [c for c in docs.columns if c not in (text, *new)]
    source = docs.select(*rest, F.col(text).cast("string").alias(name))
    schema = docs.select(*rest, *[F.lit(0).cast("long").alias(c) for c in new]).schema

    def run(batches):
        for b in batches:
            values = [fingerprint_and_size(x.as_py(), words, bool(size)) for x in b.column(len(rest))]
            fps = pa.array(np.array([x for x, _ in values], np.uint64).view(np.int64))
            sizes = [pa.array([n for _, n in values], pa.int64())] * bool(size)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fps, *sizes], names=[*rest, *new])

    return source.mapInArrow(run, schema)


def _blocks(count: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each block."""
    ends = [BITS * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _reordered(fps: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints (uint64) with their bits in the order of the blocks (lowest bit, bits), the first blocks highest."""
    out, place = np.zeros(len(fps), np.uint64), BITS
    for low, n in order:
        place -= n
        out |= ((fps >> np.uint64(low)) & np.uint64((1 << n) - 1)) << np.uint64(place)
    return out


def _stars(pairs_a: np.ndarray, pairs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the pairs (indices)."""
    nodes, where = np.unique(np.concatenate((pairs_a, pairs_b)), return_inverse=True)
    a, b = where[: len(pairs_a)], where[len(pairs_a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def trie_join(keys: np.ndarray, groups: np.ndarray, level: int, budget: int, forest: bool = True, known: np.ndarray | None = None, leaf: int = 16):
    """Yields index arrays (i, j) of linked pairs among sorted ``keys`` (uint64) of each group.

    groups[g] to groups[g + 1] are the rows of a node whose keys agree above bit ``level``.  With ``forest`` the
    pairs are a spanning forest of the links, else all links.  ``known`` gives each key a component: pairs within one
    are left out, and node pairs of one component alone are cut off.  Node pairs with at most ``leaf`` pairs of keys
    are compared key by key.
    """
    changes = np.cumsum(known[1:] != known[:-1]) if known is not None and len(known) > 1 else np.zeros(max(0, len(keys) - 1), np.int64)
    changes = np.concatenate(([0], changes))
    lo, hi = groups[:-1], groups[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    work = [(level, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    found_a, found_b, held = [], [], 0
    while work:
        level, alo, ahi, blo, bhi, err = work.pop()
        if len(alo) > max(1, FRONTIER * 16 // max(16, leaf)):
            half = len(alo) // 2
            work += [(level, *(x[half:] for x in (alo, ahi, blo, bhi, err))), (level, *(x[:half] for x in (alo, ahi, blo, bhi, err)))]
            continue
        # node pairs of a few keys are compared directly
        if known is not None:
            one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (known[alo] == known[blo])
            alo, ahi, blo, bhi, err = (x[~one] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
        small = (ahi - alo) * (bhi - blo) <= leaf if level >= 0 else np.ones(len(alo), bool)
        if small.any():
            n, m = (ahi - alo)[small], (bhi - blo)[small]
            which = np.repeat(np.arange(len(n)), n * m)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            i, j = alo[small][which] + inner // m[which], blo[small][which] + inner % m[which]
            keep = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if known is not None:
                keep &= known[i] != known[j]
            found_a.append(i[keep])
            found_b.append(j[keep])
            held += int(keep.sum())
            if held > FRONTIER:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                if forest:
                    a, b = _stars(a, b)
                    found_a, found_b, held = [a], [b], 0
                else:
                    yield a, b
                    found_a, found_b, held = [], [], 0
            big = ~small
            alo, ahi, blo, bhi, err = (x[big] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        bit = np.uint64(1 << level)
        above = ~np.uint64((1 << (level + 1)) - 1)
        amid = np.clip(np.searchsorted(keys, (keys[alo] & above) | bit), alo, ahi)
        bmid = np.clip(np.searchsorted(keys, (keys[blo] & above) | bit), blo, bhi)
        own = alo == blo
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        parts.append(tuple(x[~own] for x in (amid, ahi, blo, bmid, err + 1)))
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (alo < ahi) & (blo < bhi) & (err <= budget) & ~((alo == blo) & (ahi - alo < 2))
        work.append((level - 1, *(x[keep] for x in (alo, ahi, blo, bhi, err))))
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if len(a):
            yield _stars(a, b) if forest else (a, b)


def size_join(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, budget: int, similar: float, forest: bool = True, known: np.ndarray | None = None):
    """Yields index arrays (i, j) of linked pairs among the ``keys`` (uint64) of each node, of whose sizes the smaller is ``similar`` times the larger at least.

    Rows come in order of their nodes, and of their sizes within a node, so a key's partners are a range.  A key may
    come with several sizes, and is not linked with itself.  With ``forest`` the pairs are a spanning forest of the
    links, else all links; ``known`` gives each key a component: pairs within one are left out.
    """
    node = np.cumsum(np.concatenate(([0], nodes[1:] != nodes[:-1])))
    most = np.minimum((sizes + 1e-6) / max(similar, 1e-9), 2**31 - 1).astype(np.int64)
    ends = np.searchsorted(node << 32 | sizes, node << 32 | most, "right")
    own = np.arange(len(keys))  # a row's component in the forest
    found_a, found_b, held = [], [], 0
    for at in range(0, len(keys), ROWS):
        to = min(at + ROWS, len(keys))
        last = int(ends[at:to].max())
        for low in range(at, last, COLUMNS):
            high = min(low + COLUMNS, last)
            near = np.bitwise_count(keys[at:to, None] ^ keys[low:high]) <= budget
            if np.count_nonzero(near) == (to - at) * (low == at):  # none but the rows themselves
                continue
            for label in [own] * forest + [known] * (known is not None):
                near &= label[at:to, None] != label[low:high]
            i, j = near.nonzero()
            i, j = i + at, j + low
            keep = (i < j) & (j < ends[i]) & (keys[i] != keys[j])
            if not forest:
                yield i[keep], j[keep]
                continue
            found_a.append(i[keep])
            found_b.append(j[keep])
            held += len(found_a[-1])
            if held > RENEWED:
                a, b = _stars(np.concatenate(found_a), np.concatenate(found_b))
                own[a] = b
                found_a, found_b, held = [a], [b], 0
    if any(len(x) for x in found_a):
        yield _stars(np.concatenate(found_a), np.concatenate(found_b))


def trie_links(fps: DataFrame, budget: int = 4, fp: str = "fp", forest: bool = True, known: str | None = None, size: str | None = None, similar: float = 0.0) -> DataFrame:
    """(a, b): links of the distinct fingerprints in the long column ``fp``; nulls take no part.

    ``known`` names a long column of components: links within one are left out.  ``size`` names a long column: only
    fingerprints of whose sizes the smaller is ``similar`` times the larger at least are linked.

    With ``forest`` (for components) each bucket gives a spanning forest of its links: as many rows as it has
    fingerprints at most, and the same components.  Without it every linked pair comes, at least once.
    """
    blocks = _blocks(budget + 2)
    labelled = ["known"] * bool(known) + ["size"] * bool(size)
    one = fps.select(F.col(fp).alias("fp"), *[F.col(c).alias(n) for c, n in ((known, "known"), (size, "size")) if c]).where("fp is not null").distinct()
    fronts = list(combinations(blocks, 2))
    widths = [sum(n for _, n in front) for front in fronts]
    orders = [[*front, *(b for b in blocks if b not in front)] for front in fronts]

    def posted(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for t, order in enumerate(orders):
                key = _reordered(fps, order)
                node = (key >> np.uint64(BITS - widths[t])).astype(np.int64)
                columns = [pa.array(np.full(len(key), t, np.int32)), pa.array(node), pa.array(key.view(np.int64)), *b.columns[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "node", "key", *labelled])

    rows = one.mapInArrow(posted, "t int, node long, key long" + "".join(f", {c} long" for c in labelled))
    # keys are unsigned; those of a node agree in the front, so their order as longs is right within a node
    rows = rows.repartition("t", "node").sortWithinPartitions("t", "node", "size" if size else "key")

    def back(keys: np.ndarray, t: int) -> np.ndarray:
        """The fingerprints of reordered keys."""
        out, place = np.zeros(len(keys), np.uint64), BITS
        for low, n in orders[t]:
            place -= n
            out |= ((keys >> np.uint64(place)) & np.uint64((1 << n) - 1)) << np.uint64(low)
        return out.view(np.int64)

    def joined(table: np.ndarray, node: np.ndarray, keys: np.ndarray, *labels: np.ndarray):
        keys = keys.view(np.uint64)
        for t in np.unique(table):
            mine = table == t
            k, nodes, of = keys[mine], node[mine], {c: x[mine] for c, x in zip(labelled, labels, strict=True)}
            if size:
                links = size_join(k, nodes, of["size"], budget, similar, forest, of.get("known"))
            else:
                # nodes come as unsigned numbers in order, and keys in order within a node
                groups = np.concatenate((np.flatnonzero(np.diff(nodes, prepend=nodes[0] - 1)), [len(nodes)]))
                links = trie_join(k, groups, BITS - widths[t] - 1, budget, forest, of.get("known"))
            for i, j in links:
                a, b = back(k[i], t), back(k[j], t)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            now = tuple(b.column(c).to_numpy() for c in range(b.num_columns))
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True)) if held else now
            if len(now[0]) < BLOCK:
                held = now
                continue
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])  # the last node may go on in the next batch
            cut = int(np.argmax(last))
            if cut:
                yield from joined(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held and len(held[0]):
            yield from joined(*held)

    return rows.mapInArrow(run, "a long, b long")


def _groups(prints: DataFrame, budget: int) -> DataFrame:
    """(_fp, root): the component of each distinct fingerprint."""
    roots = connected_components(trie_links(prints, budget))
    one = prints.where("fp is not null").select("fp").distinct()
    return one.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("root"))


def simhash_components(prints: DataFrame, id: str = "doc_id", fp: str = "fp", budget: int = 4) -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id that links reach, the row's own included.

    Rows with equal fingerprints are linked.  Rows with null fingerprints are alone; a component without any
    non-null id has a null component_id.
    """
    prints = prints.select(F.col(id).alias(id), F.col(fp).alias("fp"))
    least = prints.where("fp is not null").groupBy("fp").agg(F.min(id).alias("low"))
    least = least.join(_groups(prints, budget), F.col("fp") == F.col("_fp")).select("fp", "low", "root")
    lows = least.groupBy("root").agg(F.min("low").alias("component_id"))
    names = least.join(lows, "root").select(F.col("fp").alias("_fp"), "component_id")
    out = prints.join(names, F.col("fp") == F.col("_fp"), "left")
    return out.select(id, "fp", F.when(F.col("fp").isNull(), F.col(id)).otherwise(F.col("component_id")).alias("component_id"))


def shingle_set(text: str | None, words: int) -> set[tuple]:
    """A text's word shingles: A-Z lowered, words end at ASCII white space, fewer words are one shingle, none is none."""
    parts = (text or "").encode().lower().split()
    return set(zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) > words else {tuple(parts)}


def _similar_pairs(pairs: DataFrame, bodies: DataFrame, words: int, similar: float) -> DataFrame:
    """The pairs (a, b) of texts whose word-shingle sets have a Jaccard similarity of ``similar`` or more; bodies has (tid, text)."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    for k in "ba":
        pairs = pairs.join(bodies.select(F.col("tid").alias(k), F.col("text").alias(f"t{k}")), k)

    def run(batches):
        last = object(), set()  # pairs come in order of a task's join, often with one text many times
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                if last[0] != x:
                    last = x, shingle_set(x, words)
                other = shingle_set(y, words)
                keep.append(len(last[1] & other) >= similar * len(last[1] | other) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _text_roots(texts: DataFrame, docs: DataFrame, budget: int, words: int, similar: float | None) -> DataFrame:
    """(node, component) of the distinct texts (tid, fp, size, _t, _u) that links join; docs has (_t, _u, text).

    Sets of a similarity of ``similar`` have sizes of that ratio at least, so the join leaves out other pairs.
    First the links of a spanning forest are verified, then all links between texts that these did not join.
    """
    reps = texts.groupBy("fp").agg(F.min("tid").alias("rep"))
    named = lambda links: links.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = texts.join(reps, "fp").where("tid <> rep").select(F.col("tid").alias("a"), F.col("rep").alias("b"))
    bound = {} if similar is None else {"size": "size", "similar": similar}
    pairs = stored(named(trie_links(texts, budget, **bound)).unionByName(equal), "pairs")
    if similar is None:
        return stored(connected_components(pairs), "roots")

    def bodies(ids: DataFrame) -> DataFrame:
        wanted = texts.join(ids.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), "tid", "left_semi").select("tid", F.col("_t").alias("_t1"), F.col("_u").alias("_u1"))
        found = docs.join(wanted, (F.col("_t") == F.col("_t1")) & (F.col("_u") == F.col("_u1"))).select("tid", "text")
        return stored(found.dropDuplicates(["tid"]), "bodies")

    some = bodies(pairs)
    roots = stored(connected_components(_similar_pairs(pairs, some, words, similar)), "roots")
    own = texts.join(roots, F.col("tid") == F.col("node"), "left").select("tid", "fp", "size", F.coalesce("component", "tid").alias("c"))
    own = stored(own, "own")
    # a fingerprint of texts of several components has none of its own
    labels = own.groupBy("fp").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("tid").alias("tid"), F.collect_set("size").alias("sizes"))
    labels = labels.select("fp", F.explode("sizes").alias("size"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("tid")).alias("known"))
    links = trie_links(labels, budget, forest=False, known="known", **bound)
    split = labels.where("known < 0").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    x, y = (own.select(F.col("fp").alias(k), F.col("tid").alias(f"t{k}"), F.col("c").alias(f"c{k}")) for k in "ab")
    late = links.unionByName(split).distinct().join(x, "a").join(y, "b").where("ca <> cb").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    late = stored(late.distinct(), "late")
    more = bodies(late)
    verified = _similar_pairs(late, more, words, similar).unionByName(roots.select(F.col("node").alias("a"), F.col("component").alias("b")))
    out = stored(connected_components(verified), "roots")
    for done in (pairs, some, roots, own, late, more):
        discard(done)
    return out


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4, similar: float | None = None) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (nulls last), then the smallest text hash.

    Texts link if their fingerprints differ in at most ``budget`` bits and, with ``similar``, their sets of shingles of
    ``words`` words have that Jaccard similarity or more.  All columns stay, whatever their names.  Null and empty
    texts are equal texts here, so one of them stays.  Of rows that repeat both id and text one stays.  A text's key
    is its 128-bit hash.  At a similarity of 0.8, 0.9 and 0.95 and a budget of 10 some 6, 9 and 10 of 10 pairs are found.
    """
    body = F.col(text).cast("string")
    key = docs.select(F.col(id).alias("_id"), F.xxhash64(body).alias("_t"), F.xxhash64(F.lit(1), body).alias("_u"), body.alias("text"))
    prints = stored(with_fingerprint(key, words=words, size=None if similar is None else "size"), "prints")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_t").alias("t"), F.col("_u").alias("u"))
    texts = prints.groupBy("_t", "_u").agg(*[F.min(c).alias(c) for c in prints.columns if c in ("fp", "size")], F.min(order).alias("low"))
    texts = stored(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    roots = _text_roots(texts, key, budget, words, similar)
    own = texts.join(roots, F.col("tid") == F.col("node"), "left").select("_t", "_u", "low", F.coalesce("component", "tid").alias("root"))
    first = own.groupBy("root").agg(F.min("low").alias("first"), F.count("*").alias("n"))
    firsts = own.join(first, "root").select(F.col("_t").alias("_t1"), F.col("_u").alias("_u1"), "first")
    gone = prints.join(firsts, (F.col("_t") == F.col("_t1")) & (F.col("_u") == F.col("_u1"))).where(order != F.col("first"))
    gone = stored(gone.select(F.col("_id").alias("_gone"), F.col("_t").alias("_gone_t"), F.col("_u").alias("_gone_u")).distinct(), "gone")
    same = docs[id].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text].cast("string")) == gone["_gone_t"]) & (F.xxhash64(F.lit(1), docs[text].cast("string")) == gone["_gone_u"])
    out = docs.join(gone, same, "left_anti")
    if not prints.groupBy("_id", "_t", "_u").count().where("count > 1").isEmpty():
        mark = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
        out = out.withColumn(mark, F.xxhash64(F.col(text).cast("string"))).dropDuplicates([id, mark]).drop(mark)
    for done in (prints, texts, roots):
        discard(done)
    return out


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = simhash_components(stored(with_fingerprint(docs), "prints"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
