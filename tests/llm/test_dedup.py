"""SimHash, line and embedding duplicates against brute force; nulls, empties, repeats, clashing columns."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import components, linededup, pivotindex, shared, simhash

random.seed(7)
VOCABULARY = ["".join(random.choice("abcdefghiéñß") for _ in range(random.randint(2, 9))) for _ in range(300)]


def sentence(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [sentence(120) for _ in range(12)]
    rows = [(i, t, "x") for i, t in enumerate(base)]
    rows += [(20 + i, t.replace(VOCABULARY[3], VOCABULARY[4], 1) + " tail", "y") for i, t in enumerate(base[:6])]
    rows += [(40, base[0], "z"), (40, base[0], "z"), (None, base[1], None), (None, None, None), (50, None, "n"), (51, "", "e"), (52, " \n\t ", "b"), (53, "One", "s"), (54, "one", "s"), (55, sentence(9000), "long")]
    rows += [(60 + i, "Shared line of boilerplate that is quite long.\n" + sentence(20) + "\n\nshort", "l") for i in range(4)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumns({"fp": F.lit("clash"), "kept": F.lit(1), "node": F.lit(2), "flags": F.lit(3), "id": F.lit(4)})


def find(links, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    for r in docs.select("text").collect():
        assert simhash.fingerprint(r["text"]) == plain_fingerprint(r["text"])
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_trie_finds_all_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for b in base for _ in range(8)]
    dense = [1 << i for i in range(64)] + [0, 2**64 - 1]
    fps = sorted({*map(int, base), *near, *dense})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps] + [(None,)], "fp long")
    brute = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4}
    unsigned = lambda x: x % 2**64
    got = {tuple(sorted(map(unsigned, r))) for r in simhash.trie_links(df, forest=False).collect()}
    assert got == brute
    forest = [tuple(map(unsigned, r)) for r in simhash.trie_links(df).collect()]
    assert find(forest, fps) == find(brute, fps)
    assert {tuple(sorted(p)) for p in forest} <= {(a, b) for a in fps for b in fps if a < b}


def test_links_of_about_one_size(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for b in base for _ in range(8)})
    sizes = {x: {int(n) for n in rng.choice([1, 64, 79, 80, 99, 100, 125, 126], 1 + (k % 5 == 0))} for k, x in enumerate(fps)}
    part = {x: x % 3 for x in fps}
    rows = [(int(np.uint64(x).view(np.int64)), n, part[x]) for x in fps for n in sizes[x]]
    df = spark.createDataFrame([*rows, (None, 1, 0)], "fp long, size long, part long")
    brute = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 10 and any(min(n, m) >= 0.8 * max(n, m) for n in sizes[a] for m in sizes[b])}
    links = lambda **more: {tuple(sorted(x % 2**64 for x in r)) for r in simhash.trie_links(df, 10, size="size", similar=0.8, **more).collect()}
    assert links(forest=False) == brute and len(brute) > 50
    assert links(forest=False, known="part") == {(a, b) for a, b in brute if part[a] != part[b]}
    assert find(links(), fps) == find(brute, fps)


def test_a_node_compares_keys_of_about_one_size(monkeypatch):
    rng, n, seen, count = np.random.default_rng(3), 4000, [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (seen.append(x.size), count(x))[1])
    keys, node = rng.integers(0, 2**63, n, dtype=np.uint64), np.zeros(n, np.int64)
    sizes = np.sort(np.exp(rng.uniform(0, 10, n)).astype(np.int64))
    list(simhash.size_join(keys, node, sizes, 10, 0.8))
    assert 0 < sum(seen) < n * n / 2 / 8  # all pairs are n * n / 2
    # a large family of near keys is joined by a spanning forest, and each pair of another node is left out
    family = np.unique(keys[0] ^ np.array([1 << a | 1 << b for a in range(64) for b in range(64)], np.uint64))
    keys, node = np.concatenate((family, family)), np.repeat([0, 1], len(family))
    pairs = [np.concatenate(x) for x in zip(*simhash.size_join(keys, node, np.full(len(keys), 9), 10, 0.8), strict=True)]
    assert len(pairs[0]) == len(keys) - 2 and (node[pairs[0]] == node[pairs[1]]).all()
    assert len(set(find(zip(*(x.tolist() for x in pairs), strict=True), range(len(keys))).values())) == 2
    for text in ("", None, "One", "a b c d e", "a b c d e f", "a b a b a b a b a b", sentence(400) * 2):
        assert simhash.fingerprint_and_size(text, 5)[1] == len(simhash.shingle_set(text, 5))


def test_simhash_components(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = simhash.with_fingerprint(docs.select("doc_id", "text"))
    got = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(prints).where("doc_id is not null").collect())
    fps = {plain_fingerprint(r["text"]) for r in rows}
    root = find([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4], fps)
    low = {}
    for r in rows:
        if r["doc_id"] is not None:
            k = root[plain_fingerprint(r["text"])]
            low[k] = min(low.get(k, 10**9), r["doc_id"])
    want = sorted((r["doc_id"], (f := plain_fingerprint(r["text"])), low[root[f]]) for r in rows if r["doc_id"] is not None)
    assert got == want
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(low.values())


def test_near_texts_are_verified(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near = [], []
    for k in range(60):
        base = [word() for _ in range(300)]
        other = list(base)
        for _ in range(1 + k % 8):  # one edit costs five shingles of some 296
            other[rng.randrange(300)] = word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        a, b = (set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (base, other))
        near.append(len(a & b) / len(a | b))
    copies = [(1000 + i, rows[0][1] + " " + word()) for i in range(30)]
    rows += [*copies, (2000, None), (2001, ""), (2002, " \n"), (2003, rows[8][1]), (2003, rows[8][1]), (None, rows[8][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_t": F.lit(1), "fp": F.lit(2), "tid": F.lit("x"), "gone": F.lit(3)})
    out = simhash.near_dedup(docs, words=5, budget=10, similar=0.8)
    assert out.columns == docs.columns
    left = [r["doc_id"] for r in out.collect()]
    assert len(left) == len(set(left)) and None not in left
    left = set(left)
    assert all(2 * k in left for k in range(60))  # the first of each pair stays
    assert not any(2 * k + 1 not in left and x < 0.8 for k, x in enumerate(near))  # nothing else goes
    gone = [2 * k + 1 not in left for k, x in enumerate(near) if x >= 0.9]
    assert len(gone) >= 15 and sum(gone) >= 0.8 * len(gone)
    assert not left & ({i for i, _ in copies} | {2001, 2002, 2003}) and 2000 in left


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert simhash.near_dedup(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert pivotindex.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (1, 2), (2, 1), (9, 9), (None, 1), (7, 8), (8, 3), *((100 + i, 101 + i) for i in range(40))]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 7: 3, 8: 3, 1: 1, 2: 1} | {100 + i: 100 for i in range(41)}


def test_lines(docs):
    lines = {(r["id"], r["pos"]): r for r in linededup.line_components(docs.where("doc_id is not null and doc_id <> 40")).collect()}
    texts = {(r["doc_id"], i): x.strip(" \t\r\f\x0b") for r in docs.collect() if r["doc_id"] not in (None, 40) for i, x in enumerate((r["text"] or "").split("\n"))}
    texts = {k: v for k, v in texts.items() if v}
    assert set(lines) == set(texts)
    sets = {v: plain_shingles(v) for v in texts.values()}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = find(near, sets)
    first = {}
    for k in sorted(texts):
        first.setdefault(root[texts[k]], k)
    assert len(near) >= 5
    for k, r in lines.items():
        assert r["kept"] == (first[root[texts[k]]] == k)


def test_line_dedup_keeps_columns_and_whole_documents(docs):
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[50] == [None] and by[51] == [""] and by[52] == [" \n\t "]  # nothing to compare: they stay
    assert by[60][0].startswith("Shared line") and "short" in by[60][0]
    assert all("Shared line" not in by[i][0] and "short" not in by[i][0] and "\n" in by[i][0] for i in (61, 62, 63))
    assert 40 not in by and 20 not in by  # all of their lines are elsewhere
    assert by[55][0] == docs.where("doc_id = 55").first()["text"]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.05
    hot = base[0] + rng.normal(size=(400, 16)) * 0.02
    x = np.concatenate((base, near, hot)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, x[3].tolist()), (5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] + [1.0] * 15), (5005, [1.0] * 3), (None, x[4].tolist()), (5006, (x[7] * 1e-30).tolist())]
    got = {r["vec_id"]: r for r in pivotindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() if r["vec_id"] is not None}
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    unit = np.array([good[i] / np.abs(good[i]).max() for i in ids])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    brute = {i: int(link[k].sum()) - 1 for k, i in enumerate(ids)}
    assert all(got[i]["n_links"] <= brute.get(i, 0) for i in got)
    assert sum(got[i]["n_links"] for i in got) >= 0.9 * sum(brute.values())
    assert got[5000]["component_id"] == got[3]["component_id"] and got[5000]["n_links"] >= 1
    for i in (5001, 5002, 5003, 5004, 5005):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def plain_shingles(line, n=9):
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def test_large_line_buckets_are_searched_exactly(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    template = "The undersigned hereby confirms to the authority that " + " ".join(word() for _ in range(25)) + " "
    lines = []
    for _ in range(150):  # small near groups in the template's buckets
        tail = [word() for _ in range(12)]
        lines += [template + " ".join(tail), template + " ".join([*tail[:-1], tail[-1][:-1] + "z"])]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in linededup.line_components(df).collect()}
    sizes = linededup.long_bands(df.select(F.col("doc_id").alias("lid"), F.col("text").alias("norm"))).groupBy("band").count()
    assert sizes.agg(F.max("count")).first()[0] > linededup.SMALL
    assert sum(got[i] == got[i + 1] for i in range(0, 300, 2)) >= 149
    # the search itself misses no pair
    texts = df.select(F.xxhash64("text").alias("lid"), F.col("text").alias("norm"))
    pairs = {(r["x"], r["y"]) for r in linededup._prefix_pairs(texts.select("lid", F.col("lid").alias("c")), texts).collect()}
    keys = {r["norm"]: r["lid"] for r in texts.collect()}
    sets = {x: plain_shingles(x) for x in lines}
    near = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) >= 100
    assert {(max(keys[a], keys[b]), min(keys[a], keys[b])) for a, b in near} <= pairs


def test_large_near_group_is_joined_before_the_exact_search(spark, monkeypatch):
    """Lines that are near to some of their bucket only: few of their near pairs are left to the prefix filter, no link is lost."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    template = [word() for _ in range(100)]
    lines = []
    for k in range(300):
        own = list(template)
        for at in rng.sample(range(100), 1 + k % 5):  # two lines are near if at most five words are replaced in both together
            own[at] = word()
        lines.append(" ".join(own))
    sets = [plain_shingles(x) for x in lines]
    near = [(a, b) for a in range(300) for b in range(a + 1, 300) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found, search = [], linededup._prefix_pairs
    monkeypatch.setattr(linededup, "_prefix_pairs", lambda *a: found.append(search(*a).count()) or search(*a))
    monkeypatch.setattr(linededup, "BLOCK", 50)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in linededup.line_components(df).collect()}
    assert len(near) > 10_000 and all(got[a] == got[b] for a, b in near)
    assert len(set(got.values())) == len(set(find(near, list(range(300))).values()))
    assert sum(found) < 1000


def test_lines_by_plain_shingles(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu\u00e9\U0001f600") for _ in range(rng.randint(2, 8)))
    lines = []
    for k in range(240):
        a = " ".join(word() for _ in range(rng.randint(2, 20)))
        b = list(a)
        if k % 4 == 0:
            b.append(".")
        else:
            b[rng.randrange(len(b))] = "z"
        lines += [a, "".join(b)]
    lines += ["THE WHOLE OF THIS LINE is shouted", "the whole of this line IS SHOUTED", "ONE", "one"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in linededup.line_components(df, fold=True).collect()}
    sets = [plain_shingles(x.lower()) for x in lines]
    near = [len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, len(lines), 2)]
    found = [got[i] == got[i + 1] for i in range(0, len(lines), 2)]
    assert not any(f and not n for f, n in zip(found, near, strict=True))
    assert sum(found) >= 0.97 * sum(near) and near[-1] and near[-2] and found[-1] and found[-2]
    hashes = df.select(F.col("text").alias("line"), linededup.shingle_hashes("text").alias("h"), F.transform(F.array(*map(F.lit, sorted(plain_shingles(lines[0])))), lambda x: F.xxhash64(F.encode(x, "UTF-32"))).alias("w")).collect()
    assert {len(r["h"]) for r in hashes if r["line"] == lines[0]} == {len(plain_shingles(lines[0]))}
    assert all(len(r["h"]) == len(plain_shingles(r["line"])) and (r["line"] != lines[0] or set(r["h"]) == set(r["w"])) for r in hashes)


def test_line_plans_do_each_step_once(spark):
    """A text is hashed before its lines come apart, a line's case goes once, a long line's signature is summed in one step."""
    docs = spark.createDataFrame([(1, "One Line\n \t\n\tand ANOTHER  \n"), (2, None), (3, "")], "doc_id long, text string")
    lines = linededup.lines_of(docs, "doc_id", "text", fold=True)
    assert {(r["id"], r["pos"], r["norm"]) for r in lines.collect()} == {(1, 0, "one line"), (1, 2, "and another")}
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.index("xxhash64(") > plan.index("Generate")
    bands = linededup.long_bands(lines.select(F.col("pos").alias("lid"), "norm"))
    assert bands._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1


def test_long_lines_of_any_script_share_bands(spark):
    rng = random.Random(41)
    lines = []
    for k in range(200):  # Cyrillic, Chinese, Latin with accents and signs, in pairs of a similarity of 0.8 or more
        letters = ("\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438 ", "".join(map(chr, range(0x4E00, 0x4E80))), "etaoin\u00e9\u00fc\U0001f600 ")[k % 3]
        a = [rng.choice(letters) for _ in range(rng.randint(90, 160))]
        lines += ["".join(a), "".join([*a[:40], "x", *a[41:]])]
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, norm string")
    near = [i for i in range(0, 400, 2) if len(plain_shingles(lines[i]) & plain_shingles(lines[i + 1])) >= 0.8 * len(plain_shingles(lines[i]) | plain_shingles(lines[i + 1]))]
    bands = {}
    for r in linededup.long_bands(df).collect():
        bands.setdefault(r["lid"], set()).add(r["band"])
    assert len(near) >= 150 and sum(bool(bands[i] & bands[i + 1]) for i in near) >= 0.95 * len(near)


def test_line_recall_against_all_shingles(spark):
    """Pairs at 0.8 to 0.9, by kind: short lines with a letter more, lines of middling and of great length with a few edits."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    jaccard = lambda a, b: len(plain_shingles(a) & plain_shingles(b)) / len(plain_shingles(a) | plain_shingles(b))
    pairs = {"short": [], "middling": [], "long": []}
    while min(map(len, pairs.values())) < 150:
        for kind, n in (("short", rng.randint(12, 22)), ("middling", rng.randint(60, 100)), ("long", rng.randint(200, 900))):
            a = " ".join(word() for _ in range(n // 4))[:n].strip()
            if kind == "short":
                b = a + rng.choice("xyz")
            else:
                b = a
                for _ in range(max(1, n // 100)):
                    at = rng.randrange(len(b))
                    b = b[:at] + "#" + b[at + 1 :]
            if 0.8 <= jaccard(a, b) < 0.9 and len(pairs[kind]) < 150:
                pairs[kind].append((a, b))
    lines = [x for kind in pairs for p in pairs[kind] for x in p]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in linededup.line_components(df).collect()}
    for k, kind in enumerate(pairs):
        found = [got[i] == got[i + 1] for i in range(300 * k, 300 * (k + 1), 2)]
        assert sum(found) >= (150 if kind == "short" else 0.95 * 150), (kind, sum(found))


def test_few_pivots_lie_apart(spark):
    rng = np.random.default_rng(4)
    axis = np.eye(16)[0]
    two = np.array([axis, axis + 0.01])
    groups = np.concatenate([np.eye(16)[k] + rng.normal(size=(30, 16)) * 0.03 for k in (0, 1)])
    cone = axis + rng.normal(size=(400, 16)) * 0.11  # nearly all cosines exceed 0.8, part of them 0.9
    for x, least in ((two, 1), (groups, 1), (cone, 0.9)):
        x = x.astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = {r["vec_id"]: r["n_links"] for r in pivotindex.near_vectors(df).collect()}
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        brute = (unit @ unit.T >= 0.9).sum(axis=1) - 1
        assert all(got[i] <= n for i, n in enumerate(brute))
        assert sum(got.values()) >= least * brute.sum() > 0


def test_vector_links_against_all_pairs(spark, monkeypatch):
    """Two lengths, pairs planted at 0.9 to 0.93, a tight group over many blocks, repeated vectors."""
    monkeypatch.setattr(pivotindex, "BLOCK", 50)
    rng = np.random.default_rng(8)
    rows, brute, planted = [], {}, []
    for d, n in ((64, 1500), (24, 700)):
        base = rng.normal(size=(n, d))
        base /= np.linalg.norm(base, axis=1)[:, None]
        side = rng.normal(size=base.shape)
        side -= (side * base).sum(axis=1)[:, None] * base
        side /= np.linalg.norm(side, axis=1)[:, None]
        c = rng.uniform(0.901, 0.93, n)[:, None]
        group = base[0] + rng.normal(size=(300, d)) * 0.3 / d**0.5
        x = np.concatenate((base, c * base + np.sqrt(1 - c * c) * side, group, base[:20])).astype(np.float32)
        first = len(rows)
        rows += [(first + i, v.tolist(), "x", 1) for i, v in enumerate(x)]
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        brute |= {first + i: int(k) - 1 for i, k in enumerate((unit @ unit.T >= 0.9).sum(axis=1))}
        planted += [(first + i, first + n + i) for i in range(n)]
    # further columns, named as the operator's own, are left aside
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, perm string, p int")
    got = {r["vec_id"]: r for r in pivotindex.near_vectors(df).collect()}
    assert got.keys() == brute.keys() and all(got[i]["n_links"] <= n for i, n in brute.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(brute.values())
    assert sum(got[a]["component_id"] == got[b]["component_id"] for a, b in planted) >= 0.97 * len(planted)


def test_shared_pivots_are_counted():
    rng = np.random.default_rng(2)
    a, b = (np.array([rng.choice(40, 12, replace=False) for _ in range(n)]) for n in (30, 50))
    assert (pivotindex.shared_counts(a, b) == [[len({*x} & {*y}) for y in b.tolist()] for x in a.tolist()]).all()


def test_line_bitmaps_pass_every_near_pair(spark):
    """The bitmaps' bound holds for pairs at 0.8 or more of any length, and leaves few of the others."""
    draw = random.Random(8)
    lines = []
    for size in [9, 12, 30, 60, 120, 300, 900] * 12:
        a = "".join(draw.choice("abcdefgh ") for _ in range(size))
        b = list(a)
        for _ in range(draw.randint(1, 1 + size // 40)):
            b[draw.randrange(len(b))] = "z"
        lines += [a, "".join(b)]
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, norm string")
    x, y = (linededup.sketches(df).select(F.col("lid").alias(k), F.col("places").alias(f"places{k}"), F.col("sketch").alias(f"sketch{k}")) for k in "xy")
    passed = {(r["x"], r["y"]) for r in x.join(y, F.col("x") < F.col("y")).where(linededup._may_be_near("x", "y")).select("x", "y").collect()}
    sets = [plain_shingles(line) for line in lines]
    near = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near and near <= passed
    short = {(i, j) for i, j in passed if max(len(lines[i]), len(lines[j])) <= 300}
    assert len(short) < 2 * len(near) + 20


def test_release_deletes_the_shuffles_of_ended_jobs(spark):
    def shuffled():
        return sum(f.stat().st_size for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))

    shared.release(spark)
    before = shuffled()
    out = shared.stored(spark.range(200_000).select((F.col("id") % 100_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).groupBy("k").agg(F.first("v").alias("v")), "t")
    made = shuffled() - before
    shared.release(spark)
    assert made > 5_000_000 and shuffled() < before + made / 10
    assert out.count() == 100_003
