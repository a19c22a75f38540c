"""Language ID and toxicity: exact sums on small words, held-out accuracy, edge cases."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import langid, toxicity

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def all_segmentations(w, pieces, unknown):
    for cuts in itertools.product((0, 1), repeat=len(w) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(w[at:i])
                at = i
        parts.append(w[at:])
        numbers = [pieces.get(p, unknown if len(p) == 1 else None) for p in parts]
        if None not in numbers:
            yield numbers


def test_sums_over_all_segmentations():
    pieces = ["a", "ab", "abc", "b", "bc", "▁a", "▁ab", "c", "ca"]
    number = {p: i for i, p in enumerate(pieces)}
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces) + 1, 3))
    index, words = langid.Pieces(pieces), ["abc", "a", "zzz", "abcabc", "cab", "bazc"]
    want = [np.log(sum(np.prod(p[s], axis=0) for s in all_segmentations("▁" + w, number, len(pieces)))) for w in words]
    assert np.allclose(index.likelihoods(words, p), want)
    counts = np.array([1.0, 2, 3, 4, 5, 6])
    _, k, share = index.expected(words, counts, lambda x, piece: p[piece, 1])
    sums = np.bincount(k, share, len(pieces) + 1)
    brute = np.zeros(len(pieces) + 1)
    for w, n in zip(words, counts, strict=True):
        ways = list(all_segmentations("▁" + w, number, len(pieces)))
        weight = np.array([np.prod(p[s, 1]) for s in ways])
        for s, q in zip(ways, weight / weight.sum(), strict=True):
            for piece in s:
                brute[piece] += n * q
    assert np.allclose(sums, brute)


def test_long_words_are_summed_whole():
    pieces = sorted({"a", "ab", "b", "ba", "abab", "▁a", "▁ab", "bb"})
    rng = np.random.default_rng(4)
    p = rng.random((len(pieces) + 1, 2)) * 0.3
    index, number = langid.Pieces(pieces), {q: i for i, q in enumerate(pieces)}

    def plain(w):
        w = "▁" + w
        sums = [np.ones(2)]
        for j in range(1, len(w) + 1):
            sums.append(sum((sums[i] * p[k] for i in range(max(0, j - 4), j) if (k := number.get(w[i:j], len(pieces) if j - i == 1 else None)) is not None), np.zeros(2)))
        return np.log(sums[-1])

    words = ["ab" * 30, "abba" * 20 + "x", "b" * 33, "a" * 32, "ab"]
    assert np.allclose(index.likelihoods(words, p), [plain(w) for w in words])
    assert np.isfinite(index.likelihoods(["abz" * 5000], p)).all()
    few = ["abab", "bxab", "aabb"]
    for w in few:
        x, k, share = index.expected([w], np.array([2.0]), lambda x, piece: p[piece, 1])
        pieces_, shares = index.long(w, p[:, 1:2], 2.0)[1]
        assert np.allclose(np.bincount(k, share, len(p)), np.bincount(pieces_, shares[:, 0], len(p)))


def test_letters_are_of_category_l():
    assert langid.words("½ ② Ⅷ 3² ٣") == [] and langid.words("x² Ab½cd É") == ["x", "ab", "cd", "é"]


def test_languages_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    kinds = {"en": ["the", "cat", "and", "dog", "thethetheandthe" * 3], "fr": ["le", "chat", "et", "chien"]}
    rows = [(i, " ".join(rng.choice(kinds[k], 8)), k if i % 5 else None) for i in range(40) for k in [["en", "fr"][i % 2]]]
    rows += [(41, "½ ² ①", "en"), (42, None, "fr"), (43, "", None), (44, "the chat", None), (3, rows[3][1], rows[3][2])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.op3_langid(spark, str(tmp_path)).collect()}
    import zlib

    learned = [(t, k) for i, t, k in rows if k and zlib.crc32(str(i).encode()) % 4 != 2]
    pieces, languages = langid.vocabulary(), ["en", "fr"]
    number = {q: i for i, q in enumerate(pieces)}
    p = np.full((len(pieces) + 1, 2), 1 / len(pieces))
    p[-1] = langid.UNKNOWN

    def ways(w):
        """(from, to, piece) of a word."""
        w = "▁" + w
        return len(w), [(i, j, k) for j in range(1, len(w) + 1) for i in range(j) if (k := number.get(w[i:j], len(pieces) if j - i == 1 else None)) is not None]

    def forward(n, edges, q):
        a = [1.0] + [0.0] * n
        for i, j, k in edges:
            a[j] += a[i] * q[k]
        return a

    counts = {}
    for t, k in learned:
        for w in langid.words(t):
            counts[w, k] = counts.get((w, k), 0) + 1
    for _ in range(langid.ROUNDS):
        new = np.full_like(p, langid.ADDED)
        for (w, k), c in counts.items():
            q = p[:, languages.index(k)]
            n, edges = ways(w)
            a, b = forward(n, edges, q), [0.0] * n + [1.0]
            for at in range(n - 1, -1, -1):
                b[at] = sum(b[j] * q[piece] for i, j, piece in edges if i == at)
            for i, j, piece in edges:
                new[piece, languages.index(k)] += c * a[i] * q[piece] * b[j] / a[n]
        new[:-1] /= new[:-1].sum(axis=0)
        new[-1] = langid.UNKNOWN
        p = new
    totals = np.array([sum(c for (_, k), c in counts.items() if k == x) for x in languages], float)
    for i, t, _ in rows:
        found = langid.words(t)
        if not found:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        logs = np.log(totals / totals.sum()) + sum(np.array([np.log(forward(*ways(w), p[:, x])[-1]) for x in range(2)]) for w in found)
        odds = np.exp(logs - logs.max())
        assert got[i]["lang_pred"] == languages[int(odds.argmax())] and abs(got[i]["score"] - odds.max() / odds.sum()) < 1e-9
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert langid.op3_langid(spark, f"{tmp_path}/none").count() == 0


@tables
def test_languages_held_out(spark):
    got = langid.op3_langid(spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    row = got.join(truth, "doc_id").where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert row[0] > 200 and row[1] > 0.98


def test_languages_on_edge_cases(spark, tmp_path):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(8)] + [(10 + i, "le chat et le chien " * 5, "fr") for i in range(8)] + [(None, "der Hund", "de"), (30, None, "en"), (31, "", None), (32, "12 34 !?", "en"), (33, "LE CHAT" + "x" * 5000, None), (34, "the dog " * 40_000, None), (34, "the dog " * 40_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("s"), "_p": F.lit(0)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.op3_langid(spark, str(tmp_path)).collect()}
    assert len(got) == 22
    assert [got[i]["lang_pred"] for i in (30, 31, 32, 34)] == ["und", "und", "und", "en"]
    assert got[0]["lang_pred"] == "en" and got[10]["lang_pred"] == "fr" and all(0 <= r["score"] <= 1 for r in got.values())
    spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert [tuple(r) for r in langid.op3_langid(spark, f"{tmp_path}/none").collect()] == [(1, False, "und", 0.0)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = langid.identify(docs, langid.fit(docs))
    assert set(told.columns) == {*docs.columns, "lang_pred"}


def chars(words):
    counts = {}
    for w in words:
        w = "^^" + w + "^"
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + 50
    return toxicity.CharModel(counts)


def test_decodes_disguised_words():
    model = chars(["idiot", "moron", "trash", "scum", "hello", "world", "loser", "the"])
    for disguised, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("tr@$h", "trash"), ("s.c.u.m", "scum"), ("l0seeeer", "loser"), ("heeeello", "hello")):
        assert toxicity.decode(disguised, model) == word
    words = toxicity.Restorer(model).words("An i d i o t! THE*** $cum, m-o-r-o-n; www.x.y 2.0. trrrrash")
    assert {"idiot", "scum", "moron", "trash", "the", "an"} <= words
    assert toxicity.Restorer(model).words(None) == toxicity.Restorer(model).words("") == set()


def test_viterbi_is_the_best_path():
    model = chars(["abba", "baab", "aab"])
    token = "4bb@"
    best = -math.inf
    for letters in itertools.product(*toxicity.lattice(token)):
        w, cost = "".join(x for x, _ in letters), sum(c for _, c in letters)
        padded = "^^" + w
        total = cost + sum(model.logp(padded[i + 2], padded[i : i + 2]) for i in range(len(w))) + model.logp("^", padded[-2:])
        if total > best:
            best, word = total, w
    assert toxicity.decode(token, model) == word


def test_long_disguises_are_decoded_whole():
    model = chars(["idiot", "moron", "trash", "scum", "hello", "world", "loser", "the"])
    for disguised in ("1d1" + "0" * 60 + "t", "idio" + "o" * 60 + "t", "i" * 60 + "d1ot"):
        assert "idiot" in toxicity.Restorer(model).token(disguised), disguised
    spelled = " ".join("idiot" * 20)
    assert toxicity.Restorer(model).words(spelled) >= {"idiot" * 20}
    assert toxicity.decode("m0r0n" * 400, model) == "moron" * 400


def test_trigrams_of_all_letters_count(spark):
    docs = spark.createDataFrame([("héé 漢字漢字 Ωμέγα abc abc",), (None,), ("",)], "text string")
    model, plain = toxicity.char_model(docs), {}
    for w in ("héé", "漢字漢字", "ωμέγα", "abc", "abc"):
        w = "^^" + w + "^"
        for i in range(len(w) - 2):
            plain[w[i : i + 3]] = plain.get(w[i : i + 3], 0) + 1
    want = toxicity.CharModel(plain)
    assert all((getattr(model, t) == getattr(want, t)).all() for t in ("tri", "pair", "single"))
    import pickle

    again = pickle.loads(pickle.dumps(model))
    assert again.logp("字", "^漢") == model.logp("字", "^漢") > model.logp("x", "^漢")


def test_toxicity_without_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.op4_toxicity(spark, str(tmp_path)).count() == 0


@tables
def test_toxicity_held_out(spark):
    got = toxicity.op4_toxicity(spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(truth, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hits >= 0.7 * sum(r["toxic"] for r in rows) and hits >= 0.95 * sum(r["predicted"] for r in rows)


def test_toxicity_on_edge_cases(spark, tmp_path):
    rows = [(i, f"you are a moron {i}" if i % 3 == 0 else f"fine words here {i}") for i in range(60)] + [(100, None), (101, ""), (None, "moron"), (102, "m0r0n " * 30_000), (102, "m0r0n " * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("s"), "fold": F.lit(1), "y": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, None), (200, 1), (0, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[0] > by[1] and by[102] > by[100] == by[101]
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame(rows[:3], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert {r["predicted"] for r in toxicity.op4_toxicity(spark, f"{tmp_path}/none").collect()} == {0}


def test_scores_do_not_hang_on_the_cache(monkeypatch):
    """Words in marks, disguised, spelled apart and repeated say the same whatever the worker has kept; plain words are not decoded."""
    chars = toxicity.CharModel({t: 9 for w in ("idiot", "moron", "nice") for t in [("^^" + w + "^")[i : i + 3] for i in range(len(w) + 1)]})
    weights = {"idiot$": 2.0, "idio": 1.0, "moron": 1.5, "dog$": 0.5}
    texts = ["a nice day, (idiot)", "1d10t! and i d i o t", "(iiidiot), moronic", "DOG: dogs", "a b c", "x " * 9, "", None, "moron's *dog*"]
    model = toxicity.ToxicityModel(chars, weights, np.array([-4.0, 1.0, 1.0, 1.0, 0.1]))
    weigh = lambda w: max((weights.get(f, 0.0) for f in toxicity.features(w)), default=0.0)
    plain = []
    for text in texts:
        x = toxicity.evidence(toxicity.Restorer(chars).words(text), weigh, len(set((text or "").lower().split()))) @ model.coefficients
        plain.append(float(1 / (1 + np.exp(-x))))
    assert np.allclose([model.score(t) for t in texts], plain, rtol=1e-12)
    monkeypatch.setattr(toxicity, "CACHE", 3)
    assert np.allclose([model.score(t) for t in texts * 2], plain * 2, rtol=1e-12)
    decoded = []
    monkeypatch.setattr(toxicity.Restorer, "token", lambda self, token: decoded.append(token) or set())
    toxicity.ToxicityModel(chars, weights, model.coefficients).score('idiots, "idiomatic" (idiot)')
    assert not decoded
