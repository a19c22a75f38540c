"""Mixing, packing, and the pipeline."""

import os
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import linededup, mixing, packing, registry, simhash

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = con.execute(registry.ORACLE_SQL[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in result.fetchall()), key=repr)


def test_raking_plans_do_not_double_with_the_margins(spark, monkeypatch):
    """Each table is read for the sums and for what they scale: plans of several margins would hold the first one's many times over."""
    joins, store = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or store(df, name))
    cells = spark.createDataFrame([(a, b, c, 1 + a * b + c) for a in range(3) for b in range(2) for c in range(2)], "source int, lang int, topic int, tokens long")
    mixing.rake(cells, {m: mixing.tempered_targets(cells, m).localCheckpoint() for m in mixing.MARGINS}, rounds=2)
    assert joins[0] == 3 and set(joins[1:]) == {1} and len(joins) == 7


def test_rakes_to_the_margins(spark):
    rng = np.random.default_rng(0)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(1, 1000))) for i in range(4) for j in range(3) for k in range(2)], "source string, lang string, topic string, tokens long")
    want = {"source": [0.4, 0.3, 0.2, 0.1], "lang": [0.5, 0.25, 0.25], "topic": [0.9, 0.1]}
    targets = {m: spark.createDataFrame([(f"{m[0]}{i}", s) for i, s in enumerate(shares)], "value string, share double") for m, shares in want.items()}
    got = mixing.rake(cells, targets, rounds=30).toPandas()
    total = got.tokens.sum()
    assert np.isclose(got.raked.sum(), total)
    for m, shares in want.items():
        assert np.allclose(got.groupby(m).raked.sum().sort_index() / total, shares, atol=1e-6)


def test_mix_edge_cases(spark):
    rows = [(i, "word " * (i % 7 + 1), "a" if i % 3 else "b", "x") for i in range(300)] + [(1000, None, None, None), (1001, "", "b", None), (None, "one two", "a", "x"), (5, "again", "c", "x"), (5, "again", "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"weight": F.lit("w"), "tokens": F.lit(1), "raked": F.lit(2), "value": F.lit(3)})
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["source"] == "(none)" and by[1000]["n_tokens"] == 0 and by[1000]["weight"] == 0 and not by[1000]["kept"]
    assert max(r["probability"] for r in got) == 1 and all(0 <= r["probability"] <= 1 for r in got)
    assert all(r["kept"] for r in got if r["probability"] == 1)
    assert mixing.mix(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


def check_pieces(pieces, want, window=packing.WINDOW):
    """Each id once, sequences without gaps or overlaps; returns the tokens and the sequences' number."""
    by, sequences = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, lists in want.items():
        own = sorted(by[doc], key=lambda r: r["start"])
        got = sorted(bytes(r["ids"]) for r in own)
        assert sum(r["length"] for r in own) == sum(map(len, lists))
        if len(lists) == 1:
            assert b"".join(bytes(r["ids"]) for r in own) == np.array(lists[0], "<u4").tobytes()
            assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
            assert {r["doc_tokens"] for r in own} == {len(lists[0])}
        assert got
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window
    assert set(by) == set(want)
    return sum(r["length"] for r in pieces), len(sequences)


def test_packs_every_token_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    words = ["alpha", "beta", "Gamma.", "it's", "don't,", "naïve", "e\u0301te\u0301", "x\u00a0y", "tab\there", "<|endoftext|>", "ΟΔΟΣ.", "漢字", "!!", "a***", "3.14", "\u2028", "don'", "'s'"]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 900))) + ("\n" if i % 2 else "")) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long word " * 20_000), (None, "no id"), (103, "twice"), (103, "twice"), (104, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "shard": F.lit(2)})
    want = {}
    for doc, text in rows:
        want.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    pieces = packing.pack(docs).collect()
    tokens, sequences = check_pieces(pieces, want)
    assert sequences == -(-tokens // packing.WINDOW)  # only the last one is not full
    assert packing.pack(docs.limit(0)).count() == 0


def test_shards_split_repeated_rows_and_keep_neighbours(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rng = np.random.default_rng(8)
    topics = [["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(60)] for _ in range(12)]
    rows = [(i, " ".join(rng.choice(topics[i % 12], 80))) for i in range(240)] + [(500, "the same row again and again " * 10)] * 300 + [(600, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {}
    for doc, text in rows:
        want.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    total = sum(len(x) for v in want.values() for x in v)
    pieces = packing.pack(docs, window=512, shard_tokens=total // 8).collect()
    tokens, sequences = check_pieces(pieces, want, 512)
    shards = {r["sequence_id"] >> 32 for r in pieces}
    assert tokens == total and len(shards) >= 6 and sequences <= -(-tokens // 512) + len(shards)
    assert len({r["sequence_id"] >> 32 for r in pieces if r["doc_id"] == 500}) > 1
    home = {r["doc_id"]: r["sequence_id"] >> 32 for r in pieces if r["doc_id"] is not None and r["doc_id"] < 240}
    together = np.mean([home[a] == home[b] for a in home for b in home if a < b and a % 12 == b % 12])
    apart = np.mean([home[a] == home[b] for a in home for b in home if a % 12 != b % 12])
    assert together > 1.3 * apart


def test_words_of_letters_are_merged_as_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    rng = np.random.default_rng(3)
    letters = [c for c in map(chr, range(0x41, 0x250)) if packing.LATIN.fullmatch(c)]
    words = letters + ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(3000)] + ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 40))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)]
    assert packing.word_encoder(path)([w.lower() for w in words]) == want


def test_encodes_as_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), packing.encoder()
    words = ["The", "the.", "İ,", "İ", "É.", "e\u0301,", "don't,", "'S.", 'x"', "a<b,", "<|endoftext|>.", "ⅷ!", "٣.", "ǅ;", "…", "", "x\u2028y.", "tab\tb,"]
    for w in words:
        for v in words:
            text = f"{w} {v}\n{w}"
            assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_neighbours_come_by_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50, rng.integers(5, 60)).astype(np.uint32) for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
    idf, mean = np.log(1 + (40 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    index = packing.Index(docs, idf, mean)
    for seed in (0, 7):
        brute = []
        for d in docs:
            score = 0.0
            for term in set(docs[seed].tolist()):
                tf = int((d == term).sum())
                score += idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
            brute.append(score)
        assert np.allclose(index.scores(seed), brute)
    pieces = list(packing.pack_shard(docs, idf, mean, window=100))
    scores = index.scores(pieces[0][0])
    scores[pieces[0][0]] = -1
    assert pieces[1][0] == int(np.argmax(scores))
    assert sum(p[2] for p in pieces) == sum(map(len, docs))


# ---------------------------------------------------------------- pipeline


@tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.collect()}
        assert now and now <= before, name
        before = now
        kept.append(docs)
    assert kept[0].count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()  # all texts have a language
    lines = [x.strip() for r in kept[1].collect() for x in r["text"].split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in out} == before
    again = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    encode = packing.encoder()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out[:50]:
        ids = encode(texts[r["doc_id"]]) + np.array([packing.END], "<u4").tobytes()
        assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]


def test_line_stage_drops_only_copies(spark):
    docs = spark.createDataFrame([(1, "a line that stays\nand one more"), (2, "a line that stays\nits own line"), (3, "and one more")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == {1: "a line that stays\nand one more", 2: "its own line"}


def test_stages_on_edge_cases(spark, tmp_path):
    rng = np.random.default_rng(12)
    vocabulary = {k: ["".join(rng.choice(list(letters), 5)) for _ in range(300)] for k, letters in (("en", "abcdefg"), ("fr", "hijklmn"))}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k], n))
    rows = [(i, text("en" if i % 2 else "fr", 60) + "\n" + text("en" if i % 2 else "fr", 40), "en" if i % 2 else "fr", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "½ 12", None, "s1", 4), (103, text("en", 90), None, None, None), (None, text("fr", 90), "fr", "s1", 3)]
    rows += [(104, rows[3][1], "en", "s1", 1), (105, text("en", 20_000), "en", "s2", 2), (106, text("en", 50), "en", "s0", 1), (106, text("en", 50), "en", "s0", 1)]
    rows += [rows[-1]]
    clash = ["score", "lang_pred", "weight", "kept", "probability", "topic", "n_tokens", "_t", "fp", "ids", "near", "norm", "pos"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in clash})
    for table in (docs, docs.limit(0)):
        now = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = corpus_pipeline.stored(stage(spark, now, str(tmp_path)), "edge")
            if k < 4:
                assert now.columns == docs.columns, name
                assert now.where(" or ".join(f"{c} <> '{c}'" for c in clash)).isEmpty(), name
                ids = [r["doc_id"] for r in now.collect()]
                if k == 0 and table is docs:
                    assert not {100, 101, 102} & set(ids) and {103, 105, 106} <= set(ids) and ids.count(106) == 3 and None in ids
                if k == 2 and table is docs:
                    assert 104 not in ids and ids.count(106) <= 2 and 105 in ids
        assert (now.count() == 0) == (table is not docs)
    direct = [r["doc_id"] for r in simhash.near_dedup(docs, words=5, budget=10, similar=0.8).collect()]
    assert {*range(40), 100, 102, 103, 105, None} <= set(direct) and not {101, 104} & set(direct) and direct.count(106) == 2
