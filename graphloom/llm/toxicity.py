"""Toxicity with a noisy-channel decoder in front.

Disguised words (digits and signs for letters, letters spelled apart, letters repeated) become lattices of
letters; a Viterbi search under a character trigram model of the corpus picks the likeliest word, however long.
The restored text is scored by weighted word and word-beginning evidence that labelled rows give.

A text is cut at white space.  What a token says is worked out once and kept by the worker, so most of a text is
looked up; counts over the corpus are taken of distinct tokens.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrowio import HELD, arrow_schema, batch, in_fold, replaced
from graphloom.llm.shared import discard, stored

# Letters that a digit or sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l",
}
SIGNS = "".join(re.escape(c) for c in LEET)
LETTER = r"[^\W\d_]"
WORD = re.compile(rf"{LETTER}+")
#: Letters spelled apart within a token; a word with digits or signs inside or in front; a letter three times or more.
SPACED = re.compile(rf"(?<![^\W_])(?:(?:{LETTER}|[{SIGNS}])(?P<s>[.\-_*]))(?:(?:{LETTER}|[{SIGNS}])(?P=s)){{2,}}(?:{LETTER}|[{SIGNS}])(?![^\W_])")
MIXED = re.compile(rf"[{SIGNS}]+{LETTER}(?:{LETTER}|[{SIGNS}]|[.\-_*](?={LETTER}))*|{LETTER}+(?:[{SIGNS}]|[.\-_*](?={LETTER}))(?:{LETTER}|[{SIGNS}]|[.\-_*](?={LETTER}))*")
#: Signs repeated at the end of a word, and closing marks, are no letters.
TAIL = re.compile(rf"([{SIGNS}])\1+$|[!+|(]+$")
REPEAT = re.compile(rf"({LETTER})\1\1")
#: Log-probabilities of the channel: a sign for a letter, a letter doubled out of a longer run.
SIGN_COST, DOUBLE_COST = math.log(0.05), math.log(0.2)
#: Marks around a word that are no part of it; letters spelled apart are at least so many tokens.
BEFORE, BEHIND, APART = "\"'([{*#-_", ".,;:?!\"')]}*%#&-_", 4
#: As many tokens of one letter in a row as a word spelled apart has without its first and last.
SINGLES = b"\1" * (APART - 2)
#: Cells that trigrams, and letter pairs, are counted in, by their hash: a bound for any alphabet that drops no letter.
CELLS = 1 << 20
EDGE = "^"
#: Labelled rows that the classifier is fitted on, at most: those with the smallest hashes of their id.
MOST_LABELLED = 40_000
#: Folds of the cross-fit, least labelled toxic rows with a feature, standard errors taken off its weight.
FOLDS, LEAST_ROWS, CAUTION = 4, 3, 1.5
SHORTEST_STEM, LONGEST_STEM = 4, 8
CACHE = 400_000


def cell(letters: str) -> int:
    return zlib.crc32(letters.encode()) % CELLS


class CharModel:
    """Trigram counts of letters within words, in hashed cells; unseen ones back off to the letter's own frequency.

    ``counts`` maps trigrams to counts; of_cells() takes what Spark has summed by cell.
    """

    def __init__(self, counts: dict[str, int]):
        tri, pair, single = Counter(), Counter(), Counter()
        for t, n in counts.items():
            tri[cell(t)] += n
            pair[cell(t[:2])] += n
            single[cell(t[2])] += n
        self._set(tri, pair, single)

    @classmethod
    def of_cells(cls, kind: np.ndarray, cells: np.ndarray, n: np.ndarray) -> CharModel:
        model = cls({})
        model._set(*(dict(zip(cells[kind == k].tolist(), n[kind == k].tolist(), strict=True)) for k in (3, 2, 1)))
        return model

    def _set(self, *tables: dict[int, int]) -> None:
        self.tri, self.pair, self.single = (np.zeros(CELLS, np.int64) for _ in range(3))
        for table, counts in zip((self.tri, self.pair, self.single), tables, strict=True):
            if counts:
                table[list(counts)] = list(counts.values())
        self.total, self._known = int(self.single.sum()), {}

    def __getstate__(self) -> tuple:
        return tuple((np.flatnonzero(t), t[np.flatnonzero(t)]) for t in (self.tri, self.pair, self.single))

    def __setstate__(self, state: tuple) -> None:
        self._set(*(dict(zip(k.tolist(), n.tolist(), strict=True)) for k, n in state))

    @cached_property
    def restorer(self) -> Restorer:
        return Restorer(self)

    def logp(self, c: str, before: str) -> float:
        got = self._known.get(before + c)
        if got is None:
            own = (self.single[cell(c)] + 0.1) / (self.total + 10)
            got = math.log((self.tri[cell(before + c)] + 5 * own) / (self.pair[cell(before)] + 5))
            if len(self._known) >= CACHE:
                self._known.clear()
            self._known[before + c] = got
        return got


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one symbol in a lower-cased token, the letters it may be, with the channel's log-probability."""
    steps = []
    for run in re.finditer(r"(.)\1*", token, re.S):
        c, n = run[1], len(run[0])
        if c.isalpha():
            options = [(c, 0.0), (c * 2, DOUBLE_COST)] if n > 2 else [(c * n, 0.0)]
        elif c in LEET:
            options = [(x * k, SIGN_COST + (k - 1) * math.log(0.5)) for x in LEET[c] for k in range(1, min(n, 2) + 1)]
        else:
            continue  # a separator
        steps.append(options)
    return steps


def decode(token: str, model: CharModel) -> str:
    """The likeliest word behind a disguised token (Viterbi over the last two letters, ties by the letters of the last step).

    A state keeps its best way by a link to the state before it, so the time is in proportion to the length.
    """
    best: dict[str, tuple[float, tuple | None]] = {EDGE * 2: (0.0, None)}
    logp = model.logp
    for options in lattice(token.lower()):
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, way) in best.items():
            for letters, cost in options:
                s, now = score + cost, state
                for c in letters:
                    s += logp(c, now)
                    now = now[1] + c
                if now not in after or s > after[now][0] or (s == after[now][0] and letters > after[now][1][0]):
                    after[now] = (s, (letters, way))
        best = after
    _, way = max(((s + logp(EDGE, now), way) for now, (s, way) in best.items()), key=lambda x: x[0], default=(0, None))
    parts = []
    while way:
        letters, way = way
        parts.append(letters)
    return "".join(reversed(parts))


class Restorer:
    """Restores the disguised words of a text."""

    def __init__(self, model: CharModel):
        self.model, self.cache = model, {}

    def word(self, token: str) -> str:
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[token] = decode(token, self.model)
        return got

    def token(self, token: str) -> set[str]:
        """The words of one lower-cased token."""
        if token.isalpha():
            found = {token}
        elif (core := token.lstrip(BEFORE).rstrip(BEHIND)).isalpha():
            found = {core}
        else:
            found = set(WORD.findall(token))
            for m in SPACED.finditer(token):
                found.add(self.word(m[0].replace(m["s"], "")))
            for part in set(MIXED.findall(token)):
                bare = TAIL.sub("", part)
                if not bare.isalpha() and len(bare) > 2:
                    found.add(self.word(bare))
        found |= {self.word(w) for w in found if REPEAT.search(w)}
        found.discard("")
        return found

    def apart(self, tokens: list[str]) -> set[str]:
        """The words that lower-cased tokens of one letter each spell; marks may stand before the first and behind the last."""
        if SINGLES not in bytes(map((1).__eq__, map(len, tokens))):
            return set()
        single = [i for i, t in enumerate(tokens) if len(t) == 1]
        if len(single) < APART - 2:
            return set()
        found = set()
        for _, run in groupby(enumerate(single), lambda x: x[1] - x[0]):
            run = [i for _, i in run]
            if len(run) < APART - 2:
                continue
            symbols = [tokens[i] for i in run]
            if run[0] and len(t := tokens[run[0] - 1].lstrip(BEFORE)) == 1:
                symbols.insert(0, t)
            if run[-1] + 1 < len(tokens) and len(t := tokens[run[-1] + 1].rstrip(BEHIND)) == 1:
                symbols.append(t)
            for spelled, part in groupby(symbols, lambda c: c.isalpha() or c in LEET):
                word = "".join(part)
                if spelled and len(word) >= APART:
                    found.add(self.word(word))
        found.discard("")
        return found

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text, lower case."""
        tokens = (text or "").lower().split()
        return self.apart(tokens).union(*map(self.token, set(tokens)))


def features(word: str) -> list[str]:
    """The whole word and its beginnings."""
    return [word + "$", *(word[:n] for n in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1))]


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """(token, n): the lower-cased tokens of all rows; tasks count before the shuffle."""
    schema = arrow_schema("token string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for b in batches:
            for t in b.column(0):
                count.update((t.as_py() or "").lower().split())
                if len(count) > HELD:
                    yield batch(list(count.items()), schema)
                    count.clear()
        yield batch(list(count.items()), schema)

    rows = docs.select(F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def trigram_cells(tokens: DataFrame) -> DataFrame:
    """(kind, cell, n): counts of trigrams (3), their first two letters (2) and last letter (1) within the words of (token, n)."""
    schema = arrow_schema("kind int, cell int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter()

        def out():
            cells = Counter()
            for t, n in sums.items():
                cells[3, cell(t)] += n
                cells[2, cell(t[:2])] += n
                cells[1, cell(t[2])] += n
            sums.clear()
            rows = [(k, c, n) for (k, c), n in cells.items()]
            for at in range(0, len(rows), 1 << 16):
                yield batch(rows[at : at + (1 << 16)], schema)

        for b in batches:
            for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in [token] if token.isalpha() else WORD.findall(token):
                    w = EDGE * 2 + w + EDGE
                    for i in range(len(w) - 2):
                        sums[w[i : i + 3]] += n
                if len(sums) > HELD:
                    yield from out()
        yield from out()

    return tokens.mapInArrow(run, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, text: str = "text") -> CharModel:
    """The trigram model of all rows of docs.  At most 3 * CELLS counts reach the driver, as Arrow arrays, whatever the corpus."""
    tokens = stored(token_counts(docs, text), "tokens")
    got = trigram_cells(tokens).toArrow()
    discard(tokens)
    return CharModel.of_cells(*(got.column(c).to_numpy() for c in ("kind", "cell", "n")))


@dataclass
class ToxicityModel:
    """The character model, the weights of features, and the logistic model on the strongest evidence."""

    chars: CharModel
    weights: dict[str, float]
    coefficients: np.ndarray
    _said: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def _says(self, token: str) -> tuple[str, ...]:
        """The words of a token that have a weight; a token of letters with marks around it is one word, not to be restored."""
        core = token if token.isalpha() else token.lstrip(BEFORE).rstrip(BEHIND)
        if core.isalpha() and not REPEAT.search(core):
            return (core,) if self._weigh(core) > 0 else ()
        return tuple(w for w in self.chars.restorer.token(token) if self._weigh(w) > 0)

    def score(self, text: str | None) -> float:
        if not hasattr(self, "_weigh"):  # kept as long as the worker has the model
            self._weigh = weigher(self.weights)
        tokens = (text or "").lower().split()
        different, said = set(tokens), self._said
        if len(said) + len(different) > CACHE:
            said.clear()
        for t in different.difference(said):
            said[t] = self._says(t)
        found = self.chars.restorer.apart(tokens).union(chain.from_iterable(set(map(said.__getitem__, different))))
        x = evidence(found, self._weigh, len(different)) @ self.coefficients
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, x)))))


def starts(names: Iterable[str]) -> set[str]:
    """The first letters of features; a word that begins otherwise has none of them."""
    return {f.removesuffix("$")[:SHORTEST_STEM] for f in names}


def weigher(weights: dict[str, float]) -> Callable[[str], float]:
    """The largest weight among a word's features; 0 if it has none."""
    begun, get = starts(weights), weights.get

    def weigh(word: str) -> float:
        if word[:SHORTEST_STEM] not in begun:
            return 0.0
        most = get(word + "$", 0.0)
        for n in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1):
            if (x := get(word[:n], 0.0)) > most:
                most = x
        return most

    return weigh


def evidence(found: set[str], weigh: Callable[[str], float], n: int) -> np.ndarray:
    """A constant, the three largest weights among the words, and the log of the number of distinct tokens."""
    top = sorted((x for x in map(weigh, found) if x > 0), reverse=True)[:3]
    return np.array([1.0, *top, *[0.0] * (3 - len(top)), math.log1p(n)])


def feature_weights(words: DataFrame, sizes: dict[int, tuple[int, int]]) -> pa.Table:
    """(f, w, w0, …): log odds of features in toxic rows, less CAUTION standard errors; w0 is of the rows not in fold 0, and so on.

    words has (fold, y, words); sizes has a fold's rows and toxic rows.  Counts are of words in rows.  Only features
    with LEAST_ROWS toxic ones and a positive weight come: their number is bounded by the labelled sample.
    """
    each = words.select("fold", "y", F.explode("words").alias("word")).groupBy("word", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    stems = [F.when(F.char_length("word") >= k, F.substring("word", 1, k)) for k in range(SHORTEST_STEM, LONGEST_STEM + 1)]
    each = each.select("fold", "n", "toxic", F.explode(F.filter(F.array(F.concat("word", F.lit("$")), *stems), lambda x: x.isNotNull())).alias("f"))
    own = lambda c, k: F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0))
    sums = each.groupBy("f").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), *[own(c, k).alias(f"{c}{k}") for c in ("n", "toxic") for k in range(FOLDS)])

    def weight(k: int | None) -> tuple:
        rows, toxic = (sum(x[i] for j, x in sizes.items() if j != k) for i in range(2))
        a = F.col("toxic") - (0 if k is None else F.col(f"toxic{k}"))
        b = F.col("n") - (0 if k is None else F.col(f"n{k}")) - a
        w = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (rows - toxic + 1)) - CAUTION * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        return F.when((a >= LEAST_ROWS) & (w > 0), w).otherwise(0.0)

    names = {"w": None} | {f"w{k}": k for k in range(FOLDS)}
    out = sums.where(F.col("toxic") >= LEAST_ROWS).select("f", *[weight(k).alias(name) for name, k in names.items()])
    return out.where(F.greatest(*names) > 0).toArrow()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the constant is not penalised."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, chars: CharModel, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELLED) -> ToxicityModel:
    """The classifier of restored texts, fitted on at most ``most`` labelled rows (id, 0/1 label; others are left out).

    The sample is of the smallest hashes of ids, ties by id; of labels that repeat an id the larger counts.  It bounds
    what is broadcast and what reaches the driver: its rows, and the features that say something.  Weights are
    cross-fitted: the logistic model sees evidence from weights that the row had no part in.
    """
    good = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(id).agg(F.max(label).cast("int").alias("y"))
    sample = good.orderBy(F.xxhash64(id), id).limit(most).withColumn("fold", F.pmod(F.xxhash64(F.lit(7), id), F.lit(FOLDS)).cast("int"))
    rows = docs.select(id, F.col(text).cast("string").alias("text")).join(F.broadcast(stored(sample, "labels").withColumnRenamed(id, "_id")), F.col(id) == F.col("_id"))
    shared = docs.sparkSession.sparkContext.broadcast(chars)
    told = lambda t: {"n": len(set((t or "").lower().split())), "words": sorted(shared.value.restorer.words(t))}
    words = replaced(rows.select("fold", "y", "text"), "text", "told", "struct<n: int, words: array<string>>", told)
    words = stored(words.select("fold", "y", "told.n", "told.words"), "labelled")
    sizes = {r["fold"]: (r["n"], r["y"]) for r in words.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    if not sum(y for _, y in sizes.values()):
        return ToxicityModel(chars, {}, np.array([-4.0, 0, 0, 0, 0]))
    table = feature_weights(words, sizes)
    names = table.column("f").to_pylist()
    positive = lambda column: {f: w for f, w in zip(names, table.column(column).to_pylist(), strict=True) if w > 0}
    crossed = docs.sparkSession.sparkContext.broadcast(table)
    points = arrow_schema("y int, c double, a double, b double, d double, n double")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(crossed.value.column("f").to_pylist())}
        begun = starts(place)
        weights = [crossed.value.column(f"w{k}").to_pylist() for k in range(FOLDS)]
        weigh = [lambda word, w=w: max((w[place[f]] for f in features(word) if f in place), default=0.0) for w in weights]
        for b in batches:
            rows = [(y, *evidence({w for w in found if w[:SHORTEST_STEM] in begun}, weigh[fold], n).tolist()) for fold, y, n, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
            yield batch(rows, points)

    got = words.mapInArrow(rate, "y int, c double, a double, b double, d double, n double").toArrow()
    got = np.stack([got.column(c).to_numpy().astype(float) for c in got.column_names], axis=1)
    discard(words)
    return ToxicityModel(chars, positive("w"), logistic(got[:, 1:], got[:, 0]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", threshold: float = 0.7) -> DataFrame:
    """Replaces ``text`` by the score (0 to 1) and adds predicted (1 if the score reaches the threshold).

    Null and empty texts have the score that no evidence gives.  Equal texts have equal scores, rows that repeat
    stay, words and texts may have any length.  Columns named ``score`` and "predicted" are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = replaced(docs.drop("predicted"), text, score, "double", lambda t: shared.value.score(t))
    return out.withColumn("predicted", (F.col(score) >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels of rows with crc32 of the id mod 3 = 1 are not learned from.

    Null, empty, repeated and long texts are scored as score_toxicity() says; without a toxic label all scores are low.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~in_fold("doc_id", 3, 1))
    model = fit(docs, labels, char_model(docs))
    return score_toxicity(docs.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "text"), model)
