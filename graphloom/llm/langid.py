"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  A word's likelihood is the sum
over all ways to cut it into pieces (the forward algorithm), a text's the product over its words.  The
probabilities are learned by expectation maximisation (forward-backward) on the counts of all distinct words
of the learning rows, which Spark gathers from the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrowio import HELD, arrow_schema, batch, in_fold, replaced_batches
from graphloom.llm.shared import discard, stored

VOCABULARY = "piece_bpe_32k.model"
#: A run of letters and other signs that count as numbers, such as fractions; str.isalpha() tells letters alone.
LETTERS = re.compile(r"[^\W\d_]+")
#: Words of more letters are summed over one by one, with carried and scaled sums, others many at once.
LONG = 32
#: Probability of a letter that no piece covers, and what is added to each expected count.
UNKNOWN, ADDED = 1e-7, 0.05
ROUNDS = 2
#: Words whose likelihoods a worker keeps, words looked up at a time, and words summed over at a time.
CACHE, PIECE, TOGETHER = 500_000, 1 << 16, 4096


def vocabulary(name: str = VOCABULARY) -> list[str]:
    """The pieces of a public sentencepiece vocabulary that can occur in lower-cased words, "▁" marking a word's start."""
    import public_tokenizers
    import sentencepiece

    path = name if "/" in name else public_tokenizers.path(name)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if (q := p.removeprefix("▁")) and LETTERS.fullmatch(q) and q == q.lower()})


def words(text: str | None) -> list[str]:
    """The lower-cased runs of letters (Unicode category L) of a text."""
    found = LETTERS.findall((text or "").lower())
    if not "".join(found).isalpha():
        found = ["".join(part) for w in found for letter, part in groupby(w, str.isalpha) if letter]
    return found


class Pieces:
    """Where pieces occur in words, and sums over all segmentations: of many words at once, or of a word of any length."""

    #: Factor of the rolling hash (odd, 64 bits), and bits of the table that hashes are looked up in.
    FACTOR, BITS = 0x9E3779B97F4A7C15, 18

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        hashes = {}
        for p, i in self.number.items():
            h = 0
            for c in p:
                h = (h * self.FACTOR + ord(c) + 1) & (2**64 - 1)
            hashes[h * self.FACTOR & (2**64 - 1)] = i  # so that the first bits of short pieces differ
        if len(hashes) < len(pieces):
            raise ValueError("two pieces have one hash")
        # sorted hashes, and where each beginning of BITS bits starts among them
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.piece = np.array([hashes[h] for h in sorted(hashes)], np.int64)
        self.start = np.searchsorted(self.hashes, np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS))
        self.depth = int(np.diff(self.start, append=len(self.hashes)).max(initial=0))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The pieces of hashes, -1 where there is none."""
        h, out = h * np.uint64(self.FACTOR), np.full(len(h), -1)
        at = self.start[(h >> np.uint64(64 - self.BITS)).astype(np.int64)]
        for k in range(self.depth):
            place = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[place] == h
            out[hit] = self.piece[place[hit]]
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, from, to, piece) of all pieces in "▁" + word, in order of their ends and words, and the words' lengths.

        A letter that no one-letter piece covers is the piece ``unknown``, and so is the mark, so that a word's
        start may also be cut as its inside is.  Substrings are found by a rolling hash of 64 bits.
        """
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1
        code = np.frombuffer("▁".join(["", *words]).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(words)), n)
        place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        rest = n[word] - place  # letters from a place to the word's end
        h, at, parts = np.zeros(len(code), np.uint64), np.arange(len(code)), []
        for size in range(1, self.longest + 1):
            keep = rest[at] >= size
            at = at[keep]
            if not len(at):
                break
            h = h[keep] * np.uint64(self.FACTOR) + code[at + size - 1]
            k = self._find(h)
            if size == 1:
                k[k < 0] = self.unknown
            some = k >= 0
            parts.append((word[at[some]], place[at[some]], place[at[some]] + size, k[some]))
        x, i, j, k = (np.concatenate([p[c] for p in parts]) for c in range(4)) if parts else (np.zeros(0, np.int64),) * 4
        order = np.argsort(j * len(words) + x, kind="stable")
        return x[order], i[order], j[order], k[order], n

    def long(self, word: str, p: np.ndarray, counted: float | None = None) -> tuple[np.ndarray, tuple | None]:
        """The log of the summed probabilities of a word of any length, by language; with ``counted`` also (piece, expected count) of its edges.

        Sums are carried from letter to letter and scaled, so that none under- or overflows; only as many as the longest
        piece has letters are at hand, unless expected counts ask for all.  p has a row for each piece and unknown letters.
        """
        w = "▁" + word
        n, get = len(w), self.number.get
        into = [[(i, k) for i in range(max(0, j - self.longest), j) if (k := get(w[i:j], self.unknown if j - i == 1 else None)) is not None] for j in range(1, n + 1)]

        def sums(edges: Iterable[list[tuple[int, int]]], near: int) -> tuple[list, np.ndarray]:
            """Scaled sums at each place and the log of the scale there."""
            now, scale, out = [np.ones(p.shape[1])], np.zeros(p.shape[1]), []
            for at, own in enumerate(edges, 1):
                got = sum(now[i - at + len(now)] * p[k] for i, k in own)
                top = np.where(got > 0, got, 1.0)
                now = [x / top for x in now[-near:]] + [np.where(got > 0, 1.0, 0.0)]
                scale = scale + np.log(top)
                out.append(scale)
            return out, scale

        logs, total = sums(into, self.longest)
        if counted is None:
            return total, None
        out = [[] for _ in range(n)]
        for j, own in enumerate(into, 1):
            for i, k in own:
                out[i].append((j, k))
        back, _ = sums(([(n - j, k) for j, k in out[n - at]] for at in range(1, n + 1)), self.longest)
        forward, backward = [np.zeros(p.shape[1]), *logs], [np.zeros(p.shape[1]), *back]
        pieces, shares = [], []
        for j, own in enumerate(into, 1):
            for i, k in own:
                pieces.append(k)
                shares.append(counted * np.exp(forward[i] + np.log(p[k]) + backward[n - j] - total))
        return total, (np.array(pieces), np.array(shares))

    def forward(self, edges: tuple, p: np.ndarray) -> np.ndarray:
        """[word, place, …]: the summed probabilities of all segmentations up to each place; p has a row for each edge."""
        x, i, j, _, n = edges
        out = np.zeros((len(n), n.max() + 1, *p.shape[1:]))
        out[:, 0] = 1
        ends = np.searchsorted(j, np.arange(1, n.max() + 2))
        for at in range(n.max()):
            own = slice(ends[at], ends[at + 1])
            first = np.flatnonzero(np.diff(x[own], prepend=-1))
            if len(first):
                out[x[own][first], at + 1] = np.add.reduceat(out[x[own], i[own]] * p[own], first)
        return out

    def likelihoods(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language]: log of the summed probabilities; p has a row for each piece, the last for unknown letters."""
        out, short = np.zeros((len(words), p.shape[1])), [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            edges = self.edges([words[i] for i in short])
            out[short] = np.log(self.forward(edges, p[edges[3]])[np.arange(len(short)), edges[4]])
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.long(w, p)[0]
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: Callable) -> tuple[np.ndarray, ...]:
        """(word, piece, expected count) of every edge for words that occur ``counts`` times; ``p`` gives the edges' probabilities."""
        x, i, j, k, n = edges = self.edges(words)
        q = p(x, k)
        forward = self.forward(edges, q)
        # backward sums are forward sums of the mirrored edges
        order = np.lexsort((x, n[x] - i))
        mirrored = (x[order], (n[x] - j)[order], (n[x] - i)[order], k[order], n)
        backward = self.forward(mirrored, q[order])
        share = forward[x, i] * q * backward[x, n[x] - j] * (counts / forward[np.arange(len(n)), n])[x]
        return x, k, share


@dataclass
class LanguageModel:
    """languages in order, their log priors, the pieces, and a row of probabilities for each piece and one for unknown letters."""

    languages: list[str]
    prior: np.ndarray
    pieces: list[str]
    p: np.ndarray

    def _learn(self, found: list[str]) -> None:
        """Makes sure that all these words' likelihoods are at hand; forgets the others if there is no room."""
        row = self._row
        fresh = list({w for w in found if w not in row})
        if len(row) + len(fresh) > CACHE:
            row.clear()
            fresh = list(set(found))
        for at in range(0, len(fresh), TOGETHER):
            part, n = fresh[at : at + TOGETHER], len(row)
            self._known[n : n + len(part)] = self._index.likelihoods(part, self.p)
            row.update(zip(part, range(n, n + len(part)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text (ties: the first) and its posterior; ("und", 0) without a letter."""
        if not hasattr(self, "_index"):  # kept as long as the worker has the model
            self._index, self._row, self._known = Pieces(self.pieces), {}, np.zeros((CACHE, len(self.languages)))
        out, row = [], self._row
        split = list(map(words, texts))
        new: set[str] = set()
        for found in split:
            new.update(w for w in found if w not in row)
        if len(new) <= CACHE // 4:  # many words at once are cheaper
            self._learn(list(new))
        for found in split:
            if not found or not self.languages:
                out.append(("und", 0.0))
                continue
            total = self.prior.copy()
            for at in range(0, len(found), PIECE):
                part = found[at : at + PIECE]
                try:
                    known = list(map(row.__getitem__, part))
                except KeyError:
                    self._learn(part)
                    known = list(map(row.__getitem__, part))
                total += self._known[known].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(np.argmax(odds))
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows; tasks count before the shuffle."""
    schema = arrow_schema("lang string, word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out():
            rows = [(k, w, n) for k, c in held.items() for w, n in c.items()]
            held.clear()
            for at in range(0, len(rows), 1 << 16):
                yield batch(rows[at : at + (1 << 16)], schema)

        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                held.setdefault(k.as_py(), Counter()).update(words(t.as_py()))
                if sum(map(len, held.values())) > HELD:
                    yield from out()
        yield from out()

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(run, "lang string, word string, n long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", name: str = VOCABULARY, rounds: int = ROUNDS) -> LanguageModel:
    """The model of all rows of docs whose ``lang`` is not null.

    What reaches the driver is a number for each language and piece of the vocabulary, whatever the corpus.
    Without such rows the model has no language and predicts "und".
    """
    pieces = vocabulary(name)
    counts = stored(word_counts(docs, text, lang), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    size = len(pieces)
    p = np.full((size + 1, len(languages)), 1 / max(1, size))
    p[size] = UNKNOWN
    sums_schema = arrow_schema("lang int, piece int, c double")
    place = {k: i for i, k in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        now = p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, sums = Pieces(pieces), np.zeros((len(languages), size + 1))
            for b in batches:
                for at in range(0, b.num_rows, TOGETHER):
                    k, w, n = (b.column(c).slice(at, TOGETHER).to_pylist() for c in range(3))
                    for lang, word, count in zip(k, w, n, strict=True):
                        if len(word) > LONG:
                            own = place[lang]
                            piece, share = index.long(word, now[:, own : own + 1], float(count))[1]
                            np.add.at(sums[own], piece, share[:, 0])
                    short = [i for i, word in enumerate(w) if len(word) <= LONG]
                    if not short:
                        continue
                    own = np.array([place[k[i]] for i in short])
                    x, piece, share = index.expected([w[i] for i in short], np.array([n[i] for i in short], float), lambda x, piece: now[piece, own[x]])  # noqa: B023
                    sums += np.bincount(own[x] * (size + 1) + piece, share, sums.size).reshape(sums.shape)
            lang, piece = np.nonzero(sums[:, :size])
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[lang, piece])], schema=sums_schema)

        got = counts.mapInArrow(run, "lang int, piece int, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).collect()
        p[:size] = ADDED
        for r in got:
            p[r["piece"], r["lang"]] += r["c"]
        p[:size] /= p[:size].sum(axis=0)
    discard(counts)
    n = np.array([totals[k] for k in languages], float)
    return LanguageModel(languages, np.log(n / n.sum()) if len(n) else n, pieces, p)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred and score; ``text`` stays, columns with these names are replaced, others stay.

    Null texts and texts without a letter (Unicode category L) are ("und", 0).  Ties go to the first language by name.
    Texts and words may have any length; rows that repeat stay and have equal results; no rows give none.
    """
    return _identified(docs.withColumn("_graphloom_text", F.col(text).cast("string")), model)


def _identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Replaces the column _graphloom_text by lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = replaced_batches(docs.drop("lang_pred", "score"), "_graphloom_text", "_graphloom_told", "struct<lang_pred: string, score: double>", lambda texts: [dict(zip(("lang_pred", "score"), x, strict=True)) for x in shared.value.predict(texts)])
    return out.select(*[c for c in out.columns if c != "_graphloom_told"], "_graphloom_told.lang_pred", "_graphloom_told.score")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; rows with crc32 of the id mod 4 = 2 are held out from learning.

    Rows with a null id are held in and not learned from; texts are told as identify() says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where(F.col("doc_id").isNotNull() & ~in_fold("doc_id", 4, 2))
    model = fit(learn)
    return _identified(docs.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), F.col("text").alias("_graphloom_text")), model)
