"""Lexical retrieval packing of documents into token windows.

Documents are tokenised once and dealt by content into shards of bounded size: a weighted MinHash of a document's
terms orders the corpus, and shards are ranges of that order, so that documents that share terms meet whatever the
number of shards.  Each shard has a BM25 inverted index, with document frequencies and the mean
length of the whole corpus; a seed document's unused neighbours fill its window in order of their scores, and the one
that does not fit is cut and seeds the next window.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrowio import arrow_schema, batch
from graphloom.llm.shared import stored

TOKENIZER = "word_bpe_49k.json"
WINDOW, END = 2048, 1
#: Tokens of a shard, about; a task holds one shard.
SHARD_TOKENS = 2_000_000
#: Terms that more than one in DENSE of a shard's documents have are kept as rows of a matrix.
DENSE = 8
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Words whose ids a worker keeps, about.
CACHE = 1_200_000
#: ASCII signs that end words; behind a letter they are tokens of their own.
SIGNS = ".,;:!?|*%$#&)\""

#: Words whose letters normalisation leaves alone but for case (the dotted capital I would become two characters).
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: A line each: a word of LATIN and the signs behind it, or any other word.
WORD = re.compile(f"(?m)^(?:({LATIN.pattern})([{re.escape(SIGNS)}]*)|(.*))$")
#: Words that are looked up, and characters of the documents that are encoded, at a time.
WORDS, CHARACTERS = 1 << 16, 1 << 20
#: Stands for a word's end where words of letters are encoded.
WORD_END = b"\n"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


@lru_cache(4)
def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from lower-case words of LATIN to their ids, by merging bytes as the tokenizer's file says.

    The merges' order ranks the joined bytes.  A word's last byte is joined with its end mark before all else.  Words
    are encoded as one text and told apart by the ids that end a word.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end, byte = model["end_of_word_suffix"], _bytes_of_letters()
    raw = lambda token: bytes(byte[c] for c in token.removesuffix(end)) + WORD_END * token.endswith(end)
    singles = [bytes([b]) for b in range(256)]
    order = [*singles, *(b + WORD_END for b in singles), *(raw(a) + raw(b) for a, b in model["merges"])]
    ranks = {}
    for token in order:
        ranks.setdefault(token, len(ranks))
    number = {raw(token): i for token, i in model["vocab"].items()}
    ids = np.array([number.get(token, 0) for token in ranks], "<u4")
    ends = np.array([token.endswith(WORD_END) for token in ranks])
    core = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})

    def encode(words: list[str]) -> list[bytes]:
        if not words:
            return []
        found = core.encode_to_numpy("\n".join(words) + "\n", disallowed_special=())
        last, data = (4 * np.flatnonzero(ends[found]) + 4).tolist(), ids[found].tobytes()
        return [data[i:j] for i, j in zip([0, *last], last, strict=False)]

    return encode


@lru_cache(4)
def batch_encoder(name: str = TOKENIZER) -> Callable[[list[str | None]], list[bytes]]:
    """A function from texts to their ids (little-endian 32 bit) as the public tokenizer gives them.

    The tokenizer never joins across a blank or a line feed, so words are encoded once and kept as long as the
    worker lives.  A word of Latin letters is one pre-token, which merging its bytes encodes, whatever its case; the
    tokenizer itself encodes all others.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    path = name if "/" in name else public_tokenizers.path(name)
    tokenizer, of_letters = Tokenizer.from_file(path), word_encoder(path)
    cache: dict[str, bytes] = {"": b""}

    def plainly(words: set[str]) -> None:
        words = list(words.difference(cache))
        for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
            cache[w] = np.array(e.ids, "<u4").tobytes()

    def learn(words: list[str]) -> None:
        parts = WORD.findall("\n".join(words))
        low = "\n".join([letters for letters, _, _ in parts]).lower().split("\n")
        fresh = list(set(low).difference(cache))
        for at in range(0, len(fresh), 1 << 14):
            part = fresh[at : at + (1 << 14)]
            cache.update(zip(part, of_letters(part), strict=True))
        split = {}
        for w in {other for _, _, other in parts if other}:
            core = w.rstrip(SIGNS)
            if len(core) < len(w) and core and core[-1].lower()[-1].isalpha() and "<" not in w:
                split[w] = core, w[len(core) :]
        plainly({other for _, _, other in parts if other not in split}.union({signs for _, signs, _ in parts}, *split.values()))
        cache.update((w, cache[core] + cache[signs]) for w, (core, signs) in split.items())
        cache.update((w, cache[k] + cache[signs]) for w, k, (letters, signs, _) in zip(words, low, parts, strict=True) if letters)

    def known(lists: list[list[str]]) -> list[bytes]:
        missing = set().union(*lists).difference(cache)
        if len(cache) + len(missing) > CACHE:
            cache.clear()
            cache[""] = b""
            missing = set().union(*lists).difference(cache)
        if missing:
            learn(list(missing))
        return [b"".join(map(cache.__getitem__, words)) for words in lists]

    def encode(texts: list[str | None]) -> list[bytes]:
        lists = [(text or "").replace("\n", " ").split(" ") for text in texts]
        short = iter(known([words for words in lists if len(words) <= WORDS]))
        return [next(short) if len(words) <= WORDS else b"".join(known([words[at : at + WORDS]])[0] for at in range(0, len(words), WORDS)) for words in lists]

    return encode


def encoder(name: str = TOKENIZER) -> Callable[[str | None], bytes]:
    """batch_encoder() for one text at a time."""
    encode = batch_encoder(name)
    return lambda text: encode([text])[0]


class Order:
    """Places a document among others by the two terms of it that come first in a random order of all terms.

    Terms that the vocabulary learned late, which are rarer, come earlier in that order (weighted MinHash): of two
    documents that share most of their rare terms, the same terms come first.
    """

    def __init__(self):
        self.place = np.zeros(0)

    def __call__(self, ids: np.ndarray) -> int:
        most = int(ids.max())
        if most >= len(self.place):
            n = 2 * most + 2
            weight = (1 + np.log1p(np.arange(n) / 256)) ** 3
            self.place = np.log(np.random.default_rng(1).random(n)) / -weight
        own = self.place[ids]
        first = int(ids[own.argmin()])
        own[ids == first] = np.inf
        return first << 31 | int(ids[own.argmin()])


def tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", name: str = TOKENIZER, end: int = END) -> DataFrame:
    """(doc_id, near, ids): each document's ids with ``end`` behind them, and its place in Order; null texts are empty."""
    schema = arrow_schema("doc_id long, near long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, order, tail = batch_encoder(name), Order(), np.array([end], "<u4").tobytes()

        def encoded(docs: list, texts: list) -> pa.RecordBatch:
            ids = [x + tail for x in encode(texts)]
            return batch([(doc, order(np.frombuffer(x, "<u4")), x) for doc, x in zip(docs, ids, strict=True)], schema)

        for b in batches:
            docs, texts, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs.append(doc)
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held > CHARACTERS:
                    yield encoded(docs, texts)
                    docs, texts, held = [], [], 0
            yield encoded(docs, texts)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, near long, ids binary")


def term_documents(held: DataFrame) -> DataFrame:
    """(term, df) over all rows of (…, ids); a task sends each term once."""
    schema = arrow_schema("term long, df long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << 16, np.int64)
        last = np.zeros(len(count), np.int64)
        for b in batches:
            for x in b.column(0):
                ids = np.frombuffer(x.as_py(), "<u4")
                if len(ids) and ids.max() >= len(count):
                    count, last = (np.concatenate((v, np.zeros(int(ids.max()) + 1, np.int64))) for v in (count, last))
                # each term once: where it stands last
                place = np.arange(len(ids))
                last[ids] = place
                count[ids[last[ids] == place]] += 1
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], schema=schema)

    return held.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        length = np.array([len(d) for d in docs])
        key = np.repeat(np.arange(len(docs)) * len(idf), length) + np.concatenate(docs)
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tf = np.diff(first, append=len(key))
        doc, term = np.divmod(key[first], len(idf))
        self.terms = np.split(term, np.cumsum(np.bincount(doc, minlength=len(docs)))[:-1])
        norm = K1 * (1 - B + B * length / mean)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.count = len(docs)
        # a term that many documents have is a row of a matrix, the others have lists; the matrix has as many
        # rows as DENSE times a document's distinct terms at most
        df = np.bincount(term, minlength=1)
        often = np.flatnonzero(df * DENSE > len(docs))
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(docs)), np.float32)
        rare = self.row[term] < 0
        self.dense[self.row[term[~rare]], doc[~rare]] = weight[~rare]
        term, doc, weight = term[rare], doc[rare], weight[rare]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.end = np.cumsum(np.bincount(term, minlength=len(df)))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for the seed's distinct terms."""
        rows = self.row[self.terms[seed]]
        terms = self.terms[seed][rows < 0]
        first = np.where(terms, self.end[terms - 1], 0)
        n = self.end[terms] - first
        post = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        scores = np.bincount(self.doc[post], self.weight[post], self.count).astype(np.float32)
        # row by row, as the sums stay in the processor's cache
        for row in rows[rows >= 0].tolist():
            scores += self.dense[row]
        return scores


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; documents in order seed, their neighbours fill."""
    index = Index(docs, idf, mean)
    left = np.ones(len(docs), bool)
    sequence, used, seed, start, following = 0, 0, None, 0, 0
    while True:
        if seed is None:
            while following < len(docs) and not left[following]:
                following += 1
            if following == len(docs):
                return
            seed, start = following, 0
            left[seed] = False
        # the seed, over as many windows as it takes
        while start < len(docs[seed]):
            n = min(window - used, len(docs[seed]) - start)
            yield seed, start, n, sequence, used
            start, used = start + n, used + n
            if used == window:
                sequence, used = sequence + 1, 0
        now, seed = seed, None
        if not used:
            continue
        scores = np.where(left, index.scores(now), np.float32(-1))
        while used and left.any():
            best = int(np.argmax(scores))
            left[best], scores[best] = False, -1.0
            n = min(window - used, len(docs[best]))
            yield best, 0, n, sequence, used
            used += n
            if used == window:
                sequence, used = sequence + 1, 0
            if n < len(docs[best]):
                seed, start = best, n


def pack(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, name: str = TOKENIZER, end: int = END, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """PIECES: where each run of a document's ids lies in the packed sequences.

    Every id lies in one piece.  Sequences are full but for the last of each shard.  Null and empty texts are
    the end id alone; rows that repeat an id, or id and text, are packed each and split over shards where they are
    many; an empty table gives no pieces.  Ties among scores go to the document that is first by place in the order
    of contents, id (null first) and ids.  The driver gets a number for each term of the tokenizer's fixed vocabulary,
    and two totals.
    """
    held = stored(tokens(docs, id, text, name, end), "tokens")
    n, total = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)) / 4).first()
    counted = term_documents(held).collect() if n else []
    idf = np.zeros(max([0, *(r["term"] for r in counted)]) + 1)
    for r in counted:
        idf[r["term"]] = math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    mean, shards = (total / n if n else 1.0), max(1, math.ceil(total / shard_tokens))
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    schema = arrow_schema(f"{PIECES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        rows.sort(key=lambda r: (r[1], r[0] is not None, r[0] or 0, r[2]))
        parts = [np.frombuffer(r[2], "<u4") for r in rows]
        shard, pieces = TaskContext.get().partitionId() << 32, []
        for d, start, length, sequence, offset in pack_shard(parts, shared.value, mean, window) if rows else ():
            pieces.append((rows[d][0], start, length, rows[d][2][4 * start : 4 * (start + length)], len(parts[d]), shard | sequence, offset))
        yield batch(pieces, schema)

    # a row's number splits documents of one place; a shard is a partition, and a task holds it
    dealt = held.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, "near", "row")
    return dealt.select("doc_id", "near", "ids").mapInArrow(run, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens, with a checksum of each piece; edge cases as in pack()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
