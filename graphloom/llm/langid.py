"""Language of code-switched text by a linear-chain conditional random field.

Each word of a text has a label. A word's scores are sums of learned weights of
its features: character n-grams, prefixes and suffixes, each hashed into a table,
and its entry in a lexicon of the sample's frequent words. Learned transitions
tie neighbours. Forward-backward gives each word's label probabilities; their
mean over the text decides, so a text that switches gets the language of most
of its words.
"""

from __future__ import annotations

import operator
import pickle
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import bounded_sample, discard, give_back, lone, materialize, remainder, ship, slices, table, text_bytes, tree_total

BITS = 15
NGRAMS, AFFIXES = (1, 2, 3, 4), (2, 3, 4)
UNKNOWN = "und"
#: Words of a text that are learned from together, and files whose numbers a worker keeps between steps.
PART, HELD = 256, 4
#: ASCII letters in lower case; all other ASCII bytes part words; bytes beyond ASCII are of words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words; [] for a text that has no letter, which is then undetermined."""
    if data.isascii():
        return data.translate(_LETTERS).split()
    text = data.decode("utf-8", "replace").lower()
    words = text.encode().translate(_LETTERS).split()
    return words if any(map(str.isalpha, text)) else []


class Features:
    """Indices of the features of words, in one table of rows: for n-grams and affixes by hash, then the lexicon; row 0 is for none."""

    def __init__(self, lexicon: list[bytes]):
        self.kinds = len(NGRAMS) + 2 * len(AFFIXES)
        self.lexicon = {w: 1 + (self.kinds << BITS) + i for i, w in enumerate(lexicon)}
        self.rows = 1 + (self.kinds << BITS) + len(lexicon)

    @staticmethod
    def _hash(code: np.ndarray, kind: int) -> np.ndarray:
        h = (code + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
        return (1 + (kind << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64)).astype(np.int32)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature rows by place (places x n-gram sizes), where each word's places begin, and by word (words x affixes and lexicon)."""
        data = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(size)
        begins = ends - size
        place = np.arange(len(data))
        rest = np.repeat(ends, size) - place
        code, grams = np.zeros(len(data), np.uint64), np.zeros((len(data), len(NGRAMS)), np.int32)
        for i, n in enumerate(NGRAMS):
            code = code << np.uint64(8) | np.append(data[n - 1 :], np.zeros(n - 1, np.uint64))
            grams[:, i] = np.where(rest >= n, self._hash(code, i), 0)
        whole = np.zeros((len(words), 2 * len(AFFIXES) + 1), np.int32)
        for i, n in enumerate(AFFIXES):
            for side in (0, 1):
                at = begins + 1 if side == 0 else ends - 1 - n
                fits = size - 2 >= n
                code = np.zeros(len(words), np.uint64)
                for k in range(n):
                    code = code << np.uint64(8) | data[np.where(fits, at + k, 0)]
                kind = len(NGRAMS) + 2 * i + side
                whole[:, 2 * i + side] = np.where(fits, self._hash(code, kind), 0)
        whole[:, -1] = [self.lexicon.get(w, 0) for w in words]
        return grams, begins, whole


class Chains:
    """Sequences packed by time: at each time the sequences that still run, longest first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sorted_ = lengths[self.order]
        longest = int(sorted_[0]) if len(sorted_) else 0
        self.alive = np.searchsorted(-sorted_, -np.arange(longest), side="left")
        self.start = np.concatenate([[0], np.cumsum(self.alive)])
        begins = (np.cumsum(lengths) - lengths)[self.order]
        self.lane = np.concatenate([np.arange(n) for n in self.alive]) if longest else np.zeros(0, np.int64)
        self.source = begins[self.lane] + np.repeat(np.arange(longest), self.alive)

    def posterior(self, e: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each place (packed order) and expected counts of transitions, from exp(scores) e, exp(transitions) and exp(first)."""
        alpha, scale, beta = np.empty_like(e), np.empty(len(e), e.dtype), np.empty_like(e)
        alive, start = self.alive, self.start
        a = None
        for t in range(len(alive)):
            n, s = alive[t], start[t]
            x = e[s : s + n] * (first if a is None else a[:n] @ step)
            z = x.sum(1)
            x /= z[:, None]
            alpha[s : s + n], scale[s : s + n], a = x, z, x
        pairs, back = np.zeros_like(step), step.T.copy()
        for t in range(len(alive) - 1, -1, -1):
            n, s = alive[t], start[t]
            b = np.ones((n, e.shape[1]), e.dtype)
            if t + 1 < len(alive) and alive[t + 1]:
                m, u = alive[t + 1], start[t + 1]
                ahead = e[u : u + m] * beta[u : u + m] / scale[u : u + m, None]
                b[:m] = ahead @ back
                pairs += alpha[s : s + m].T @ ahead
            beta[s : s + n] = b
        return alpha * beta, pairs * step


class Field:
    #: Places whose label probabilities, and words whose scores, are made together when learning.
    CHUNK, PIECE = 1 << 18, 1 << 14

    def __init__(self, labels: list[str], features: Features):
        self.labels, self.features = labels, features
        self.weights = np.zeros((features.rows, len(labels)), np.float32)
        self.steps = np.zeros((len(labels), len(labels)), np.float32)
        self.first = np.zeros(len(labels), np.float32)

    def scores(self, grams: np.ndarray, begins: np.ndarray, whole: np.ndarray) -> np.ndarray:
        by_place = self.weights[grams[:, 0]]
        for i in range(1, grams.shape[1]):
            by_place += self.weights[grams[:, i]]
        out = np.add.reduceat(by_place, begins)
        for i in range(whole.shape[1]):
            out += self.weights[whole[:, i]]
        return out

    def fit(self, texts: Iterable[list[bytes]], gold: list[int], rounds: int = 40, most: int = PART) -> None:
        """Learn from texts at hand; the label of a text is that of its words. Long texts are learned from in parts of at most `most` words."""
        share = Share(((t[a : a + most], y) for t, y in zip(texts, gold, strict=True) for a in range(0, len(t), most)), self.features, len(self.labels))
        self.learn(lambda: share.slopes(self), rounds)

    def learn(self, total: Callable[[], Slopes | None], rounds: int = 40, rate: float = 0.15, ridge: float = 1e-5) -> None:
        """Full-batch steps (Adam) on the labels' log likelihood. total gives the slopes of all parts at what is learned so far."""
        learned = [self.weights, self.steps, self.first]
        m, v = [np.zeros_like(p) for p in learned], [np.zeros_like(p) for p in learned]
        for r in range(1, rounds + 1):
            got = total()
            if got is None:
                return
            at = got.rows
            slopes = ((at, got.slope / got.words - ridge * self.weights[at]), (slice(None), got.pairs / got.words), (slice(None), got.first / got.parts))
            for i, (p, (where, g)) in enumerate(zip(learned, slopes, strict=True)):  # weights of features that are never met stay 0
                m[i][where] += 0.1 * (g - m[i][where])
                v[i][where] += 0.01 * (g * g - v[i][where])
                p[where] += (rate * (m[i][where] / (1 - 0.9**r)) / (np.sqrt(v[i][where] / (1 - 0.99**r)) + 1e-8)).astype(np.float32)


@dataclass
class Slopes:
    """Sums over parts of texts: the slope of the log likelihood by weights (of the feature rows that are met, ascending), transitions and first labels; words and parts."""

    rows: np.ndarray
    slope: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    words: int
    parts: int

    def __add__(self, other: Slopes) -> Slopes:
        rows = np.union1d(self.rows, other.rows)
        slope = np.zeros((len(rows), self.slope.shape[1]))
        for x in (self, other):
            slope[np.searchsorted(rows, x.rows)] += x.slope
        return Slopes(rows, slope, self.pairs + other.pairs, self.first + other.first, self.words + other.words, self.parts + other.parts)


class Share:
    """Some parts of texts, each a list of words and a label, held as numbers of words."""

    def __init__(self, texts: Iterable[tuple[list[bytes], int]], features: Features, k: int):
        index: dict[bytes, int] = {}
        parts = [(np.fromiter((index.setdefault(w, len(index)) for w in t), np.int32, len(t)), y) for t, y in texts if t]
        self.distinct, self.k = len(index), k
        distinct = list(index)
        del index
        parts.sort(key=lambda p: -len(p[0]))
        lengths, gold_of = np.array([len(p) for p, _ in parts], np.int64), np.array([y for _, y in parts], np.int64)
        self.chunks = []
        for a, b in slices(parts, lengths.tolist(), Field.CHUNK):
            chains = Chains(lengths[a:b])
            ids = np.concatenate([p for p, _ in parts[a:b]])[chains.source]
            self.chunks.append((chains, ids, np.repeat(gold_of[a:b].astype(np.int16), lengths[a:b])[chains.source], b - a))
            del chains.lane, chains.source
        del parts
        self.pieces = [features.of(distinct[a : a + Field.PIECE]) for a in range(0, len(distinct), Field.PIECE)]
        rows, self.met = [], []
        # the words of each feature that is met, kind by kind, as kinds share no feature and follow each other
        for kind in range(len(NGRAMS) + 2 * len(AFFIXES) + 1):
            by_place = kind < len(NGRAMS)
            feature = np.concatenate([grams[:, kind] if by_place else whole[:, kind - len(NGRAMS)] for grams, _, whole in self.pieces])
            word = np.arange(len(distinct), dtype=np.int32)
            if by_place:
                word = np.repeat(word, np.concatenate([np.diff(np.append(begins, len(grams))) for grams, begins, _ in self.pieces]))
            order = np.argsort(feature, kind="stable")
            feature, word = feature[order], word[order]
            skip = int(np.searchsorted(feature, 1))
            feature, word = feature[skip:], word[skip:]
            if len(feature):
                cuts = np.flatnonzero(np.append(True, np.diff(feature) > 0))
                rows.append(feature[cuts])
                self.met.append((word, cuts))
        self.rows = np.concatenate(rows)
        self.n_pairs = np.diag(np.bincount(gold_of, lengths - 1, k))
        self.firsts = np.bincount(gold_of, minlength=k)
        self.words, self.parts = int(lengths.sum()), len(lengths)

    def slopes(self, field: Field) -> Slopes:
        k = self.k
        held = np.eye(k, dtype=np.float32)
        known = np.concatenate([field.scores(*p) for p in self.pieces])
        known = np.exp(known - known.max(1, keepdims=True))
        step, first = np.exp(field.steps), np.exp(field.first)
        lack, pairs, began = np.zeros((k, self.distinct)), np.zeros((k, k)), np.zeros(k)
        for chains, ids, labels, n in self.chunks:
            got, more = chains.posterior(known[ids], step, first)
            pairs += more
            began += got[:n].sum(0)
            np.subtract(held[labels], got, out=got)
            for j in range(k):
                lack[j] += np.bincount(ids, got[:, j], self.distinct)
        slope = np.empty((len(self.rows), k), np.float32)
        for j in range(k):
            slope[:, j] = np.concatenate([np.add.reduceat(lack[j][word], cuts) for word, cuts in self.met])
        return Slopes(self.rows, slope, self.n_pairs - pairs, self.firsts - began, self.words, self.parts)


class Labeller:
    """Labels text after text in a worker, remembering words' scores; lets all go when they are too many."""

    def __init__(self, field: Field, most_words: int = 300_000):
        self.field, self.most = field, most_words
        self.index: dict[bytes, int] = {}
        self.known = np.zeros((0, len(field.labels)), np.float32)
        self.step, self.start = np.exp(field.steps), np.exp(field.first)

    def label(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not lengths.any() or not self.field.labels:
            return out, score
        if len(self.index) > self.most:
            self.index, self.known = {}, self.known[:0]
        new = list(set().union(*words) - self.index.keys())
        if new:
            for i, w in enumerate(new, len(self.index)):
                self.index[w] = i
            s = self.field.scores(*self.field.features.of(new))
            self.known = np.concatenate([self.known, np.exp(s - s.max(1, keepdims=True))])
        flat = [w for t in words for w in t]
        chains = Chains(lengths)
        ids = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))[chains.source]
        got, _ = chains.posterior(self.known[ids], self.step, self.start)
        lane = chains.lane
        mean = np.stack([np.bincount(lane, got[:, j], len(texts)) for j in range(got.shape[1])], 1)
        for at, row in zip(chains.order.tolist(), mean, strict=True):
            if lengths[at]:
                best = int(row.argmax())
                out[at], score[at] = self.field.labels[best], min(1.0, row[best] / lengths[at])
        return out, score


def text_parts(docs: DataFrame, each: int = PART) -> DataFrame:
    """lang, words: texts of docs (lang, text) in parts of at most `each` words, which spaces part; none for a text without a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text")), strict=True):
                words = words_of(text)
                if words:
                    parts = [b" ".join(words[a : a + each]) for a in range(0, len(words), each)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(parts, pa.binary())], names=["lang", "words"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, words binary")


def learn_field(docs: DataFrame, bound: int = 2000, modulus: int = 4, held_out: int = 2, lexicon_size: int = 4000, part_bytes: int = 1 << 21) -> Field:
    """A field from at most bound documents with a lang, those held out by crc32(doc_id) left out.

    Their texts, however long, are written in parts of PART words, about part_bytes to
    a file. Each step adds up the slopes of the files in tasks, which keep what they
    made of a file for the next step; the driver holds the weights alone. Of rows
    with one doc_id that of the least hash counts. Null texts, and those without a
    letter, teach nothing; without any other there are no labels. With one language
    every text with a letter has it."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    sample = bounded_sample(known.select("doc_id").dropDuplicates(), bound, "doc_id")
    one = known.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("r"))
    one = materialize(one.select("r.lang", "r.text"), "langsample")
    size = one.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = materialize(text_parts(one).repartition(max(2, -(-size // part_bytes))), "langparts")
    labels = [r["lang"] for r in parts.select("lang").distinct().orderBy("lang").collect()]
    field = Field(labels, Features(_frequent(one, lexicon_size)))
    discard(one)
    if labels:
        field.learn(_slopes_of(parts, field))
    discard(parts)
    give_back()
    return field


def _frequent(docs: DataFrame, size: int) -> list[bytes]:
    """The words of the most texts, of three at least, ties in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(sorted(set(words_of(text))), pa.binary())], names=["word"])

    counts = docs.select("text").mapInArrow(run, "word binary").groupBy("word").agg(F.count("*").alias("n")).filter("n > 2")
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def _slopes_of(parts: DataFrame, field: Field) -> Callable[[], Slopes | None]:
    spark = parts.sparkSession
    features, labels, key = spark.sparkContext.broadcast(field.features), field.labels, uuid.uuid4().int

    def total() -> Slopes | None:
        now = spark.sparkContext.broadcast((field.weights, field.steps, field.first))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for batch in batches for r in zip(batch.column("words").to_pylist(), batch.column("lang").to_pylist(), strict=True)]
            if not rows:
                return
            shares, mark = lone(key, dict), (len(rows), zlib.crc32(b"\n".join(w for w, _ in rows)))
            if mark not in shares:
                if len(shares) >= HELD:
                    shares.clear()
                shares[mark] = Share(((w.split(b" "), labels.index(lang)) for w, lang in rows), features.value, len(labels))
            at = Field.__new__(Field)
            at.weights, at.steps, at.first = now.value
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(shares[mark].slopes(at))], pa.binary())], names=["i", "got"])

        out = tree_total(parts.mapInArrow(run, "i long, got binary"), operator.add)
        now.unpersist()
        return out

    return total


def identify(docs: DataFrame, field: Field, chunk_bytes: int = 1 << 21) -> DataFrame:
    """All columns of docs, then lang_pred and lang_score (mean probability of that label over the words).

    'und' with score 0 for a null text, a text without a letter, and all texts if
    nothing could be learned. Ties go to the label first in order. Columns of
    docs named lang_pred or lang_score are replaced. Repeated rows each give a
    row. No shuffle; a task holds the words of chunk_bytes of text, or of one text."""
    ship(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(field), uuid.uuid4().int
    docs = docs.select([c for c in docs.columns if c not in ("lang_pred", "lang_score")])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = lone(key, lambda: Labeller(shared.value))
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in slices(texts, [len(t) for t in texts], chunk_bytes):
                names, score = labeller.label(texts[a:b])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), learn_field(docs))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op10_langid": op10_langid}
SQL: dict[str, str] = {}
