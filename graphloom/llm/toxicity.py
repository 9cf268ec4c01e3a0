"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, look-alike letters of other scripts and
digits that stand for letters, zero-width characters dropped, all else to single
spaces. Lexicon entries are whole words and word beginnings with a weight, their
log odds between toxic and other documents of the labelled sample. Phrases that
hold an entry but are met in harmless documents are exceptions: entries inside
them don't count. The sum of weights is normalised by the text's length, and a
logistic turns it into a score.
"""

from __future__ import annotations

import bisect
import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import labelled, logistic_fit, lone, materialize, remainder, ship, sigmoid, table, text_bytes

#: Letters of other scripts that look like Latin ones, and digits and signs written for letters.
LOOKALIKE = dict(zip("абвеіјкмнорстухѕԁցһαβεικνορτυχωϲ013457@$|", "abbeijkmhopctyxsdghabeiknoptuxwcoleastasl", strict=True)) | {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ß", "æ": "ae", "œ": "oe"}
DROPPED = "​‌‍⁠﻿­"
#: Stems taken as candidates: word beginnings of these lengths.
STEMS = range(4, 8)


class Folding(dict):
    """A translation table that works out a character when it is first met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if c in DROPPED:
            out = None
        else:
            base = unicodedata.normalize("NFKD", c).casefold()
            base = "".join(x for x in base if not unicodedata.combining(x))
            base = "".join(LOOKALIKE.get(x, x) for x in base)
            out = base if base and all(x.isalpha() for x in base) else (None if unicodedata.combining(c) else " ")
        self[code] = out
        return out


FOLD = Folding()
ASCII_FOLD = bytes(ord(FOLD[i]) for i in range(128)) + bytes(range(128, 256))


def fold(data: bytes) -> str:
    """The folded text: words of letters, a space before, between and after them; 1 and | are written l."""
    text = data.translate(ASCII_FOLD).decode() if data.isascii() else data.decode().translate(FOLD)
    return f" {' '.join(text.split())} "


def merged(folded: str) -> str:
    """The folded text with i and l as one letter, written l, as 1 and | are written for both."""
    return folded.replace("i", "l")


class Lexicon:
    """entries: (pattern, weight), patterns with a space before, and one after where a whole word is meant. exceptions: phrases with spaces around. Both are folded as texts are, sign by sign."""

    def __init__(self, entries: list[tuple[str, float]], exceptions: list[str] = (), calibration: tuple[float, ...] = (0.0, 1.0, 0.0)):
        self.entries, self.exceptions, self.calibration = entries, list(exceptions), calibration
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for pattern, weight in self.entries:
                v = merged(pattern.translate(FOLD))
                if a.get(v, (0, 0.0))[1] < weight:
                    a.add_word(v, (len(v), weight))
            for phrase in self.exceptions:
                v = merged(phrase.translate(FOLD))
                a.add_word(v, (len(v), 0.0))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """The heaviest entry at each place of the folded text, those inside exception phrases left out."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton.iter(merged(folded)):
            start = end - n + 1
            if weight == 0.0:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if spared and found:
            spared.sort()
            begins, ends = [a for a, _ in spared], list(itertools.accumulate((b for _, b in spared), max))
            for at in list(found):
                i = bisect.bisect_right(begins, at)
                if i and at < ends[i - 1]:
                    del found[at]
        return found

    def measures(self, data: bytes) -> tuple[float, float]:
        """The sum of weights by the square root of the words, and by the words."""
        if not self.entries or not data:
            return 0.0, 0.0
        folded = fold(data)
        total = sum(self.hits(folded).values())
        n = max(1, folded.count(" ") - 1)
        return total / np.sqrt(n), 10 * total / n

    def score(self, texts: list[bytes]) -> np.ndarray:
        c, *w = self.calibration
        m = np.array([self.measures(t) for t in texts]).reshape(len(texts), 2)
        return sigmoid(c + np.log1p(m) @ np.array(w))


def _terms(words: set[str]) -> set[str]:
    return {f" {w} " for w in words if len(w) > 1} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}


def _counted(rows: DataFrame, terms_of) -> DataFrame:
    """term, n0, n1: the documents of either label that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone("toxicity")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = [Counter(), Counter()]
                for data, label in zip(text_bytes(part.column("text")), part.column("label").to_pylist(), strict=True):
                    counts[label].update(terms_of(merged(fold(data))))
                keys = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())], names=["term", "n0", "n1"])

    return rows.mapInArrow(run, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def learn_lexicon(rows: DataFrame, size: int = 4000, exception_size: int = 1000) -> Lexicon:
    """A lexicon of at most size entries and exception_size exceptions from (text, label) rows, themselves bounded.

    An entry must be met in toxic documents more than chance among all candidates
    explains (a likelihood ratio over 2 ln(candidates) + 8)."""
    ship(rows.sparkSession)
    rows = materialize(rows, "toxictrain")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Lexicon([])
    counts = materialize(_counted(rows, lambda folded: _terms(set(folded.split()))), "toxicterms")
    p1 = (F.col("n1") + 0.5) / (n1 + 1.0)
    p0 = (F.col("n0") + 0.5) / (n0 + 1.0)
    total, share = F.col("n0") + F.col("n1"), n1 / (n0 + n1)
    g = 2 * (F.col("n1") * F.log(F.col("n1") / (total * share)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (total * (1 - share)))).otherwise(0.0))
    likely = counts.filter((F.col("n1") > 1) & (F.col("n1") * n0 > 3 * F.col("n0") * n1)).withColumn("weight", F.log(p1 / p0)).withColumn("g", g)
    least = 2 * np.log(max(2, counts.filter("n0 + n1 > 1").count())) + 8
    top = likely.filter((F.col("g") > float(least)) & (F.col("weight") > 2.0)).orderBy(F.desc("g"), "term").limit(size).collect()
    entries = [(r["term"], float(r["weight"])) for r in top]
    lexicon = Lexicon(entries)
    if entries:
        shared = rows.sparkSession.sparkContext.broadcast(lexicon)

        def phrases(folded: str) -> set[str]:
            found = set()
            for at in shared.value.hits(folded):
                a, b = folded.rfind(" ", 0, at), folded.find(" ", at + 1)
                c = folded.find(" ", b + 1)
                found |= {folded[x:y + 1] for x, y in ((a, b), (at, c)) if x >= 0 and y > 0}
            return found

        spared = _counted(rows, phrases).filter((F.col("n0") >= 3) & (F.col("n0") * n1 > 3 * F.col("n1") * n0)).orderBy(F.desc("n0"), "term").limit(exception_size).collect()
        lexicon = Lexicon(entries, [r["term"] for r in spared])
    final = rows.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone("toxicity")
        for batch in batches:
            m = [final.value.measures(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in m], pa.float64()), pa.array([x for _, x in m], pa.float64()), batch.column("label")], names=["a", "b", "label"])

    got = rows.mapInArrow(measured, "a double, b double, label int").collect()
    x = np.array(sorted((1.0, np.log1p(r["a"]), np.log1p(r["b"]), r["label"]) for r in got))
    weight = logistic_fit(x[:, :3], x[:, 3], ridge=0.05)
    return Lexicon(entries, lexicon.exceptions, tuple(float(w) for w in weight))


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of docs, then score (0 to 1) and predicted (1 from 0.5 on).

    Null text counts as empty, which has no hits. Without a lexicon (no labelled
    rows of both kinds) scores are 0.5 less a bit, so nothing is toxic. Columns of
    docs named score or predicted are replaced. Repeated rows each give a row. No
    shuffle; a task holds one batch of texts."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon if lexicon.entries else Lexicon([], calibration=(-2.0, 0.0, 0.0)))
    docs = docs.select([c for c in docs.columns if c not in ("score", "predicted")])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone("toxicity")
        for batch in batches:
            s = shared.value.score(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from at most 8,000 labelled rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(labelled(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, 8000))
    return score_toxicity(docs, lexicon).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
