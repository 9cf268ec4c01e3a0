"""Alignment of two tokenizers over the same bytes.

Both encodings of a text end tokens at byte offsets; the two ascending lists of
ends are merged. Where both end a token, a group ends; each end in the merged
list closes one stretch of bytes that lies in one token of either side, so the
distinct ends are the links, no pair twice. That is done text by text inside
mapInArrow, which also gives for each batch of texts (chunk) its distinct id
pairs and how many of its documents hold each.

Spark then counts documents by pair over all chunks, finds the highest count of
each id on either side, joins both back to the chunks' pairs and, by chunk, to
the documents. A pair stands in a chunk once, so no key of these joins is hot
however frequent its tokens are; what comes together is one chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import SPLIT, SPLIT_ASCII, byte_alphabet, default_path
from graphloom.llm.common import lone, materialize, ship, slices, table, text_bytes

_UNIT = re.compile(" +[^ ]*")
_SHIFT = np.int64(1) << np.int64(32)


class Words:
    """Remembers the packed ids of words, `most` at most; of too many, all are forgotten."""

    def __init__(self, most: int):
        self.most, self.packed = most, {}

    def made(self, words: list[str]) -> list[bytes | None]:
        raise NotImplementedError

    def learn(self, words: set[str]) -> None:
        new = list(words - self.packed.keys())
        if len(self.packed) + len(new) > self.most:
            self.packed, new = {}, list(words)
        self.packed.update(zip(new, self.made(new), strict=True))


class Bytes(Words):
    """Encodes with a byte-level file, word by word of its split pattern; special tokens' strings are plain text."""

    def __init__(self, spec: str, most: int):
        super().__init__(most)
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = Tokenizer.from_str(spec)
        self.model.encode_special_tokens = True
        alphabet = byte_alphabet()
        names = [self.model.id_to_token(i) for i in range(self.model.get_vocab_size())]
        self.bytes_of = [bytes(alphabet[c] for c in n) if set(n) <= alphabet.keys() else n.encode() for n in names]
        self.pattern, self.ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII)

    def split(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.pattern).findall(" " + text)

    def made(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch(words, add_special_tokens=False)]


class Pieces(Words):
    """Encodes with a sentencepiece model, unit by unit: spaces and what follows up to the next space.

    No piece of such a vocabulary reaches from another character into a space, so
    units don't meet; where one does, a text is one unit."""

    def __init__(self, model: bytes, most: int):
        super().__init__(most)
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        self.space = self.model.piece_to_id("▁")
        self.whole = any(re.search("[^▁]▁", n) for n in names)

    def split(self, text: str) -> list[str]:
        return [" " + text] if self.whole else _UNIT.findall(" " + text)

    def made(self, words: list[str]) -> list[bytes | None]:
        """None where the pieces' bytes aren't the unit's."""
        out = []
        for unit, ids in zip(words, self.model.encode([u[1:] for u in words], num_threads=1), strict=True):
            ids = ids or [self.space]
            out.append(array("I", ids).tobytes() if b"".join(map(self.bytes_of.__getitem__, ids)) == unit.encode() else None)
        return out


class Aligner:
    def __init__(self, spec: str, pieces: bytes, most_words: int):
        self.left, self.right = Bytes(spec, most_words), Pieces(pieces, most_words)
        self.sizes = [np.array([len(x) for x in side.bytes_of], np.int64) for side in (self.left, self.right)]
        self.said = [f"{i}{end}".encode() for side, last in zip(self.sizes, "|;", strict=True) for i in range(len(side)) for end in ("," + last)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of either side for each text; none where there is no text or its bytes don't come back."""
        out, split = [], []
        for side in (self.left, self.right):
            split.append([side.split(t) if t else [] for t in texts])
            side.learn(set().union(*split[-1]))
        for text, words, units in zip(texts, *split, strict=True):
            b = [*map(self.right.packed.__getitem__, units)]
            kept = None not in b and "▁" not in text
            a = map(self.left.packed.__getitem__, words) if kept else ()
            out.append(tuple(np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in (a, b if kept else ())))
        return out

    def align(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """For texts end to end: counts and digest of each, and each link's pair (left id * 2**32 + right id) and text."""
        a, b = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
        ends_a, ends_b = self.sizes[0][a].cumsum(), self.sizes[1][b].cumsum()
        merged = np.concatenate([ends_a, ends_b])
        merged.sort(kind="stable")  # of two ascending runs: a merge
        again = merged[1:] == merged[:-1]
        common = merged[1:][again]
        ends = merged[np.append(True, ~again)] if len(merged) else merged
        n_a, n_b = ([len(s[k]) for s in sides] for k in (0, 1))
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        text_of = np.repeat(np.arange(len(sides)), n_a)[at_a]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = (common[g] == e if len(common) else np.zeros(0, bool) for g, e in ((group_a, ends_a), (group_b, ends_b)))
        # left ids of a group, then its right ids, each with what follows it
        said = np.empty(len(a) + len(b), np.int64)
        said[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + last_a
        said[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.sizes[0]) + b) + last_b
        words, digests, begin = self.said, [], 0
        for x, y in zip(n_a, n_b, strict=True):
            digests.append(hashlib.sha256(b"".join(map(words.__getitem__, said[begin : begin + x + y].tolist()))[:-1]).hexdigest() if x else "")
            begin += x + y
        count = lambda of: np.bincount(of, minlength=len(sides)).tolist()
        groups = count(np.repeat(np.arange(len(sides)), n_a)[last_a])
        return {"n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": count(text_of), "groups_sha256": digests}, a[at_a] * _SHIFT + b[at_b], text_of


_LINKS = "chunk long, {id} {type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair_at array<int>, times array<int>, pairs array<struct<a:int,b:int,docs:int>>"


def link_tokens(docs: DataFrame, left: str, right: str, chunk_bytes: int = 1 << 19, most_words: int = 250_000) -> DataFrame:
    """A row for each document: its counts and digest, its distinct pairs as numbers in its chunk's list, and how often each is linked; a chunk's first row has the list.

    docs needs doc_id and text. A task holds one Arrow batch (4 MB, or one text), aligned in pieces of chunk_bytes."""
    spark = docs.sparkSession
    ship(spark)
    with open(left, encoding="utf-8") as f, open(right, "rb") as g:
        models = spark.sparkContext.broadcast((f.read(), g.read()))
    key = uuid.uuid4().int
    schema = _LINKS.format(id="doc_id", type=docs.schema["doc_id"].dataType.simpleString())
    ints, pair_type = pa.list_(pa.int32()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = lone(key, lambda: Aligner(*models.value, most_words))
        first = TaskContext.get().partitionId() << 33
        for k, batch in enumerate(b for b in batches if b.num_rows):
            texts, found, pairs, times, n_of = text_bytes(batch.column("text")), {}, [], [], []
            for i, j in slices(texts, [len(t) for t in texts], chunk_bytes):
                made, links, text_of = aligner.align(aligner.encode([t.decode() for t in texts[i:j]]))
                for name, values in made.items():
                    found.setdefault(name, []).extend(values)
                edges = np.concatenate([[0], made["n_links"]]).cumsum()
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    links[x:y].sort()
                starts = np.flatnonzero(np.append(True, (links[1:] != links[:-1]) | (text_of[1:] != text_of[:-1]))) if len(links) else np.zeros(0, np.int64)
                pairs.append(links[starts])
                times.append(np.diff(np.append(starts, len(links))))
                n_of.append(np.bincount(text_of[starts], minlength=j - i))
            known, at, held = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            edges = np.concatenate([[0], *n_of]).cumsum().astype(np.int32)
            n = batch.num_rows
            listed = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (known // _SHIFT, known % _SHIFT, held)], names=["a", "b", "docs"])
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(n, len(known))).astype(np.int32)), listed).cast(pair_type)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))).cast(ints) for x in (at, np.concatenate(times))]
            counts = [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, first + k)), batch.column("doc_id"), *counts, pa.array(found["groups_sha256"], pa.string()), *lists, listed],
                names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair_at", "times", "pairs"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, docs (how many documents hold the pair linked), most_a and most_b (the highest docs of its left and of its right id)."""
    listed = links.select(F.explode("pairs").alias("p")).select("p.*")
    counts = listed.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    most = lambda side: counts.groupBy(side).agg(F.max("docs").alias(f"most_{side}"))  # noqa: E731  at most a vocabulary's rows
    return counts.join(most("a"), "a").join(most("b"), "b")


def align_documents(docs: DataFrame, left: str, right: str, **bounds) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_b for each row of docs.

    left: a byte-level BPE file; right: a sentencepiece model that adds a space.
    n_best counts links whose pair's document count is the highest of its left id,
    n_best_b of its right id, ties included; count_sum adds up the counts over links.

    Null and empty texts, and those whose tokens' bytes on a side aren't the space and
    the text (U+2581 in them), have no tokens: zeros and an empty digest. Special
    tokens' strings are plain text. Repeated rows each give a row and each count as a
    document. An empty table gives no rows. Other columns of docs are not read."""
    links = materialize(link_tokens(docs, left, right, **bounds), "links")
    counts = materialize(pair_counts(links), "pairs")
    listed = links.select("chunk", F.posexplode("pairs").alias("i", "p")).select("chunk", "i", "p.a", "p.b")
    facts = listed.join(counts, ["a", "b"]).select(F.col("chunk").alias("of"), "i", "docs", (F.col("docs") == F.col("most_a")).alias("best_a"), (F.col("docs") == F.col("most_b")).alias("best_b"))
    rows = links.drop("pairs")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", n_best long, count_sum long, groups_sha256 string, n_best_b long"

    def sums(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        i = theirs["i"].to_numpy()
        columns = {c: np.empty(len(i), np.int64) for c in ("docs", "best_a", "best_b")}
        for c, x in columns.items():
            x[i] = theirs[c].to_numpy().astype(np.int64)
        at, times = (mine[c].combine_chunks() for c in ("pair_at", "times"))
        which, often = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        edges = at.offsets.to_numpy()
        made = {c: pa.array(np.diff(np.append(0, (x[which] * often).cumsum())[edges])) for c, x in columns.items()}
        return pa.table([*(mine[c] for c in kept), made["best_a"], made["docs"], mine["groups_sha256"], made["best_b"]], names=[*kept, "n_best", "count_sum", "groups_sha256", "n_best_b"])

    return rows.groupBy("chunk").cogroup(facts.groupBy("of")).applyInArrow(sums, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), default_path(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_alignment": op13_alignment}
SQL: dict[str, str] = {}
