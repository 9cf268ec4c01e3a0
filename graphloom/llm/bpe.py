"""Byte-level BPE by traversal of a trie of distinct words.

The encoding of a string's prefix is fixed by its last token: what stands
before that token is again a prefix with an encoding of its own. So a trie of
the distinct words needs one number a node, the last token of the encoding of
the path to it, and a prefix that many words share is worked out once. The
trie is held as its sorted words with their common-prefix lengths, which is
the order of its depth-first traversal; the path's states are a stack.

A suffix of the path is the last token if it is a token, encodes to itself, and
may follow the last token of what stands before it: no merge across their
boundary comes before the merges that build the two. That depends on the two
tokens alone and is remembered.

Words, ids and texts are those of the tokenizers library for the same file,
with add_special_tokens=False: a special token's string in a text becomes its id.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graphloom.llm.common import lone, ship, slices, table, text_bytes

_NEVER = 1 << 60
#: The byte-level split pattern, with white space spelled out as the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII characters only.
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the file: itself where printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(free)] = b
            free += 1
    return out


class Model:
    """Tokens as bytes, merges by id, special tokens; picklable, to be broadcast (its size is the vocabulary's)."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.bytes_of[i] = s.encode() if s in self.special else as_bytes(s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.merges: list[tuple[int, int, int]] = []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))


class TrieEncoder:
    def __init__(self, model: Model):
        self.special = model.special
        self.bytes_of = model.bytes_of
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(model.merges)}
        self.made = {c: (a, b, r) for r, (a, b, c) in reversed(list(enumerate(model.merges)))}
        hidden = set(model.special.values())
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        #: Tokens that their own bytes encode to; no other token is ever in an encoding.
        self.ids = {b: i for i, b in enumerate(model.bytes_of) if b and i not in hidden and self.whole(i)}
        self.longest = max(map(len, self.ids))
        self._split = regex.compile(SPLIT)
        self._split_ascii = re.compile(SPLIT_ASCII)
        self._at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that in turn end (side 1) or begin (side 0) the token while it is built, each with the rank of the merge that takes it up."""
        down, t = [(token, _NEVER)], token
        while t in self.made:
            r = self.made[t][2]
            t = self.made[t][side]
            down.append((t, r))
        return down[::-1]

    def follows(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens when their bytes are encoded together."""
        key = a << 32 | b
        found = self._pairs.get(key)
        if found is None:
            left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
            found = True
            while True:
                (x, up_x), (y, up_y) = left[i], right[j]
                r = self.rank.get((x, y), _NEVER)
                if r < up_x and r <= up_y and r < _NEVER:
                    found = False
                    break
                if up_x == up_y == _NEVER:
                    break
                if up_x <= up_y:
                    i += 1
                else:
                    j += 1
            self._pairs[key] = found
        return found

    def whole(self, token: int) -> bool:
        """Whether the token's bytes encode to the token."""
        found = self._whole.get(token)
        if found is None:
            if token not in self.made:
                found = True
            else:
                a, b, r = self.made[token]
                found = self.whole(a) and self.whole(b) and self._joins(a, b, r)
            self._whole[token] = found
        return found

    def _joins(self, a: int, b: int, r: int) -> bool:
        """Whether no merge across the boundary of a and b comes before theirs, at rank r."""
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            (x, up_x), (y, up_y) = left[i], right[j]
            if up_x == up_y == _NEVER:
                return True
            s = self.rank.get((x, y), _NEVER)
            if s < up_x and s <= up_y:
                return False
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def forget(self, most: int) -> None:
        if len(self._pairs) > most:
            self._pairs.clear()

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of each distinct word, by one traversal of their trie."""
        ids, follows, known, longest = self.ids.get, self.follows, self._pairs.get, self.longest
        out: dict[bytes, list[int]] = {}
        path, last, begins = b"", [], []  # for each byte of the path: the last token of the prefix that ends there, and where it begins
        for word in sorted(set(words)):
            n, most = 0, min(len(path), len(word))
            while n < most and path[n] == word[n]:
                n += 1
            del last[n:], begins[n:]
            for end in range(n + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    t = ids(word[begin:end])
                    if t is None:
                        continue
                    if begin == 0:
                        break
                    stays = known(last[begin - 1] << 32 | t)
                    if stays or stays is None and follows(last[begin - 1], t):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(t)
                begins.append(begin)
            path, got, end = word, [], len(word)
            while end:
                got.append(last[end - 1])
                end = begins[end - 1]
            got.reverse()
            out[word] = got
        return out

    def words(self, text: str) -> list[str]:
        return (self._split_ascii if text.isascii() else self._split).findall(text)

    def parts(self, text: str) -> list[str]:
        """The text's words; a special token's string stands alone."""
        if self._at_special is None or not self._at_special.search(text):
            return self.words(text)
        out = []
        for piece in self._at_special.split(text):
            out += [piece] if piece in self.special else self.words(piece)
        return out


class Encoder:
    """Encodes text after text, remembering words as packed little-endian ids; of too many words, those met in more than one batch stay, up to half as many as fit."""

    def __init__(self, model: Model, most_words: int = 400_000):
        self.trie, self.most = TrieEncoder(model), most_words
        self.packed: dict[str, bytes] = {s: i.to_bytes(4, "little") for s, i in model.special.items()}
        self.unit = [i.to_bytes(4, "little") for i in range(len(model.bytes_of))]
        self.again: set[str] = set()

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.trie.parts(t) for t in texts]
        if len(self.packed) > self.most:
            kept = itertools.islice(self.again, self.most // 2)
            self.packed = {w: self.packed[w] for w in {*kept, *self.trie.special}}
            self.again = set()
        self.trie.forget(2 * self.most)
        words = set().union(*parts)
        new = words - self.packed.keys()
        self.again |= words - new
        unit, packed = self.unit, self.packed
        for word, ids in self.trie.encode_words([w.encode() for w in new]).items():
            packed[word.decode()] = b"".join([unit[i] for i in ids])
        return [b"".join(map(packed.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.trie.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, chunk_bytes: int = 1 << 19, most_words: int = 400_000) -> DataFrame:
    """All columns of docs, then n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids (little-endian unsigned 32-bit).

    docs needs a text column; columns named as one of the results are replaced.
    Null and empty text: no tokens. Repeated rows each give a row. No shuffle; a
    task holds the words of chunk_bytes of text, or of one text, and a worker the ids
    of at most about most_words words: fewer take less memory and more time."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(Model(path))
    key = uuid.uuid4().int
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    docs = docs.select([c for c in docs.columns if c not in made])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + [T.StructField("token_ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = lone(key, lambda: Encoder(model.value, most_words))
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in slices(texts, [len(t) for t in texts], chunk_bytes):
                ids = encoder.encode([t.decode() for t in texts[a:b]])
                columns = [*batch.slice(a, b - a).columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=[*batch.schema.names, *made[: 3 + with_ids]])

    return docs.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path()).drop("text")


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}
