"""Alignment of two tokenizers against the two libraries and a plain walk over the bytes."""

import collections
import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm.alignment import align_documents
from graphloom.llm.bpe import byte_alphabet, default_path

SCHEMA = "doc_id long, text string, chunk string, pairs int"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_b"]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox jumps over the lazy dog", "the quick brown fox", "  two  spaces and a tab\t\n\n end ", " ", "", None, "a", "<|endoftext|> and <s> are text", "under▁score",
    "naïve café ☃ 😀 日本語", "word " * 3000, "x" * 5000, "repeated repeated repeated", "repeated repeated repeated", "nul \x00 byte", "don't we'll  they've 1234567 1e10", "ſt ﬁ Å",
]


def plain(texts):
    """For each text what the contract asks for, byte by byte."""
    left = Tokenizer.from_file(default_path())
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet = byte_alphabet()
    pieces = [right.id_to_piece(i) for i in range(right.get_piece_size())]
    of_piece = lambda n: bytes([int(n[3:5], 16)]) if re.fullmatch("<0x..>", n) else n.replace("▁", " ").encode()
    rows, holders = [], collections.Counter()
    for text in texts:
        rows.append(None)
        if not text:
            continue
        a = left.encode(" " + text, add_special_tokens=False).ids
        b = right.encode(text)
        bytes_a = [bytes(alphabet[c] for c in left.id_to_token(i)) for i in a]
        bytes_b = [of_piece(pieces[i]) for i in b]
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            continue
        owner = [[k for k, x in enumerate(side) for _ in x] for side in (bytes_a, bytes_b)]
        links = list(dict.fromkeys(zip(*owner)))
        ends = [set(), set()]
        for side, at in zip((bytes_a, bytes_b), ends):
            n = 0
            for x in side:
                n += len(x)
                at.add(n)
        groups, i, j, n, m = [], 0, 0, 0, 0
        for cut in sorted(ends[0] & ends[1]):
            ga, gb = [], []
            while n < cut:
                n += len(bytes_a[i])
                ga.append(a[i])
                i += 1
            while m < cut:
                m += len(bytes_b[j])
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        pairs = [(a[x], b[y]) for x, y in links]
        holders.update(set(pairs))
        rows[-1] = (len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest())
    most_a, most_b = {}, {}
    for (x, y), n in holders.items():
        most_a[x], most_b[y] = max(n, most_a.get(x, 0)), max(n, most_b.get(y, 0))
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
        else:
            n_a, n_b, n_groups, pairs, digest = r
            out.append((n_a, n_b, n_groups, len(pairs), sum(holders[p] == most_a[p[0]] for p in pairs), sum(holders[p] for p in pairs), digest, sum(holders[p] == most_b[p[1]] for p in pairs)))
    return out


def rows_of(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("chunk_bytes,most_words", [(1 << 19, 250_000), (40, 3)])
def test_against_the_libraries(spark, chunk_bytes, most_words):
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    got = align_documents(docs, default_path(), PIECES, chunk_bytes=chunk_bytes, most_words=most_words)
    assert rows_of(got) == dict(enumerate(plain(TEXTS)))


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "same text", "c", 1), (1, "same text", "c", 1), (None, "other text", "c", 1)], SCHEMA)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in align_documents(docs, default_path(), PIECES).collect()), key=str)
    assert got == sorted(plain(["same text", "same text", "other text"]), key=str)
    nothing = spark.createDataFrame([(1, None, "c", 1), (2, "", "c", 1)], SCHEMA)
    assert set(rows_of(align_documents(nothing, default_path(), PIECES)).values()) == {(0, 0, 0, 0, 0, 0, "", 0)}
    assert align_documents(docs.limit(0), default_path(), PIECES).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows_of(align_documents(docs, default_path(), PIECES)) == dict(zip(found, plain(found.values())))
