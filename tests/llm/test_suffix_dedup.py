"""Removal of repeated byte strings against a plain dictionary of all strings."""

import collections
import hashlib
import random

import pytest

from graphloom.llm import suffix_dedup
from graphloom.llm.common import materialize
from graphloom.llm.suffix_dedup import drop_repeats, op11_suffix_dedup

SCHEMA = "doc_id long, text string, rid string, kept int"


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return out


def got(docs, length):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in drop_repeats(docs, length).collect()}


def check(spark, texts, length, parts=3):
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in enumerate(texts)], SCHEMA).repartition(parts)
    docs = materialize(docs)  # rows of files have keys that last
    want = {i: (n, gone, spans, kept if gone else None) for i, (n, gone, spans, kept) in enumerate(plain(texts, length))}
    assert got(docs, length) == want


def corpus(seed, n, length):
    """Texts that share passages of lengths around `length`, at any offset, with copies, small edits, and periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(1, 9)))
    prose = lambda k: "".join(word() for _ in range(k))
    shared = [prose(rng.randint(length // 8, length // 2)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice([prose(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 30) :]]) for _ in range(rng.randint(0, 5)))
        texts.append(t)
        if rng.random() < 0.3 and len(t) > 10:
            at = rng.randrange(len(t))
            texts.append(t[:at] + rng.choice(["", "#", "###"]) + t[at:])
    exact = shared[0].encode()[: length - 1].decode(errors="ignore")
    return [*texts, "ab" * length, "a" * (2 * length), "x" + "a" * (length + 3) + "y", exact + "1", exact + "2", None, "", "short", texts[0], texts[0]]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_strings(spark, seed):
    check(spark, corpus(seed, 25, 100), 100)


def test_small_pieces(spark, monkeypatch):
    # workers import the module anew, so the bound is set where the arrays are made
    texts = [t for t in corpus(5, 30, 100) if t]
    raw = [t.encode() for t in texts]
    whole = [suffix_dedup.Anchors([x], 100) for x in raw]
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    for x, y in zip(whole, (suffix_dedup.Anchors([x], 100) for x in raw), strict=True):
        assert all((getattr(x, c) == getattr(y, c)).all() for c in ("place", "gram", "first", "last"))


def test_boundaries_of_length(spark):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    s = noise(400)
    texts = [noise(300) + s + noise(200), noise(50) + s + noise(10), noise(700) + s[1:] + noise(70), s[:399], noise(1000), s * 3, noise(90_000) + s]
    check(spark, texts, 400)


def test_no_rows_and_nothing_repeated(spark):
    docs = spark.createDataFrame([(1, "abc" * 10, "c", 1), (None, None, "c", 1)], SCHEMA)
    assert got(docs, 100) == {1: (30, 0, 0, None), None: (0, 0, 0, None)}
    assert drop_repeats(docs.limit(0), 100).count() == 0


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(rows, plain([r["text"] for r in rows], 400), strict=True)}
    assert {r[0]: tuple(r[1:]) for r in op11_suffix_dedup(spark, "/root/testdata/sf0.001").collect()} == want
