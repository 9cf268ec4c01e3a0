"""Importance resampling against a plain computation with zlib's crc32."""

import collections
import hashlib
import math
import re
import zlib

from graphloom.llm.common import materialize
from graphloom.llm.importance import Chunk, dictionary, move, resample

SCHEMA = "doc_id long, text string, n_words string, bucket int"
ODD = [None, "", "  ", "one", "one two", "One TWO three", "É é 数 x_y-z 12ab", "a " * 500, "Zeile eins zwei drei " * 30, "w" * 3000 + " end", "x\x00y\x7fz"]


def features(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in (1, 2, 3) if i + k <= len(words)]


def plain(rows, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    mine = [features(t) for _, t in rows]
    s = collections.Counter(bucket(f) for _, fs in mine for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for (i, _), (n, fs) in zip(rows, mine, strict=True):
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def got(spark, rows, target, **more):
    docs = materialize(spark.createDataFrame([(i, t, "mine", 3) for i, t in rows], SCHEMA).repartition(3))
    return sorted((tuple(r) for r in resample(docs, spark.createDataFrame([(1, t) for t in target], "item_id long, text string"), **more).collect()), key=str)


def test_odd_texts_ties_and_repeats(spark):
    rows = [*enumerate(ODD), (None, "no id but some words " * 9), (7, ODD[7]), (7, ODD[7]), *((100 + i, f"many documents of words number {i} " * 5) for i in range(60))]
    target = ["one two three", None, "", "many documents of one kind", "many documents of one kind"]
    assert got(spark, rows, target) == plain(rows, target)
    assert got(spark, rows, target, percent=100, least_words=0) == plain(rows, target, 100, 0)


def test_empty_tables(spark):
    rows = [(1, "some words " * 20), (2, None)]
    assert got(spark, rows, []) == plain(rows, [])
    assert got(spark, [], ["some target"]) == []


def test_repeated_id_is_spread(spark):
    rows = [(1, "the same words again and again " * 5)] * 300
    assert got(spark, rows, ["same words"], percent=50) == plain(rows, ["same words"], 50)


def test_dictionary_of_all_strings(spark):
    docs = spark.createDataFrame([(t,) for t in ODD], "text string")
    want = collections.Counter(f for t in ODD for f in features(t)[1])
    assert {r["feature"]: (r["n"], r["bucket"]) for r in dictionary(docs).collect()} == {f: (n, zlib.crc32(f.encode()) % 10_000) for f, n in want.items()}


def test_chunk_hashes_are_those_of_the_strings():
    chunk = Chunk([(t or "").encode() for t in ODD])
    want = [zlib.crc32(f.encode()) % 10_000 for t in ODD for f in features(t)[1]]
    assert sorted(b for k in chunk.buckets for b in k.tolist() if b >= 0) == sorted(want)
    assert chunk.counts().sum() == len(want)
    for n in (0, 1, 2, 5, 100, 70_001):
        zeros = b"\0" * n
        moved = zlib.crc32(b"head" + zeros) ^ zlib.crc32(zeros)
        tables = move(n)
        x = zlib.crc32(b"head")
        assert int(tables[0, x & 255] ^ tables[1, x >> 8 & 255] ^ tables[2, x >> 16 & 255] ^ tables[3, x >> 24]) == moved
