"""The text operators on small fixtures: against brute force, round trips and held-out accuracy, and the odd rows that each must take."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, components, decontaminate, embedding_dedup, langid, lm, minhash, quality, sharding, toxicity, warc
from graphloom.llm.gru import Lanes, Net, Shape
from graphloom.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], SCHEMA)


ODD = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "same text of five words here", "en"), (4, "same text of five words here", "en"), (None, "no id at all", "de"), (7, LONG, "en"), (8, "é😀" * 50, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).withColumns({"score": F.lit("mine"), "n_tokens": F.lit(1), "rid": F.lit(5), "key": F.lit("k"), "predicted": F.lit("p"), "lang_pred": F.lit("x")})


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


# ---- toxicity and quality


def labelled_set(spark, n=240):
    rng = random.Random(4)
    clean = ["river", "stone", "cloud", "table", "green", "walks", "slowly", "paper", "night", "music"]
    docs, labels = [], []
    for i in range(n):
        bad, low = i % 5 == 0, i % 4 == 0
        words = prose(rng, 40, clean).split()
        if bad:
            words[rng.randrange(40)] = rng.choice(["vilescum", "v1lescum", "VILESCUM", "vilеscum", "scumbagly"])
        text = " ".join(words)
        docs.append((i, (text.upper() + "!! ") * 3 if low else text.capitalize() + ".", "en"))
        labels.append((i, 0 if low else 1, int(bad)))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled_set(spark)
    lexicon = toxicity.learn_lexicon(toxicity.labelled(docs, labels, "toxic", 5, 0, 1000))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, lexicon).collect()}
    held = [(r["doc_id"], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([got[i] == y for i, y in held]) > 0.9


def test_folding_and_exceptions():
    assert toxicity.fold("Ｓtüp1d, ѕtuріd​ s7upid".encode()).split() == ["stupld", "stupid", "stupid"]
    lex = toxicity.Lexicon([(" kill ", 5.0), (" bad", 2.0)], [" kill time "], (-1.0, 2.0, 0.0))
    assert lex.hits(toxicity.fold(b"to kill time, k1ll badly")) and len(lex.hits(toxicity.fold(b"to kill time, k1ll badly"))) == 2
    assert lex.score([b"", b"kill"])[0] < 0.5 < lex.score([b"kill"])[0]


def test_quality_held_out(spark):
    docs, labels = labelled_set(spark)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score_quality(docs, labels).collect()}
    held = [(r["doc_id"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([got[i][1] == y for i, y in held]) > 0.95
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, p in got.values())


def test_classifiers_take_odd_rows_and_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = quality.score_quality(odd, none).collect()
    t = toxicity.score_toxicity(odd, toxicity.learn_lexicon(toxicity.labelled(odd, none, "toxic", 5, 0, 10))).collect()
    assert len(q) == len(t) == len(ODD) and {r["predicted"] for r in q} == {1} and {r["predicted"] for r in t} == {0}
    assert quality.score_quality(odd.limit(0), none).count() == 0


# ---- language models and languages


def test_gradient_and_carried_state():
    shape, rng = Shape(70, 3, 4), np.random.default_rng(0)
    rows, classes = np.concatenate([np.arange(70), 70 + np.arange(3)]), np.concatenate([np.arange(70) // 64, 2 + np.arange(3)])
    net = Net(shape, shape.start(np.ones(70), np.ones(3)).astype(float), rows, classes)
    texts = [rng.integers(0, 73, n) for n in (7, 3, 9, 1)]
    lanes = Lanes(texts, 2)
    loss = lambda: net.slope(lanes, 0, len(lanes.alive), np.zeros((2, 4)))[1:]
    g = loss()[0]
    for i in rng.choice(shape.total, 60, False):
        old = net.flat[i]
        ends = []
        for d in (1e-5, -1e-5):
            net.flat[i] = old + d
            ends.append(loss()[1])
        net.flat[i] = old
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[i], abs=1e-5, rel=1e-3)
    assert np.allclose([net.score([t])[0] for t in texts], net.score(texts, lanes=3, window=2))


def test_lm_base_score_is_exact_and_model_better(spark, odd):
    rng = random.Random(1)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    docs = documents(spark, [(i, prose(rng, 60, a if i % 2 else b), "en") for i in range(300)]).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    train = docs.filter("doc_id % 7 != 2 and doc_id < 300")
    counts = collections.Counter()
    for r in train.collect():
        counts.update([*(r["text"] or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    got = lm.score_documents(docs, train).collect()
    assert len(got) == 300 + len(ODD)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        if r["doc_id"] not in (4, None):
            w = [*(text[r["doc_id"]] or "").encode().lower().split(), b"\n"] if r["doc_id"] > 8 else None
            if w:
                assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
                assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in got if r["doc_id"] and r["doc_id"] > 8 and r["doc_id"] % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_of_most_words(spark, odd):
    rng = random.Random(2)
    vocab = {"aa": ["kasta", "runok", "pelim", "sador"], "bb": ["zweig", "schtor", "chlat", "wurgz"]}
    docs = documents(spark, [(i, prose(rng, 30, vocab[lang := "ab"[i % 2] * 2]), lang) for i in range(80)])
    field = langid.learn_field(docs)
    mixed = documents(spark, [(1, prose(rng, 20, vocab["aa"]) + " " + prose(rng, 8, vocab["bb"]), "zz"), (2, "12 34 !!", "zz")])
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(mixed, field).collect()}
    assert got[1][0] == "aa" and 0.5 < got[1][1] <= 1 and got[2] == ("und", 0.0)
    assert langid.identify(odd, field).count() == len(ODD)
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn_field(docs.limit(0))).collect()} == {"und"}


# ---- tokens


def test_bpe_equals_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    ref, rng = tokenizers.Tokenizer.from_file(path), random.Random(3)
    alphabet = "aab '’\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 éñß漢字١½Ⅷ😀​!!##\x00<|>s'll'T123"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a<|endoftext|>b", " " * 300, "a" * 500, "the" * 200, ""]
    e = bpe.Encoder(bpe.Model(path), most_words=500)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], e.encode(texts[at : at + 100]), strict=True):
            want = ref.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and e.decode(ids).decode() == ref.decode(want, skip_special_tokens=False)
    got = bpe.encode_documents(odd, path, with_ids=True).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() and len(r["token_ids"]) == 4 * r["n_tokens"]


# ---- duplicates


def test_shingles_equal_word_sets():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("AbcdE") for _ in range(rng.randint(0, 12))).encode() for _ in range(300)]
    sets = shingle_sets(texts)
    keys = {}
    for t, s in zip(texts, sets, strict=True):
        w = t.lower().split()
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(want) == len(s)
        for x in want:
            keys.setdefault(x, set())
    assert len({int(x) for s in sets for x in s}) == len(keys)


def brute_components(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def near_copies(rng, n):
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(150)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for i in range(n):
        kind = i % 3
        if kind == 0:
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(150)] = rng.choice(words)
        elif kind == 1:
            t = [rng.choice(words) for _ in range(60)] + passage
        else:
            t = out[-1][1].split()[: rng.randint(3, 40)]
        out.append((i, " ".join(t)))
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = near_copies(random.Random(6), 240)
    want = brute_components(rows)
    got = minhash.near_duplicates(documents(spark, [(i, t, "en") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_take_odd_rows(spark, odd, tmp_path):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    odd.write.parquet(f"file://{tmp_path}/odd")
    rest = minhash.drop_near_duplicates(spark.read.parquet(f"file://{tmp_path}/odd"))
    assert rest.count() == len(ODD) - 1 and rest.columns == odd.columns
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(5, 5), (None, 3)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.08, base[:10], np.zeros((1, 16))]).astype("f4")
    label = np.concatenate([np.arange(40) % 3, np.arange(20) % 3, np.arange(10) % 3, [0]])
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))] + [(90, None, 1), (91, [float("nan")] * 16, 1), (92, [1.0] * 16, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=8).collect()}
    u = x[:-1].astype(float) / np.linalg.norm(x[:-1].astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:-1, None] == label[None, :-1])
    comp = np.arange(len(u))
    for _ in comp:
        comp = np.where(near, comp[None, :], 1 << 30).min(1)
    assert {i: got[i] for i in range(len(u))} == {i: (int(near[i].sum()) - 1, int(comp[i]), bool(comp[i] == i)) for i in range(len(u))}
    assert all(got[i] == (0, i, True) for i in (70, 90, 91, 92)) and len(got) == len(rows)


# ---- benchmark, shards, revisits


def edit(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark, odd):
    rng = random.Random(9)
    letters = "abcdefgh "
    items = [(i, "".join(rng.choice(letters) for _ in range(80)).strip() + "x") for i in range(6)] + [(6, None), (7, "!!"), (8, "")]
    docs = []
    for i in range(60):
        t = list(items[i % 6][1].upper() if i % 2 else items[i % 6][1])
        for _ in range(i // 6):
            t[rng.randrange(len(t))] = rng.choice("qz")
        docs.append((i, "Before, " + "".join(t) + "; after that.", "en"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_contamination(documents(spark, docs), bench).collect()}
    norm = lambda s: decontaminate.normalise(s.encode())
    want = {}
    for i, t, _ in docs:
        for k, item in items[:6]:
            d = edit(norm(item), norm(t))
            if d <= int(decontaminate.RATE * len(norm(item))):
                want[i, k] = d
    assert got == want and want
    assert decontaminate.drop_contaminated(documents(spark, docs), bench).count() == 60 - len({i for i, _ in want})
    assert decontaminate.find_contamination(odd, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(odd, bench).columns == odd.columns


def test_shards_by_bytes(spark, odd):
    rng = random.Random(10)
    docs = documents(spark, [(i, "hot copy" if i % 3 == 0 else "x" * rng.randint(0, 400), "en") for i in range(4000)])
    got = sharding.shard_rows(docs, shards=16).toPandas()
    by = got.groupby("shard")
    sizes = by["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() < 0.02 * sizes.mean() + 800
    assert all(sorted(s) == list(range(len(s))) for _, s in by["slot"])
    r = got[got.doc_id == 3].iloc[0]
    assert r["size"] == 9 and r["text_crc32"] == zlib.crc32(b"hot copy")
    some = sharding.shard_rows(odd).collect()
    assert len(some) == len(ODD) and {(r["size"], r["text_crc32"]) for r in some if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert sharding.shard_rows(odd.limit(0)).count() == 0


def test_revisits_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        kind = "response" if rng.random() < 0.3 else "revisit"
        url = rng.choice([None, "http://a.org/x?utm_id=3", "https://www.A.org/x/", "https://a.org/x#f", "http://b.org/y.html", "https://b.org/y?q=1"])
        tag = rng.choice([None, '"1"', 'W/"1"', '"2"'])
        rows.append((i, url, rng.choice([None, rng.randrange(200)]) if i % 20 == 0 else rng.randrange(200), kind, tag, rng.choice([None, "d1", "d2"]), f"p{i}" if kind == "response" else None, {"etag": str(i), "x-own": str(i)}))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, payload_digest string, headers map<string,string>")
    canon = {None: None, "http://a.org/x?utm_id=3": "a.org/x", "https://www.A.org/x/": "a.org/x", "https://a.org/x#f": "a.org/x", "http://b.org/y.html": "b.org/y", "https://b.org/y?q=1": "b.org/y?q=1"}
    want = {}
    for r in (r for r in rows if r[3] == "revisit"):
        past = [p for p in rows if p[3] == "response" and r[1] and p[1] and r[2] is not None and p[2] is not None and canon[p[1]] == canon[r[1]] and p[2] < r[2]]
        p = max(past, key=lambda p: (p[2], p[0]), default=None)
        weak = lambda t: t.removeprefix("W/")
        if p is None:
            status = "no_response"
        elif r[4] and p[4]:
            status = "resolved" if weak(r[4]) == weak(p[4]) else "mismatch"
        elif r[5] and p[5]:
            status = "resolved" if r[5] == p[5] else "mismatch"
        else:
            status = "unvalidated"
        want[r[0]] = (canon[r[1]], status, p[0] if status == "resolved" else None, {"etag": str(r[0]), "x-own": str(p[0])} if status == "resolved" else None)
    for ranges in (1, 7, 512):
        got = {r["record_id"]: (r["canonical"], r["status"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(df, ranges).collect()}
        assert got == want
    assert warc.resolve_revisits(df.limit(0)).count() == 0
