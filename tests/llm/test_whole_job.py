"""Text operators on rows that a cut would lose."""

import tracemalloc

import numpy as np

import corpus_pipeline
from graphloom.llm import decontaminate, langid, lm, quality
from graphloom.llm.common import logistic_fit, sigmoid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_drops_pairs_of_similarity_80(spark, tmp_path):
    a = [f"w{i}" for i in range(100)]
    near, far = a[:90] + [f"n{i}" for i in range(10)], a[:85] + [f"f{i}" for i in range(15)]  # 86 / 106 and 81 / 111 shared shingles
    rows = [(1, " ".join(a), "en", "s", None), (2, " ".join(near), "en", "s", None), (3, " ".join(far), "en", "s", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/docs")
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"file://{tmp_path}/docs"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_items_without_id_and_with_one_id(spark):
    x, y = "the quick brown fox jumps over the lazy dog again", "pack my box with five dozen liquor jugs tonight"
    bench = spark.createDataFrame([(None, x), (5, y), (5, y.replace("five", "fivx"))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Well: {x}."), (2, f"And {y}!"), (3, "nothing of that kind here")], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_contamination(docs, bench).collect()]
    assert sorted(got, key=repr) == [(1, None, 0), (2, 5, 0), (2, 5, 1)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]


def test_network_learns_from_every_training_row(spark):
    docs = spark.createDataFrame([(i, "red green blue " * 400) for i in range(2)], "doc_id long, text string")
    for i in range(2):
        one = docs.filter(f"doc_id = {i}")
        learnt, blank = (lm.score_documents(one, one, **k).first()["score"] for k in ({}, {"rounds": 0}))
        assert learnt > blank


def test_quality_learns_from_every_labelled_row_and_every_pair(spark):
    rng = np.random.default_rng(3)
    kinds = [" ".join(rng.choice(["Aa", "b!", "c9", "dd-", "e\n"], 1 + i % 7)) for i in range(30)]
    n = 12_000
    kind, label = np.arange(n) % 30, (rng.random(n) < 0.2 + 0.02 * (np.arange(n) % 30)).astype(int)
    docs = spark.createDataFrame([(i, kinds[k]) for i, k in enumerate(kind.tolist())], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(label.tolist())), "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, 4, 5)  # no remainder is 5: none is held out
    assert rows.count() == n
    x = np.array([quality.features(t.encode()) for t in kinds])
    whole, spread = quality.Ranker(x[kind], label), quality.Ranker.of_rows(rows)
    assert np.allclose(whole.weights, spread.weights, atol=1e-3) and abs(whole.threshold - spread.threshold) < 1e-2
    # the loss of all pairs of rows is flat at the weights
    z = whole.expand(x)
    s = z @ whole.weights
    good, bad = np.bincount(kind, label), np.bincount(kind, 1 - label)
    pull = good[:, None] * bad * sigmoid(s - s[:, None])
    slope = (pull.sum(1) @ z - pull.sum(0) @ z) / (good.sum() * bad.sum()) - 2.5e-5 * whole.weights
    assert np.abs(slope).max() < 2e-5
    # no other threshold tells the rows' labels better apart
    gain = [bad[s < t].sum() / bad.sum() - good[s < t].sum() / good.sum() for t in [*s, s.max() + 1, whole.threshold]]
    assert gain[-1] == max(gain)


def test_quality_loss_is_that_of_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((200, quality.N_FEATURES))
    y = (x[:, 0] + x[:, 3] / 2 + rng.normal(0, 0.2, 200) > 0.7).astype(int)
    r = quality.Ranker(x, y)
    z = r.expand(x)
    pairs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    assert np.abs(r.weights - logistic_fit(pairs, None, 2.5e-5 * len(pairs))).max() < 1e-3


def test_pipeline_learns_languages_in_little_memory(monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"{a:x}q{a * 7919 % 99991:x}".encode() for a in range(30_000)]
    texts = [[words[i] for i in rng.integers(0, len(words), 400)] for _ in range(1000)]
    gold = (np.arange(1000) % 4).tolist()

    def fitted(n):
        field = langid.Field(list("abcd"), langid.Features(words[:100]))
        field.fit(texts[:n], gold[:n], rounds=2)
        return field

    tracemalloc.start()
    try:
        fitted(1000)
        assert tracemalloc.get_traced_memory()[1] < 70e6  # 110e6 when all places are worked on at once
    finally:
        tracemalloc.stop()
    at_once = fitted(60)
    monkeypatch.setattr(langid.Field, "CHUNK", 1000)
    monkeypatch.setattr(langid.Field, "PIECE", 777)
    for a, b in zip((at_once.weights, at_once.steps, at_once.first), (lambda f: (f.weights, f.steps, f.first))(fitted(60)), strict=True):
        assert np.allclose(a, b, atol=1e-3)


def test_lm_rare_words_of_a_text_come_once_with_counts_and_classes():
    rng = np.random.default_rng(4)
    head = [(lm.END, 9), (b"the", 5), (b" " + b"x" * 32, 2)]
    v = lm.Vocabulary(head, 2, 100, 40, np.ones(lm.OPEN), np.ones(lm.OPEN))
    words = ["the", "a,", "rare", "Rare", "é!", "y" * 64, "z" * 65, "z" * 66, "..."]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (0, 1, 30, 200)]
    _, n, rare, of, times, kind = v.symbols(texts)
    want = {}
    for i, t in enumerate(texts):
        for w in t.lower().split():
            if w != b"the":
                want[i, lm.token_of(w)] = want.get((i, lm.token_of(w)), 0) + 1
    got = {}
    for i, w, c in zip(of.tolist(), rare, times.tolist(), strict=True):
        got[i, w] = got.get((i, w), 0) + c
    assert got == want and n.tolist() == [len(t.split()) + 1 for t in texts]
    assert kind.tolist() == [lm.open_class(w) for w in rare]
    assert len(rare) == len(want)
    assert len(v.symbols(texts, rest=False)[2]) == 0
