"""Each text operator where it may go wrong: repeats, ties, extreme values, clashing columns, empty tables; and against plain enumeration."""

import itertools
import operator
import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import bpe, decontaminate, embedding_dedup, langid, lm, minhash, quality, sharding, toxicity, warc
from graphloom.llm.common import drop_rows, py_remainder, row_key, tree_total

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("rid", "key", "value", "root", "slot", "shard", "score", "predicted", "n_tokens", "canonical", "range", "found", "copies", "cid", "cap", "_slot", "_marked", "_bits", "_at", "_doc_rid", "at", "mask", "marked", "token", "kind")


def clash(df):
    """df with columns called as the operators call theirs."""
    return df.withColumns({c: F.lit("mine") for c in NAMES if c not in df.columns})


# ---- shards


def test_equal_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(7, "the same text")], "doc_id long, text string").crossJoin(spark.range(3200).select())
    got = sharding.shard_rows(docs).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() < 0.1 * sizes.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


def test_heavy_bins_number_without_gaps(spark):
    rows = [(i, "hot") for i in range(600)] + [(5, "hot")] * 900 + [(None, None)] * 300 + [(i, f"text {i}") for i in range(300)]
    for heavy in (1, 2, 16):
        got = sharding.shard_rows(clash(spark.createDataFrame(rows, "doc_id long, text string")), shards=4, heavy=heavy).toPandas()
        assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


# ---- vectors


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label long")


def linked(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_labels_far_apart_and_negative_never_link(spark):
    v = [1.0 + 0.01 * i for i in range(16)]
    labels = [0, 1 << 19, -1, (1 << 31) - 1, 1 << 40, None]
    got = linked(embedding_dedup.near_vectors(vectors(spark, [(i, v, y) for i, y in enumerate(labels)])))
    assert got == {i: (0, i, True) for i in range(len(labels))}


def test_dimensions_stay_apart_and_few_ones_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for dim in (1, 2, 3, 5, 7, 8, 24):
        base = rng.normal(size=(30, dim))
        every = np.concatenate([base, base[:15] + rng.normal(size=(15, dim)) * 0.1])
        rows += [(at + i, x.tolist(), 4) for i, x in enumerate(every)]
        at += len(every)
    got = linked(embedding_dedup.near_vectors(clash(vectors(spark, rows)), block=8))
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x, _ in rows}
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in unit}
    assert {i: got[i][0] for i in unit} == {i: len(x) for i, x in links.items()} and sum(map(len, links.values())) > 100


def test_double_precision_and_extreme_lengths(spark):
    near, angle = [1.0] + [0.0] * 15, np.arccos(0.98)
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))] + [0.0] * 14
    got = linked(embedding_dedup.near_vectors(vectors(spark, [(0, near, 1), (1, turn(angle - 1e-10), 1), (2, turn(-angle - 1e-10), 1), (3, [1e300 * x for x in near], 1), (4, [1e-300 * x for x in near], 1), (5, [], 1), (6, [float("inf")] * 16, 1)])))
    assert {i: got[i][0] for i in range(7)} == {0: 3, 1: 3, 2: 0, 3: 3, 4: 3, 5: 0, 6: 0}
    assert embedding_dedup.near_vectors(vectors(spark, [])).count() == 0


def test_codebooks_grow_with_the_label():
    assert embedding_dedup.words_for(10, 9) == 128 and embedding_dedup.words_for(50_000, 9) > 2 * embedding_dedup.words_for(10_000, 9) > 1000
    codes = embedding_dedup.Codes(32, 2, 9.0, 300)
    x = np.random.default_rng(1).normal(size=(200, 32))
    assert 4 < np.mean([len(c) for c in codes.caps(x / np.linalg.norm(x, axis=1, keepdims=True))]) / 2 < 18


# ---- near duplicates


def test_large_sets_in_small_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "ITEMS", 2000)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(rng.choice([0, 5, 16, 20, 24, 60])):
            t[rng.randrange(900)] = f"x{i}-{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(896)} for i, t in rows}
    for percent in (80, 85):
        comp = {i: i for i in sets}
        for _ in sets:
            for a, b in itertools.combinations(sets, 2):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        docs = clash(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS))
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, percent).collect()} == comp and 1 < len(set(comp.values())) < 40


def test_a_piece_gives_no_more_links_than_roots(spark):
    rng = np.random.default_rng(5)
    common = np.sort(rng.integers(0, 1 << 60, 400))
    rows = [(1, i, i, 400, 1, common.tolist()) for i in range(60)]
    got = minhash._confirmed_links(spark.createDataFrame(rows, "value long, key long, root long, n long, blocks int, items array<long>"), 85, 0.52, 48)
    assert got.count() == 59


def test_rows_go_whatever_columns_are_called(spark, tmp_path):
    clash(spark.range(40).withColumnRenamed("id", "doc_id")).write.parquet(f"file://{tmp_path}/t")
    docs = spark.read.parquet(f"file://{tmp_path}/t")
    gone = docs.select(row_key().alias("rid"), "doc_id").filter("doc_id % 3 = 0").select("rid")
    left = drop_rows(docs, gone, bits=4)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [i for i in range(40) if i % 3] and {r["_slot"] for r in left.collect()} == {"mine"}


# ---- classifiers


def test_lexicon_equals_naive_search():
    rng = random.Random(6)
    entries = [(" ab", 2.5), (" abc ", 4.0), ("cab", 3.0), (" b", 1.5), (" ii ", 5.0)]
    spared = [" abc b ", " b b ", " ii a "]
    lex = toxicity.Lexicon(entries, spared)
    for _ in range(300):
        raw = " ".join("".join(rng.choice("abcil1|") for _ in range(rng.randint(1, 4))) for _ in range(12))
        alike = lambda a, b: a == b or {a, b} <= set("il1|")
        stands = lambda p, at: at + len(p) <= len(text) and all(map(alike, p, text[at:]))
        text, want = f" {raw} ", {}
        for p, w in entries:
            for at in range(len(text)):
                if stands(p, at):
                    want[at] = max(w, want.get(at, 0))
        for at in list(want):
            if any(stands(s, a) and a <= at < a + len(s) - 1 for s in spared for a in range(len(text))):
                del want[at]
        assert lex.hits(toxicity.fold(raw.encode())) == want


def test_every_mix_of_signs_for_a_word():
    signs = {"i": "iIl1|Іιí", "d": "dD", "o": "oO0οо", "t": "tT7т", "a": "aA4@а", "s": "s5$S", "e": "e3е", "l": "lL1|iI"}
    lex = toxicity.Lexicon([(" idiot", 1.0), (" silly ", 2.0), (" b1lge ", 3.0)])
    for word, weight in (("idiot", 1.0), ("silly", 2.0)):
        for mix in itertools.product(*(signs.get(c, c) for c in word)):
            assert lex.hits(toxicity.fold(f"you {''.join(mix)} there".encode())) == {4: weight}, mix
    assert lex.hits(toxicity.fold(b"bilge")) == {0: 3.0} and lex.hits(toxicity.fold(b"odious stall bulge")) == {}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(7)
    lengths = np.array([3, 1, 4, 2])
    e, step, first = rng.random((10, 3)), rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    chains = langid.Chains(lengths)
    got, pairs = chains.posterior(e[chains.source], step, first)
    want, want_pairs, at = np.zeros((10, 3)), np.zeros((3, 3)), 0
    for n in lengths:
        paths = list(itertools.product(range(3), repeat=int(n)))
        weight = np.array([first[p[0]] * np.prod([e[at + i, y] for i, y in enumerate(p)]) * np.prod([step[a, b] for a, b in itertools.pairwise(p)]) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for i, y in enumerate(p):
                want[at + i, y] += w
            for a, b in itertools.pairwise(p):
                want_pairs[a, b] += w
        at += n
    assert np.allclose(got, want[chains.source]) and np.allclose(pairs, want_pairs)


def test_threshold_is_a_quantile():
    rng = np.random.default_rng(8)
    x, y = rng.random((200, quality.N_FEATURES)), np.arange(200) % 2
    x[:, 0] += y
    for q in (0.1, 0.5, 0.9):
        r = quality.Ranker(x, y, quantile=q)
        assert abs((r.score(x) >= quality.AT_THRESHOLD).mean() - (1 - q)) < 0.02
    assert 0.3 < quality.Ranker(x, y).quantile < 0.7


def test_samples_are_bounded_however_often_an_id_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en") for i in range(50)] + [(3, "other", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    assert quality.labelled(docs, labels, "quality", 4, 2, 10).count() == 2
    assert langid.learn_field(docs, bound=5).labels == ["de", "en"]


def test_slopes_of_tasks_are_those_of_all_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["kasta", "runok", "zweig", "chlat", "é"]) for _ in range(rng.choice([1, 5, 700]))), rng.choice(["aa", "bb"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid.learn_field(docs, part_bytes=2000)
    alone = langid.Field(field.labels, field.features)
    mine = [(t, lang) for i, t, lang in rows if py_remainder(i, 4) != 2]
    alone.fit([langid.words_of(t.encode()) for t, _ in mine], [field.labels.index(lang) for _, lang in mine])
    assert np.allclose(field.steps, alone.steps, atol=1e-2) and np.allclose(field.weights, alone.weights, atol=1e-2)


def test_one_language_no_text_and_no_table(spark):
    docs = spark.createDataFrame([(i, "some words", "en") for i in range(9)] + [(20, None, "de"), (21, "12", "fr"), (22, None, None)], "doc_id long, text string, lang string")
    got = {(r["text"], r["lang_pred"]) for r in langid.identify(docs.select("doc_id", "text"), langid.learn_field(docs)).collect()}
    assert got == {("some words", "en"), (None, "und"), ("12", "und")}
    assert langid.learn_field(docs.filter("text is null")).labels == [] and langid.learn_field(docs.limit(0)).labels == []


def test_totals_in_a_tree_keep_the_order(spark):
    parts = spark.range(0, 70, numPartitions=70).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([pickle.dumps([int(x)]) for x in b.column(0).to_pylist()], pa.binary())], names=["i", "got"]) for b in batches), "i long, got binary")
    assert tree_total(parts, operator.add, width=4) == list(range(70)) and tree_total(parts.limit(0), operator.add) is None


# ---- language model


def test_lm_on_odd_tables(spark):
    long = "y" * 5000
    docs = clash(spark.createDataFrame([(1, f"a a {long}"), (2, f"{long} b"), (3, None), (None, "")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in lm.score_documents(docs, docs).collect()}
    n, v = 9, 4  # a twice, the long word twice, b, four ends
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["train_tokens"]) == (4, 4, n)
    assert got[1]["base_score"] == pytest.approx(sum(np.log10((c + 1) / (n + v + 1)) for c in (2, 2, 2, 4)))
    assert got[3]["n_tokens"] == got[None]["n_tokens"] == 1 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
    nothing = {r["doc_id"]: r for r in lm.score_documents(docs, docs.limit(0)).collect()}
    assert len(nothing) == 4 and nothing[1]["n_known"] == 0 and nothing[1]["train_tokens"] == 0
    assert lm.score_documents(docs.limit(0), docs).count() == 0


def test_network_equals_a_plain_forward_pass():
    rng = np.random.default_rng(9)
    shape = lm.Shape(70, 3, 5)
    flat = shape.start(np.ones(70), np.ones(3)).astype(float)
    rows, classes = np.concatenate([np.arange(70), 70 + np.arange(3)]), np.concatenate([np.arange(70) // 64, 2 + np.arange(3)])
    p, text, h, total = shape.unpack(flat), rng.integers(0, 73, 40), np.zeros(5), 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for before, s in zip([shape.inputs - 1, *rows[text[:-1]]], text, strict=True):
        x, u = p["x"][before], h @ p["u"]
        z, r = sig(x[:5] + u[:5]), sig(x[5:10] + u[5:10])
        c = np.tanh(x[10:] + r * u[10:])
        h = z * h + (1 - z) * c
        total += np.log(soft(h @ p["wc"] + p["bc"])[classes[s]])
        if s < 70:
            total += np.log(soft(h @ p["wo"][classes[s]] + p["bo"][classes[s]])[s % 64])
    assert lm.Net(shape, flat, rows, classes).score([text])[0] == pytest.approx(total)


# ---- revisits


LOG = "record_id long, url string, ts long, kind string, etag string, last_modified string, payload_digest string, headers map<string,string>"


def test_revisits_with_ties_an_outlier_and_clashing_columns(spark):
    rows = [(i, "http://a.org/x", 5 if i < 30 else 10**15 + i, "response" if i % 3 == 0 else "revisit", '"1"', None, f"p{i}", None) for i in range(36)] + [(99, "http://a.org/x", None, "revisit", None, None, None, None), (98, None, 3, "odd", None, None, None, None)]
    for ranges in (1, 512):
        got = {r["record_id"]: (r["status"], r["response_id"]) for r in warc.resolve_revisits(clash(spark.createDataFrame(rows, LOG)), ranges).collect()}
        want = {i: ("no_response", None) for i in range(30) if i % 3} | {i: ("resolved", max([27, *[j for j in range(30, i, 3)]])) for i in range(30, 36) if i % 3} | {99: ("no_response", None)}
        assert got == want


def test_the_log_of_pages_needs_other_pages(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/en/{i}", f"<p>{i}") for i in range(400)], "page_id long, url string, html string")
    got = warc.resolve_revisits(warc.records_of_pages(pages)).toPandas()
    assert set(got["status"]) == {"resolved", "mismatch", "unvalidated", "no_response"} and (got["status"] == "resolved").mean() > 1 / 3 and (got["record_id"] != got["response_id"]).all()


# ---- benchmark and the pipeline


def test_repeated_items_share_blocks_evenly(spark):
    item = "pack my box with five dozen liquor jugs tonight"
    bench = clash(spark.createDataFrame([(1, item)] * 40 + [(2, None)], "item_id long, text string"))
    assert max(len(m.items) for m in decontaminate.matchers(bench, block_bytes=200)) < 20
    docs = clash(spark.createDataFrame([(5, f"so {item}."), (6, None)], "doc_id long, text string"))
    assert decontaminate.find_contamination(docs, bench).count() == 40 and [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [6]


def corpus(tmp_path, spark, rows, labels, items):
    d = f"file://{tmp_path}"
    clash(spark.createDataFrame(rows, DOCS)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    rng = random.Random(10)
    words = {"aa": ["kasta", "runok", "pelim", "sador", "tevin", "molar"], "bb": ["zweig", "schtor", "chlat", "wurgz", "thrim", "skold"]}
    text = lambda lang, n=30: " ".join(rng.choice(words[lang]) for _ in range(n)).capitalize() + "."
    item = "kasta runok pelim sador tevin molar kasta pelim"
    rows, labels = [], []
    for i in range(120):
        lang = "ab"[i % 2] * 2
        rows.append((i, text(lang) if i % 4 else (text(lang).upper() + "!!! ") * 3, lang, "s", None))
        labels.append((i, int(i % 4 > 0), 0))
    good = [r for r in rows if r[0] % 4]
    rows += [(200, good[0][1], None, None, 3), (201, good[0][1], "aa", "t", None), (202, f"{text('aa')} {item}. {text('aa')}", "aa", "s", None), (203, None, None, None, None), (204, "", "aa", "s", None), (None, text("bb"), "bb", "s", None)]
    kept = corpus_pipeline.run(spark, corpus(tmp_path, spark, rows, labels, [(1, item), (2, None)])).collect()
    ids = {r["doc_id"] for r in kept}
    assert {r[0] for r in good} <= ids and None in ids and not ids & {200, 201, 202, 203, 204} and not any(i % 4 == 0 for i in ids if i is not None and i < 120)
    given = {r[0]: r[1] for r in rows}
    encoder = bpe.Encoder(bpe.Model(bpe.default_path()))
    assert all(r["token_ids"] == encoder.encode([given[r["doc_id"]]])[0] for r in kept)


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, corpus(tmp_path, spark, [], [], [])).count() == 0


def test_split_of_held_out_rows_is_the_contract(spark):
    ids = spark.range(50).select(F.col("id").alias("doc_id"))
    from graphloom.llm.common import remainder

    assert {r["doc_id"]: r["m"] for r in ids.withColumn("m", remainder(F.col("doc_id"), 7)).collect()} == {i: zlib.crc32(str(i).encode()) % 7 for i in range(50)}


def test_gradients_of_input_rows_are_added_up_by_row():
    from graphloom.llm.gru import add_rows

    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(0, 40, 300), np.full(90, 7), [39]])
    x, want, got = rng.normal(size=(len(rows), 6)), np.zeros((41, 6)), np.zeros((41, 6))
    np.add.at(want, rows, x)
    add_rows(got, rows, x)
    assert np.allclose(got, want) and not got[40].any()


def test_windows_lie_by_feature_and_apart():
    """Cells of a feature lie side by side, as outputs read them, and features are no multiple of a page apart."""
    shape = lm.Shape(70, 3, 5)
    flat = shape.start(np.ones(70), np.ones(3))
    rows, classes = np.concatenate([np.arange(70), 70 + np.arange(3)]), np.concatenate([np.arange(70) // 64, 2 + np.arange(3)])
    from graphloom.llm.gru import Lanes

    deal = Lanes([np.arange(64, dtype=np.int32)] * 128, 128)
    window = lm.Net(shape, flat, rows, classes).run(deal, 0, 32, np.zeros((128, 5), np.float32))[1]
    state = window["state"]
    assert state.shape == (5, 32, 128) and state.strides[1:] == (512, 4) and state.strides[0] % 4096
    assert np.shares_memory(lm.Net.by_cell(window, state), state)
