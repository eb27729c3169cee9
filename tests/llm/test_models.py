"""The toxicity classifier and language-model scores: held-out accuracy, and what the scores may depend on."""

from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tessella.llm import lm_scoring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["idiotic", "scumbag", "moronic", "worthless", "lowlife"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "er"]))
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), "s", 1))
        labels.append((i, 0, int(toxic)))
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "w1 w2", "en", "s", 5)]
    labels += [(None, 0, 1), (7, 0, None), (9999, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert sum(r.rejected for r in held if truth[r.doc_id] == 0) <= 0.02 * len(held)


def test_scores_depend_on_the_text_alone(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    want = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "score": F.lit(1), "predicted": F.lit("z"), "_text": F.lit("idiotic")})
    assert {r.doc_id: pytest.approx(r.score, abs=1e-5) for r in toxicity.score(other, model).collect()} == want


def test_held_out_labels_are_not_learned_from(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.embed, b.embed) and a.thresholds == b.thresholds


def test_clean_rows_stay_as_they_are(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    kept = toxicity.keep_clean(docs, model)
    rejected = {r.doc_id for r in toxicity.score(docs, model).collect() if r.rejected}
    assert kept.columns == docs.columns and rejected
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in rejected)


def test_no_labels_and_no_rows(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.limit(0))
    assert all(r.score <= 0.5 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def small_model(rng):
    docs = [rng.integers(0, toxicity.BUCKETS, (n, 2)).astype(np.int32) for n in (0, 1, 2, 3, 9, 40, 700)]
    p = toxicity.beginning(docs, np.array([0, 1, 0, 1, 0, 1, 0.0]), rng)
    for k, v in p.items():
        v += rng.normal(0, 0.2, v.shape)
    p["e"][-1] = 0
    return docs, p


def test_scores_are_those_of_a_plain_convolution(monkeypatch):
    rng = np.random.default_rng(6)
    docs, p = small_model(rng)
    model = toxicity.Model(p["e"].astype(np.float32), {w: p[f"f{w}"] for w in toxicity.WIDTHS}, {w: p[f"b{w}"] for w in toxicity.WIDTHS}, p["out"], float(p["ob"][0]))
    want = []
    for d in docs:
        x = np.concatenate([np.zeros((2, toxicity.DIM)), p["e"][d[:, 0]] + p["e"][d[:, 1]], np.zeros((2, toxicity.DIM))])
        pooled = [max(sum(x[i + o] @ p[f"f{w}"][o][:, k] for o in range(w)) for i in range(len(d) + 2)) + p[f"b{w}"][k] for w in toxicity.WIDTHS for k in range(toxicity.FILTERS)]
        want.append(1 / (1 + np.exp(-(np.maximum(pooled, 0) @ p["out"] + p["ob"][0]))))
    assert model.score(docs) == pytest.approx(want, abs=1e-5)
    for windows in (1, 2, 37):  # pieces of long texts, and many texts at once, change nothing
        monkeypatch.setattr(toxicity, "WINDOWS", windows)
        assert model.score(docs) == pytest.approx(want, abs=1e-5)
    texts = ["", None, "one", "a b c " * 50, "x"]
    monkeypatch.setattr(toxicity, "AT_ONCE", 3)
    assert model.score_texts(texts) == pytest.approx(model.score([toxicity.buckets(t) for t in texts]), abs=1e-6)
    assert len(model.score_texts([])) == 0


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(7)
    docs, p = small_model(rng)
    labels, weight = np.array([0, 1, 0, 1, 0, 1, 0.0]), rng.uniform(0.5, 2, 7)
    words, starts = toxicity.together(docs)
    _, g, rows = toxicity.gradients(p, words, starts, labels, weight)
    for key, v in p.items():
        for _ in range(30):
            place = (int(rng.choice(rows[:-1])), int(rng.integers(0, toxicity.DIM))) if key == "e" else tuple(rng.integers(0, n) for n in v.shape)
            was, step, ends = v[place], 1e-6, []
            for sign in (1, -1):
                v[place] = was + sign * step
                ends.append(toxicity.gradients(p, words, starts, labels, weight)[0])
            v[place] = was
            mine = g[key][np.searchsorted(rows, place[0]), place[1]] if key == "e" else g[key][place]
            assert mine == pytest.approx((ends[0] - ends[1]) / (2 * step), abs=1e-6)


def test_one_long_text_leaves_the_sample_whole(labelled, monkeypatch):
    docs, labels = labelled
    long = docs.sparkSession.createDataFrame([(i, "word " * 50_000, "en", "s", 1) for i in range(20_000, 20_005)], SCHEMA)
    more = docs.sparkSession.createDataFrame([(i, 0, i % 2) for i in range(20_000, 20_005)], labels.schema)
    want = toxicity.sample(docs, labels).count()
    assert toxicity.sample(docs.union(long), labels.union(more)).count() == want
    monkeypatch.setattr(toxicity, "MAX_CHARS", 30_000)
    some = toxicity.sample(docs, labels).groupBy("toxic").count().collect()
    assert len(some) == 2 and sum(r["count"] for r in some) < want


def test_every_labelled_row_is_learned_from(labelled, monkeypatch):
    """No bound on rows or characters changes the model, and a long text is learned from like any other."""
    docs, labels = labelled
    want = toxicity.fit(docs, labels)
    for bound, most in (("MAX_TOXIC", 20), ("MAX_CLEAN", 30), ("MAX_CHARS", 5000), ("MAX_TEXT", 100)):
        monkeypatch.setattr(toxicity, bound, most)
    monkeypatch.setattr(toxicity, "BROADCAST_IDS", 0)
    got = toxicity.fit(docs.repartition(5), labels)
    assert np.array_equal(got.embed, want.embed) and np.array_equal(got.out, want.out)
    assert got.thresholds == want.thresholds and got.default_threshold == want.default_threshold
    i = next(i for i in range(20_000, 20_100) if zlib.crc32(str(i).encode()) % 5 > 1)
    long = docs.sparkSession.createDataFrame([(i, "plainly " + "word " * 50_000, "en", "s", 1)], SCHEMA)
    more = docs.sparkSession.createDataFrame([(i, 0, 1)], labels.schema)
    place = toxicity.buckets("plainly")[0, 0]
    moved = toxicity.fit(docs.union(long), labels.union(more)).embed[place] - want.embed[place]
    assert moved[0] > 0


def test_shards_are_learned_from_together(labelled, monkeypatch):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    monkeypatch.setattr(toxicity, "SHARD", 100)
    a, b = (toxicity.fit(d, labels) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.embed, b.embed) and np.array_equal(a.out, b.out) and a.thresholds == b.thresholds
    held = [r for r in toxicity.score(docs, a).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_counts_and_thresholds_are_those_of_all_rows(labelled):
    docs, labels = labelled
    rows = toxicity.coded(toxicity.labelled(docs, labels))
    found = rows.collect()
    words, y = [toxicity._unpacked(r.words) for r in found], np.array([r.toxic for r in found])
    want = np.zeros((2, toxicity.BUCKETS + 1))
    for w, toxic in zip(words, y):
        want[toxic, np.unique(w)] += 1
    assert np.array_equal(toxicity.seen_in(rows), want)
    model = toxicity.fit(docs, labels)
    model.out_bias += 1.0  # so that clean rows are above 0.5
    for share in (0.0, 0.01, 0.2):
        toxicity.calibrate(model, words, y, [r.lang for r in found], share)
        plain, every = dict(model.thresholds), model.default_threshold
        model.tables = {}
        model.thresholds = {}
        toxicity.calibrate_by(model, rows, share)
        assert model.default_threshold == pytest.approx(every, abs=1e-6)
        assert {x: pytest.approx(model.thresholds.get(x, model.default_threshold), abs=1e-6) for x in plain} == plain


def test_places_of_long_texts_are_found_in_pieces(monkeypatch):
    rng = np.random.default_rng(8)
    docs, p = small_model(rng)
    want = toxicity.greatest(p, *toxicity.together(docs))
    for windows in (1, 2, 37):
        monkeypatch.setattr(toxicity, "WINDOWS", windows)
        for a, b in zip(want, toxicity.greatest(p, *toxicity.together(docs))):
            assert all(np.array_equal(x, y) if x.dtype == np.int64 else x == pytest.approx(y) for x, y in zip(a, b))


def test_thresholds_do_not_hang_on_one_row(labelled):
    class Told:
        thresholds: dict = {}
        default_threshold = 0.0

        def score(self, docs):
            return np.array([d[0] for d in docs])

    n = 2000
    clean = np.linspace(0, 0.6, n)
    langs = ["en"] * 1800 + ["de"] * 200
    clean[1900] = 0.99  # one odd row of a small language
    model = Told()
    toxicity.calibrate(model, [np.array([x]) for x in clean], np.zeros(n), langs)
    assert model.thresholds["de"] == model.default_threshold < 0.7 and model.thresholds["en"] < 0.7


def ordered_text(rng, n):
    """Words in which each follows from the one before."""
    out, at = [], rng.randrange(30)
    for _ in range(n):
        at = (at * 7 + 3) % 31 if rng.random() < 0.9 else rng.randrange(31)
        out.append(f"w{at}")
    return " ".join(out)


def test_language_model_tells_order(spark):
    rng = random.Random(4)
    texts = [ordered_text(rng, 120) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, "  "), (None, texts[0]), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model = lm_scoring.fit(docs.toDF("doc_id", "_text"))
    scored = lm_scoring.score(docs, model).collect()
    assert len(scored) == len(rows)
    by_id = {r.doc_id: r for r in scored}
    assert by_id[9000].n_tokens == 0 and by_id[9000].log_likelihood == 0 and by_id[9000].mean is None and by_id[9001].mean is None
    assert by_id[None].log_likelihood == pytest.approx(by_id[0].log_likelihood, rel=1e-6)
    shuffled = spark.createDataFrame([(i, " ".join(rng.sample(t.split(), 120))) for i, t in enumerate(texts)], "doc_id long, text string")
    mean = lambda rows: np.mean([r.mean for r in rows if r.mean is not None])
    assert mean(scored) > mean(lm_scoring.score(shuffled, model).collect()) + 0.3


def test_scores_are_sums_of_conditional_logs():
    rng = np.random.default_rng(0)
    w = lm_scoring.start(rng.integers(1, 50, lm_scoring.VOCABULARY).astype(float))
    w["class"] += rng.normal(0, 0.5, w["class"].shape).astype(np.float32)
    w["word"] += rng.normal(0, 0.5, w["word"].shape).astype(np.float32)
    docs = [rng.integers(0, lm_scoring.VOCABULARY, n) for n in (5, 1, 9)]
    ids, at = lm_scoring.padded(docs)
    got = lm_scoring.log_probabilities(w, ids, at)
    for place, want in zip(at, got):
        h = np.tanh(sum(w["in"][k][ids[place + o]] for k, o in enumerate(lm_scoring.OFFSETS)).astype(float))
        every = []
        z = h @ w["class"] + w["class_bias"]
        for c in range(lm_scoring.CLASSES):
            y = h @ w["word"][c] + w["word_bias"][c]
            every.append(z[c] - np.log(np.exp(z).sum()) + y - np.log(np.exp(y).sum()))
        flat = np.concatenate(every)
        assert np.exp(flat).sum() == pytest.approx(1, abs=1e-4)
        assert want == pytest.approx(flat[ids[place]], abs=1e-3)


def test_language_model_on_no_rows(spark):
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("known", [0, 100_000])
def test_language_model_covers_all_words(spark, monkeypatch, known):
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    rng = random.Random(6)
    tokens = [f"w{i}" for i in range(1200)] * 60 + [f"rare{i}" for i in range(800)] + [f"some{i}" for i in range(200)] * 5
    rng.shuffle(tokens)
    texts = [" ".join(tokens[i : i + 500]) for i in range(0, len(tokens), 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, _text string").repartition(2)
    model = lm_scoring.fit(docs)
    assert len(model.words) == 1200  # the vocabulary grows
    every = spark.createDataFrame(list(enumerate(sorted(set(tokens)))), "doc_id long, text string")
    rows = {r.text: r.log_likelihood for r in lm_scoring.score(every, model).join(every, "doc_id").collect()}
    # texts of one word have equal contexts: the probabilities of all words add up, those of a bucket by count
    assert sum(np.exp(x) for x in rows.values()) == pytest.approx(1, abs=0.01)
    bucket = lm_scoring.Vocabulary(model.words)
    pair = next((a, b) for a in rows for b in rows if a[0] == "r" and b[0] == "s" and bucket[a] == bucket[b])
    assert rows[pair[1]] - rows[pair[0]] == pytest.approx(np.log(5), abs=1e-6)


@pytest.mark.parametrize("sizes", [(7, 30), (2, 3)])
def test_gradients_are_those_of_the_loss(sizes):
    rng = np.random.default_rng(3)
    w = {k: v.astype(float) + rng.normal(0, 0.3, v.shape) for k, v in lm_scoring.start(rng.integers(1, 9, 16).astype(float)).items()}
    ids, at = lm_scoring.padded([rng.integers(0, 16, n) for n in (*sizes, 1)])
    loss = lambda: -lm_scoring.log_probabilities(w, ids, at).mean()
    got = {k: np.zeros_like(v) for k, v in w.items()}
    for key, gradient, part in lm_scoring.gradients(w, ids, at):
        got[key][part] += gradient
    for key, v in w.items():
        for _ in range(25):
            place = tuple(rng.integers(0, n) for n in v.shape)
            was, step = v[place], 1e-6
            v[place] = was + step
            more = loss()
            v[place] = was - step
            want = (more - loss()) / (2 * step)
            v[place] = was
            assert got[key][place] == pytest.approx(want, abs=1e-6)


def test_each_row_goes_by_its_own_greatest_value():
    z = np.array([[500.0, 499.0], [-500.0, -501.0], [0.0, -200.0]], dtype=np.float32)
    got = lm_scoring._log_softmax_at(z.copy(), np.array([1, 0, 1]))
    assert got == pytest.approx([-1 - np.log1p(np.exp(-1)), -np.log1p(np.exp(-1)), -200], abs=1e-4)
    assert lm_scoring._softmax(z).sum(axis=1) == pytest.approx([1, 1, 1])


def test_hash_of_words_is_spark_s(spark):
    words = ["", "a", "wörter", "x" * 31, "y" * 32, "z" * 100, "日本"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.h for r in df.selectExpr("xxhash64(w) AS h").collect()] == [lm_scoring.word_hash(w) for w in words]


def test_scores_depend_neither_on_partitions_nor_on_place(docs, clashing, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 4000)
    monkeypatch.setattr(lm_scoring, "A_WEIGHT", 0)
    rows = docs.unionByName(docs.filter("doc_id between 10 and 40"))
    a = {}
    for r in lm_scoring.score(rows).collect():
        a.setdefault(r.doc_id, set()).add((r.log_likelihood, r.mean))
    assert len(lm_scoring.score(clashing).collect()) == len(corpus)
    assert all(len(x) == 1 for i, x in a.items() if i is not None)  # repeated rows agree to the last bit
    b = lm_scoring.score(rows.repartition(7)).collect()
    for r in b:
        if r.doc_id is not None and r.mean is not None:
            assert r.log_likelihood == pytest.approx(next(iter(a[r.doc_id]))[0], rel=1e-6)
    equal = [r[0] for r in corpus if r[1] == corpus[72][1]]
    assert len(equal) >= 5 and len({x for i in equal for x in a[i]}) == 1


def test_models_of_other_partitions_are_the_same(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 4000)
    monkeypatch.setattr(lm_scoring, "A_WEIGHT", 0)
    rows = docs.select("doc_id", docs["text"].alias("_text"))
    a, b = lm_scoring.fit(rows.repartition(2)), lm_scoring.fit(rows.repartition(5))
    assert a.words == b.words and all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def weights(rng, side, spread):
    w = lm_scoring.start(rng.integers(1, 50, side * side).astype(float))
    return {k: v + rng.normal(0, spread, v.shape).astype(np.float32) for k, v in w.items()}


def test_scoring_holds_the_logits_of_few_tokens():
    """Those of a whole batch are beyond a core's cache, and much of the time went by there."""
    rng = np.random.default_rng(7)
    w = weights(rng, 78, 0.1)
    ids, at = lm_scoring.padded([rng.integers(0, 78 * 78, lm_scoring.BATCH)])
    whole = lm_scoring.BATCH * 78 * 4
    lm_scoring.log_probabilities(w, ids, at)
    tracemalloc.start()
    lm_scoring.log_probabilities(w, ids, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * whole  # copies of the weights are most of it; logits of classes and within them would be 2


@pytest.mark.parametrize("spread", [0.3, 9.0])
def test_blocks_and_great_logits_change_nothing(monkeypatch, spread):
    rng = np.random.default_rng(8)
    w = weights(rng, 6, spread)
    ids, at = lm_scoring.padded([rng.integers(0, 36, n) for n in (40, 1, 0, 90)])
    assert lm_scoring.Joined.of(w).low() == (spread < 1)
    want, told = lm_scoring.log_probabilities(w, ids, at), list(lm_scoring.gradients(w, ids, at))
    assert np.isfinite(want).all()
    for low, block, together in ((0, 512, 32768), (lm_scoring.LOW, 7, 50)):
        for name, value in (("LOW", low), ("BLOCK", block), ("SORTED", together)):
            monkeypatch.setattr(lm_scoring, name, value)
        assert lm_scoring.log_probabilities(w, ids, at) == pytest.approx(want, rel=1e-4, abs=1e-4)
        for (key, a, _), (other, b, _) in zip(told, lm_scoring.gradients(w, ids, at)):
            assert key == other and np.allclose(a, b, atol=1e-5)


def test_training_goes_by_the_gradients(monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH", 50)
    rng = np.random.default_rng(9)
    w = weights(rng, 6, 0.1)
    ids, at = lm_scoring.padded([rng.integers(0, 36, n) for n in (70, 3, 60)])
    trainer = lm_scoring.Trainer(w)
    trainer.learn(ids, at)
    want, seen = {k: v.copy() for k, v in w.items()}, {k: np.full_like(v, 1e-3) for k, v in w.items()}
    for a in range(0, len(at), 50):
        for key, gradient, part in list(lm_scoring.gradients(want, ids, at[a : a + 50])):
            seen[key][part] += gradient**2
            want[key][part] -= lm_scoring.RATE * gradient / np.sqrt(seen[key][part])
    assert trainer.tokens == len(at)
    for key in want:
        assert np.allclose(trainer.w[key], want[key], atol=1e-4) and not np.allclose(want[key], w[key], atol=1e-3)
