"""Toxicity and language model: held-out accuracy, gradients, odd rows."""

import random

import numpy as np
import pytest

from corvane.llm import lm, toxicity

BAD = {"en": ["grub", "slime"], "de": ["schlamm", "unrat"]}


@pytest.fixture(scope="module")
def corpus():
    random.seed(6)
    docs, labels = [], []
    for i in range(600):
        lang = random.choice(["en", "de"])
        words = ["".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(random.randint(5, 80))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(2):
                words.insert(random.randrange(len(words)), random.choice(BAD[lang]).upper() + ".")
        docs.append((i, " ".join(words), lang, "src", 1))
        if i % 10 != 9:
            labels.append((i, 1, toxic))
    return docs, labels, {i: int(i % 6 == 0) for i in range(600)}


def test_toxicity_on_held_out_rows(spark, corpus):
    docs, labels, truth = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score int")
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab, toxicity.fold() != 0)
    rows = toxicity.score(df, model).select("doc_id", "score", "rejected", (toxicity.fold() == 0).alias("held")).collect()
    held = [r for r in rows if r["held"]]
    assert len(held) > 60
    assert sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] == bool(truth[r["doc_id"]]) for r in held) >= 0.97 * len(held)
    assert set(model.thresholds) == {None, "en", "de"}
    again = toxicity.train(df, lab, toxicity.fold() != 0)
    assert toxicity.digest(again) == toxicity.digest(model)


def test_toxicity_odd_rows(spark, corpus):
    docs, labels, _ = corpus
    df = spark.createDataFrame(docs[:200], "doc_id long, text string, lang string, source string, n_chars int")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = spark.createDataFrame([(None, None, None), (1, "", "xx"), (2, "abc", "en"), (2, "abc", "en"), (3, "word " * 200_000 + "grub", "en")], "doc_id long, text string, lang string")
    rows = toxicity.score(odd, model).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert rows[2]["score"] == rows[3]["score"]
    assert toxicity.score(odd.limit(0), model).collect() == []
    nothing = toxicity.train(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [(r["score"], r["rejected"]) for r in toxicity.score(odd, nothing).collect()] == [(0.0, False)] * 5


def test_thresholds_use_all_labelled_rows(spark, corpus, monkeypatch):
    docs, labels, truth = corpus
    docs = [(i, t, "fr" if i % 12 in (0, 1) else lang, s, n) for i, t, lang, s, n in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 60)
    model = toxicity.train(df, lab)
    assert {"en", "de", "fr"} <= set(model.thresholds)  # twelve rows of the sample can't give these
    rows = toxicity.score(df.join(lab.select("doc_id"), "doc_id"), model).collect()
    sample = {r["doc_id"] for r in lab.orderBy(__import__("pyspark").sql.functions.xxhash64("doc_id")).limit(60).collect()}
    rest = [(r["score"], truth[r["doc_id"]]) for r in rows if r["lang"] == "fr" and r["doc_id"] not in sample]
    f1 = lambda limit: 2 * sum(y for s, y in rest if s >= limit) / (sum(s >= limit for s, _ in rest) + sum(y for _, y in rest))
    assert f1(model.thresholds["fr"]) >= max(f1(s) for s, _ in rest) - 0.05
    monkeypatch.setattr(toxicity.common, "BROADCAST_BYTES", 0)
    assert toxicity.train(df, lab).thresholds == pytest.approx(model.thresholds)


def test_long_texts_are_pooled_whole(spark, corpus):
    docs, labels, _ = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows, sizes = np.random.default_rng(0).integers(0, len(model.buckets), 300_000), np.array([100_000, 3, 199_997])
    whole, _ = model.pooled(rows, sizes)
    old, toxicity.BLOCK = toxicity.BLOCK, 777
    try:
        assert np.allclose(model.pooled(rows, sizes)[0], whole, atol=1e-5)
    finally:
        toxicity.BLOCK = old


def test_pooling_against_loops(corpus):
    """Convolution and maximum written out, one filter, text and place at a time."""
    rng = np.random.default_rng(2)
    model = toxicity.fit([rng.integers(0, 50, rng.integers(1, 30)) for _ in range(60)], rng.integers(0, 2, 60))
    texts = [rng.integers(0, len(model.buckets) + 1, n) for n in (1, 2, 3, 40)]
    got, _ = model.pooled(np.concatenate(texts), np.array(list(map(len, texts))))
    for i, rows in enumerate(texts):
        column = 0
        for width, w in zip(toxicity.WIDTHS, model.filters, strict=True):
            for k in range(toxicity.FILTERS):
                values = [sum(float(model.vectors[rows[t + j]] @ w[j, :, k]) for j in range(width) if t + j < len(rows)) for t in range(len(rows))]
                assert got[i, column] == pytest.approx(max(values) + model.biases[column], abs=1e-4)
                column += 1
    logit = [sum(max(0.0, x) * o for x, o in zip(row, model.out, strict=True)) + model.bias for row in got.tolist()]
    assert model.score(np.concatenate(texts), np.array(list(map(len, texts)))) == pytest.approx([1 / (1 + np.exp(-x)) for x in logit], abs=1e-5)


def test_contradicting_labels_are_settled(spark, corpus):
    docs, labels, _ = corpus
    df = spark.createDataFrame(docs[:300], "doc_id long, text string, lang string, source string, n_chars int")
    lab = spark.createDataFrame([*labels, *[(i, 1, 0) for i, _, _ in labels]], "doc_id long, quality int, toxic int")
    one = toxicity.digest(toxicity.train(df, lab))
    assert one == toxicity.digest(toxicity.train(df.repartition(7), lab.repartition(5)))
    assert one == toxicity.digest(toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))


def test_window_network_gradients():
    rng = np.random.default_rng(1)
    net = lm.WindowNetwork({k: v.astype(np.float64) for k, v in lm.WindowNetwork.start(rng.integers(1, 50, lm.VOCABULARY).astype(float)).p.items()})
    context, word = rng.integers(0, lm.VOCABULARY, (40, 2 * lm.SIDE)), rng.integers(0, lm.VOCABULARY, 40)
    context[:, 1] = 7
    grads, ids, pulls = net.gradients(context, word)
    assert ids.tolist() == sorted(set(context.ravel().tolist()))
    grads["emb"] = np.zeros_like(net.p["emb"])
    grads["emb"][ids] = pulls
    loss = lambda: -net.forward(context, word)[0].astype(float).mean()
    assert set(grads) == set(net.p)
    for name, g in grads.items():
        at = tuple(np.unravel_index(np.argmax(np.abs(g)), g.shape))
        old, e = net.p[name][at], 1e-3
        net.p[name][at] = old + e
        up = loss()
        net.p[name][at] = old - e
        assert abs((up - loss()) / (2 * e) - g[at]) < 2e-3, name
        net.p[name][at] = old


def test_probabilities_add_up():
    rng = np.random.default_rng(3)
    net = lm.WindowNetwork.start(rng.integers(1, 90, lm.VOCABULARY).astype(float))
    context = np.tile(np.arange(2 * lm.SIDE), (lm.VOCABULARY, 1))
    assert abs(np.exp(net.forward(context, np.arange(lm.VOCABULARY))[0].astype(float)).sum() - 1) < 1e-3


def test_log_probability_against_loops():
    """Every layer written out for one window at a time."""
    rng = np.random.default_rng(5)
    p = {k: rng.normal(0, 0.5, s) for k, s in lm.WindowNetwork.SHAPES.items()}
    context, word = rng.integers(0, lm.VOCABULARY, (6, 2 * lm.SIDE)), rng.integers(0, lm.VOCABULARY, 6)

    def choose(x, weights, biases, at):
        logits = [sum(a * b for a, b in zip(x, weights[:, j], strict=True)) + biases[j] for j in range(len(biases))]
        return logits[at] - np.log(sum(np.exp(v) for v in logits))

    for c, w, got in zip(context, word, lm.WindowNetwork(p).forward(context, word)[0], strict=True):
        h = [np.tanh(p["b"][d] + sum(p["emb"][c[j], d] * p["place"][j, d] for j in range(2 * lm.SIDE))) for d in range(lm.HIDDEN)]
        group, member = divmod(int(w), lm.MEMBERS)
        kin, own = divmod(group, lm.GROUPS)
        g = [x + y for x, y in zip(h, p["kin"][kin], strict=True)]
        f = [x + y for x, y in zip(g, p["sub"][group], strict=True)]
        want = choose(h, p["top"], p["tb"], kin) + choose(g, p["mid"], p["mb"][kin], own) + choose(f, p["low"], p["lb"][group], member)
        assert got == pytest.approx(want, abs=1e-9)


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(7)
    after = {w: rng.sample(range(300), 4) for w in range(300)}

    def text():
        w, out = rng.randrange(300), []
        for _ in range(60):
            out.append(f"w{w}")
            w = rng.choice(after[w]) if rng.random() < 0.8 else rng.randrange(300)
        return " ".join(out)

    rows = [(i, text()) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_scores_dont_depend_on_partitions(spark, spoken):
    docs = spoken.filter("doc_id < 1500")
    one = {r["doc_id"]: r["log_prob"] for r in lm.score_corpus(docs.repartition(1)).collect()}
    many = {r["doc_id"]: r["log_prob"] for r in lm.score_corpus(docs.repartition(13)).collect()}
    assert many == pytest.approx(one, rel=1e-4)


def test_context_is_learned(spark, spoken, monkeypatch):
    """On texts that were held out, the network beats the shares of words by far."""
    monkeypatch.setattr(lm, "BATCH", 512)
    vocab, network = lm.train(spoken.filter("doc_id % 10 <> 0"))
    held = spoken.filter("doc_id % 10 = 0")
    start = lm.WindowNetwork.start(vocab.counts)
    for k in ("emb", "kin", "sub"):
        start.p[k][:] = 0
    start.p["top"][:], start.p["mid"][:], start.p["low"][:] = 0, 0, 0
    mean = lambda net: np.mean([r["mean_log_prob"] for r in lm.score(held, vocab, net).collect()])
    assert mean(network) > mean(start) + 0.5


def test_lm_very_long_text_and_clashing_names(spark, spoken):
    vocab, network = lm.train(spoken.limit(200))
    docs = spark.createDataFrame([(1, "w1 w2 rare" * 300_000, "a", 5, 0.5), (2, "w1 w2", "b", 6, 0.5)], "doc_id long, text string, mark string, n_words int, mean_log_prob double")
    rows = {r["doc_id"]: r for r in lm.score(docs, vocab, network).collect()}
    assert (rows[1]["n_words"], rows[1]["mark"], rows[2]["n_words"]) == (600_001, "a", 2)


def test_windows_stay_inside_texts():
    context, word = lm.windows(np.array([1, 2, 3, 9], np.int32), np.array([3, 0, 1]))
    assert context.tolist() == [[lm.EDGE, lm.EDGE, 2, 3], [lm.EDGE, 1, 3, lm.EDGE], [1, 2, lm.EDGE, lm.EDGE], [lm.EDGE] * 4]
    assert word.tolist() == [1, 2, 3, 9]


def test_lm_prefers_what_it_has_seen(spark):
    rng = random.Random(1)
    texts = [" ".join(f"{a} follows {chr(ord(a) + 1)}" for a in rng.choices("abcdefgh", k=40)) for _ in range(4000)]
    mixed = [(1000, "a follows b c follows d e follows f"), (1001, "follows b a d c follows e f follows"), (1002, None), (1003, ""), (None, "a follows b")]
    docs = spark.createDataFrame([*enumerate(texts), *mixed], "doc_id long, text string").repartition(2).withColumn("log_prob", __import__("pyspark").sql.functions.lit("x"))
    rows = {r["doc_id"]: r for r in lm.score_corpus(docs).collect()}
    assert rows[1000]["mean_log_prob"] > rows[1001]["mean_log_prob"] + 0.1
    assert (rows[1002]["n_words"], rows[1002]["log_prob"], rows[1003]["mean_log_prob"]) == (0, 0.0, None)
    assert rows[None]["n_words"] == 3
    assert lm.score_corpus(docs.limit(0)).collect() == []


def test_every_word_has_its_own_probability(spark, monkeypatch):
    rng = random.Random(2)
    common = [f"c{i}" for i in range(lm.VOCABULARY - 2)]
    texts = [" ".join(common)] * 12 + [" ".join(rng.choices(common, k=20)) + f" once{i} five{i % 40}" for i in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (900, "five1 c1"), (901, "once7 c1"), (902, "once7 five1 once7")], "doc_id long, text string")
    vocab, network = lm.train(docs)
    counts = {bytes(r["word"]): r["n"] for r in vocab.counted.collect()}
    others = sum(n for w, n in counts.items() if w not in vocab.ids)
    assert others == vocab.counts[lm.OTHER] > 0
    assert len(counts) > lm.VOCABULARY

    def want(text):
        split = text.encode().split()
        at = np.array([vocab.ids.get(w, lm.OTHER) for w in split], np.int32)
        logs = network.forward(*lm.windows(at, np.array([len(at)])))[0].astype(float)
        return logs.sum() + sum(np.log(counts[w] / others) for w in split if w not in vocab.ids)

    rows = {r["doc_id"]: r for r in lm.score(docs, vocab, network).collect()}
    assert len(rows) == len(texts) + 3
    for i, text in [(12, texts[12]), (900, "five1 c1"), (901, "once7 c1"), (902, "once7 five1 once7")]:
        assert rows[i]["log_prob"] == pytest.approx(want(text), abs=1e-3)
    assert rows[900]["log_prob"] > rows[901]["log_prob"]  # both were OTHER, then c1
    monkeypatch.setattr(lm, "HEAD", 50)  # the rarest words are joined with their counts
    vocab, network = lm.train(docs)
    assert 0 < len(vocab.head) <= 50
    joined = {r["doc_id"]: r for r in lm.score(docs, vocab, network).collect()}
    assert all(joined[i]["log_prob"] == pytest.approx(r["log_prob"], abs=1e-3) for i, r in rows.items())
