import random

import numpy as np

from ledgerweave.llm import toxicity as t


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"word{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([20, 100, 400]))]
        junk, toxic = r.random() < 0.2, r.random() < 0.25
        if junk:
            w = [x + "%%%" for x in w]
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["Moron", "grubulus" + r.choice("abcdef"), "moron,"]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, 1 - junk, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(1, 900)
    df = spark.createDataFrame(docs + [(None, None, "x"), (5000, "", "x"), docs[0]], "doc_id long, text string, p_toxic string").repartition(3)
    lab = spark.createDataFrame(labels[:600] + [(600, None, None)], "doc_id long, quality int, toxic int")
    out = t.toxicity(df, lab).collect()
    assert len(out) == 903
    by = {x.doc_id: x for x in out}
    held = [(by[i].is_toxic, bool(y)) for i, _, y in labels[601:]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([(by[i].p_low_quality > 0.5) == (q == 0) for i, q, _ in labels[601:]]) > 0.97
    assert not by[5000].is_toxic and not by[None].is_toxic
    again = {x.doc_id: x for x in t.toxicity(df.repartition(5), lab).collect()}
    assert all(abs(again[k].p_toxic - by[k].p_toxic) < 1e-9 for k in by)
    kept = t.keep_clean(df.select("doc_id", "text"), lab).collect()
    assert sorted(str(x.doc_id) for x in kept) == sorted(str(x.doc_id) for x in out if not x.is_toxic)
    assert t.toxicity(df.limit(0), lab.limit(0)).collect() == []


def test_later_models_use_earlier_probabilities():
    r = np.random.default_rng(0)
    n = 600
    y = (r.random(n) < 0.5).astype(float)
    m = t.fit(np.arange(n), r.integers(0, 50, n).astype(np.uint32), y, (0.8 * y + 0.1)[:, None])
    assert m.chain[0] > 1


def test_scores_against_a_plain_walk(spark):
    docs, labels = corpus(2, 400)
    docs += [(900, None, "x"), (901, "", "x"), (902, "moron, " * 40000, "x"), docs[3]]
    df = spark.createDataFrame(docs, "doc_id long, text string, p_toxic string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = t.train(df, lab, t.CATEGORIES)
    models = [(dict(zip(m.ids.tolist(), m.weights.tolist())), m.bias, m.chain.tolist()) for m in chain.models]
    assert models[1][2] and all(w for w, _, _ in models)

    def walk(text):
        found = set(t.features([text.encode()])[1].tolist()) if text else set()
        probabilities = []
        for weights, bias, earlier in models:
            s = min(30, max(-30, bias + sum(weights.get(f, 0.0) for f in found) + sum(a * p for a, p in zip(earlier, probabilities))))
            probabilities.append(1 / (1 + np.exp(-s)))
        return probabilities

    want = sorted((i, *walk(text)) for i, text, _ in docs)
    got = sorted((x.doc_id, x.p_low_quality, x.p_toxic) for x in t.toxicity(df, lab).collect())
    assert len(got) == len(want)
    assert all(a[0] == b[0] and np.allclose(a[1:], b[1:], atol=1e-5) for a, b in zip(got, want))
