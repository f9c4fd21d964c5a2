"""The recurrent network: its gradients, its cache, and how well it tells languages apart."""

import random

import numpy as np

from trackloom.llm import language_id as lid

SYLLABLES = {"aa": ["ka", "to", "ri", "mu"], "bb": ["schl", "eng", "pf", "tz"], "cc": ["ción", "ñe", "lla", "ez"]}


def words(rng, lang, n):
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]


def test_gradients_are_those_of_the_loss():
    net = lid.Network(3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    runs, target, weight = [b"abc", b"z", b"hello"], np.eye(3), np.array([1.0, 0.5, 2.0])

    def loss():
        codes, filled = lid.packed(runs)
        prob, _ = net.labels(codes, filled)
        w = filled * weight[:, None]
        return -(np.log(prob) * target[:, None, :]).sum(2)[filled.astype(bool)] @ w[filled] / w.sum()

    g = net.gradients(runs, target, weight)
    rng = np.random.default_rng(2)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for k in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old, h = flat[k], 1e-3
            flat[k] = old + h
            up = loss()
            flat[k] = old - h
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * h) - g[name].reshape(-1)[k]) < 2e-3, name


def corpus(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(words(rng, lang, rng.randint(5, 60))), lang) for k, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_are_told_apart(spark, odd, none):
    docs = corpus(spark)
    model = lid.train(docs.where("doc_id < 200"))
    got = {r.doc_id: r for r in lid.predict(docs, model).collect()}
    held = [r for r in docs.collect() if r.doc_id >= 200]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    rest = {r.doc_id: r for r in lid.predict(odd, model).collect()}
    assert rest[2].lang_pred == rest[3].lang_pred == rest[4].lang_pred == "und" and rest[2].score == 0
    assert rest[5].lang_pred in SYLLABLES and lid.predict(none, model).collect() == []
    assert {r.lang_pred for r in lid.predict(odd, lid.train(none)).collect()} == {"und"}


def test_cached_sums_are_those_of_the_network(spark):
    docs = corpus(spark)
    model = lid.train(docs, sample_docs=20)
    rng = random.Random(9)
    texts = [" ".join(words(rng, "aa", 30)), None, "12 34", "katori " * 5, "x" * 130 + "²½"]
    one, many = lid.RunScores(model), lid.RunScores(model)
    many.pool(texts)
    assert np.allclose(one.pool(texts), many.pool(texts), atol=1e-3)
    codes, filled = lid.packed([b"katori"])
    prob, _ = model.network.labels(codes, filled)
    assert np.allclose(one.pool(["Katori"])[0], [*prob[0].sum(0), 6], atol=1e-4)
    assert one.pool(["x" * 130 + "²½"])[0, -1] == 130
