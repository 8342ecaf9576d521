import math
import random

import numpy as np

from pagemill.llm import mil

SCHEMA = "doc_id long, text string, lang string, score string"


def documents(n=700):
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrd") for _ in range(r.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        good = [word() for _ in range(r.randint(10, 400))]
        y = int(r.random() < 0.7)
        if not y:
            at = r.randrange(len(good))
            kind = r.randrange(3)
            junk = [word().upper() + "!!" for _ in range(60)] if kind == 0 else [word()] * 60 if kind == 1 else [word() + "###" for _ in range(60)]
            good[at:at] = junk
        rows.append((i, " ".join(good), "x", "clash"))
        labels.append((i, y))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = documents()
    rows += [(10_000, None, None, None), (10_001, "", None, None), (None, "some words", None, None), rows[3], (10_002, "long " * 40_000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), labels[2]], "doc_id long, quality int")
    model = mil.train(docs, marks, sample=400)
    got = [(r["row"]["doc_id"], r["score"]) for r in mil.score(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    out = {r["doc_id"] for r in marks.where(mil.held_out()).collect()}
    truth = dict(labels)
    hits = [(s >= 0.5) == truth[d] for d, s in got if d in out and d in truth]
    assert len(hits) > 150 and np.mean(hits) > 0.93
    good, bad = ([s for d, s in got if d in out and truth.get(d) == y] for y in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.97
    assert "score" in mil.score(docs, model).select("row.*").columns


def test_gradient_learns_which_passage_matters():
    r = np.random.default_rng(1)
    bags, labels = [], []
    for i in range(300):
        x = r.normal(0, 1, (r.integers(3, 12), mil.WIDTH)).astype(np.float32)
        y = i % 2
        if not y:
            x[r.integers(len(x)), :4] += 6
        bags.append(x)
        labels.append(y)
    model = mil.fit(bags, np.array(labels, float), epochs=25)
    p = np.array([mil._forward(model.weights, np.clip((x - model.mean) / model.scale, -5, 5), np.array([0]))[0][0] for x in bags])
    assert np.mean((p >= 0.5) == np.array(labels)) > 0.95


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert mil.score(docs, mil.train(docs, none)).first()["score"] == 0.5
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert 0.5 <= mil.score(docs, mil.train(docs, one)).first()["score"] <= 1
    assert mil.score(docs.limit(0), mil.train(docs, none)).count() == 0


def test_training_keeps_every_passage_of_a_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mil, "fit", lambda bags, labels: seen.append([len(b) for b in bags]))
    keys = [r["doc_id"] for r in spark.range(20).withColumnRenamed("id", "doc_id").where(~mil.held_out()).collect()][:3]
    docs = spark.createDataFrame([(k, "word " * (96 * n)) for k, n in zip(keys, (100, 3, 70))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "doc_id long, quality int")
    mil.train(docs, labels)
    mil.train(docs, labels, sample=3, passages=40)
    assert seen[0] == [100, 3, 70] and sum(seen[1]) <= 120 and set(seen[1]) <= {100, 3, 70}


def small_model(r, width=5):
    return {"W": r.normal(0, 1, (width, 4)), "b": r.normal(0, 1, 4), "V": r.normal(0, 1, (4, 3)), "U": r.normal(0, 1, (4, 3)), "w": r.normal(0, 1, 3), "c": r.normal(0, 1, 4), "d": np.array(0.3)}


def plain_score(w, bag):
    """Gated attention passage by passage, without numpy's array operations."""
    hs, ats = [], []
    for x in bag:
        h = [math.tanh(sum(x[i] * w["W"][i][k] for i in range(len(x))) + w["b"][k]) for k in range(4)]
        t = [math.tanh(sum(h[i] * w["V"][i][k] for i in range(4))) for k in range(3)]
        g = [1 / (1 + math.exp(-sum(h[i] * w["U"][i][k] for i in range(4)))) for k in range(3)]
        hs.append(h)
        ats.append(math.exp(sum(w["w"][k] * t[k] * g[k] for k in range(3))))
    z = [sum(a * h[k] for a, h in zip(ats, hs)) / sum(ats) for k in range(4)]
    return 1 / (1 + math.exp(-(sum(w["c"][k] * z[k] for k in range(4)) + float(w["d"]))))


def test_forward_and_gradients_against_plain_arithmetic():
    r = np.random.default_rng(6)
    w, bags, y, weight = small_model(r), [r.normal(0, 1, (n, 5)) for n in (1, 3, 6)], np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.5, 0.7])
    x, first = np.concatenate(bags), np.array([0, 1, 4])
    assert np.allclose(mil._forward(w, x, first)[0], [plain_score(w, b) for b in bags])

    def loss(v):
        p = [plain_score(v, b) for b in bags]
        return -sum(k * (t * math.log(q) + (1 - t) * math.log(1 - q)) for k, t, q in zip(weight, y, p)) + 5e-5 * ((v["W"] ** 2).sum() + (v["c"] ** 2).sum())

    for name, grad in mil.gradients(w, x, first, y, weight).items():
        for at in np.ndindex(np.shape(grad)):
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - np.asarray(grad)[at]) < 1e-6, name


def test_copies_of_an_id_are_one_row_of_training(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mil, "fit", lambda bags, labels: seen.append([len(b) for b in bags]))
    key = spark.range(9).withColumnRenamed("id", "doc_id").where(~mil.held_out()).first()["doc_id"]
    docs = spark.createDataFrame([(key, "b " * 500), (key, "a " * 200), (key, "a " * 200), (key, None)] * 5, "doc_id long, text string").repartition(5)
    for _ in range(2):
        mil.train(docs, spark.createDataFrame([(key, 1)], "doc_id long, quality int"))
    assert seen == [[3], [3]]
