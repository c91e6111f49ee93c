import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from granary.llm import toxicity as M
from granary.llm.common import held_out, table


def test_gradients_against_differences():
    rng = np.random.RandomState(0)
    net = M.Net(np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64), 1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.randn(7, M.DIM) * 0.5
    index = rng.randint(0, 7, (4, 6))
    mask = (np.arange(6) < np.array([[6], [3], [1], [5]])).astype(float)
    y, w = np.array([1.0, 0, 1, 0]), np.array([0.3, 0.2, 0.4, 0.1])
    f = lambda: net.gradients(x, index, mask, y, w)[0]
    import unittest.mock as mock

    with mock.patch.object(np, "float32", np.float64):
        _, g, dx = net.gradients(x, index, mask, y, w)
        for value, grad in [(x, dx), *((net.p[k], g[k]) for k in ("Uf", "Ub", "Wf", "cb", "A", "a", "v", "o", "k"))]:
            for _ in range(4):
                at = tuple(rng.randint(s) for s in value.shape)
                old = value[at]
                value[at] = old + 1e-5
                up = f()
                value[at] = old - 1e-5
                down = f()
                value[at] = old
                assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def area(y, score):
    """Area under the ROC curve."""
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    ones = sum(y)
    return (sum(r for r, t in zip(rank, y) if t) - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_held_out_labels_and_ablation(spark):
    """Against labels.toxic on rows that training never saw; without the learned recurrence the scores say little."""
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").where("toxic IS NOT NULL")
    net = M.train(*M.sample(docs, labels))
    held = docs.where(
        held_out("doc_id") & (F.length("text") < 4000)
    ).join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").limit(600)
    rows = M.score(held, net).collect()
    y, score = [r.toxic for r in rows], np.array([r.toxicity for r in rows])
    assert area(y, score) > 0.93, area(y, score)
    hit = score >= M.THRESHOLD
    assert np.mean([h for h, t in zip(hit, y) if t]) > 0.6 and np.mean([h for h, t in zip(hit, y) if not t]) < 0.08
    rng = np.random.RandomState(0)
    for k in ("Wf", "Wb", "Uf", "Ub"):
        net.p[k] = rng.permutation(net.p[k].ravel()).reshape(net.p[k].shape)
    broken = area(y, net.texts(pa.array([r.text for r in rows])))
    assert broken < area(y, score) - 0.1, broken


def plain_forward(net, text):
    """The score of a text, one window and one word at a time."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    words = M.Words([text])
    x = net.inputs(words)[words.inverse].astype(np.float64)
    h, best = M.HIDDEN, None
    p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in M.TABLES}
    for at in range(0, max(1, len(x) - M.WINDOW + M.STRIDE), M.STRIDE):
        window = x[at : at + M.WINDOW]
        if not len(window):
            continue
        states = np.zeros((len(window), 2 * h))
        for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                a, b = window[t] @ p["W" + d] + p["c" + d], s @ p["U" + d]
                z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
                s = s + z * (np.tanh(a[2 * h :] + r * b[2 * h :]) - s)
                states[t, :h] = s if d == "f" else states[t, :h]
                states[t, h:] = s if d == "b" else states[t, h:]
        e = np.tanh(states @ p["A"] + p["a"]) @ p["v"]
        w = np.exp(e - e.max())
        logit = (w / w.sum()) @ states @ p["o"] + p["k"][0]
        best = logit if best is None else max(best, logit)
    return sig(net.scale * (p["k"][0] if best is None else best) + net.shift)


def test_query_against_a_plain_forward_pass(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    net = M.train(*M.sample(docs, labels))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = M.toxicity(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_forward(net, texts[r.doc_id] or "")
        assert abs(want - r.score) < 1e-3 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_long_texts_in_slices(monkeypatch):
    rng = np.random.RandomState(1)
    net = M.Net(np.arange(3, dtype=np.uint64), np.arange(3, dtype=np.uint64))
    texts = [" ".join(f"w{i}" for i in rng.randint(0, 90, n)) for n in (3, 33, 700, 1000, 1001, 1023, 1024, 1025)]
    want = net.texts(pa.array(texts))
    monkeypatch.setattr(M, "SLICE", 64)
    assert np.allclose(net.texts(pa.array(texts)), want, atol=1e-6)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "!! .."), (4, "word " * 40000), (5, "same"), (5, "same"), (None, "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxicity string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = M.toxicity(df, none).collect()
    assert len(got) == len(rows) and all(r.score == 0 and r.predicted == 0 for r in got)
    some = spark.createDataFrame(
        [(i, 1, i % 2) for i in (2, 3, 4, 5, 6, 7, 8)] + [(5, None, 0), (9, None, None)], "doc_id long, quality int, toxic int"
    )
    got = M.toxicity(df, some).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (5, None)}) == 1
    assert M.toxicity(df.where("false"), some).count() == 0
