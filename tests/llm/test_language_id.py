import zlib
from itertools import product

import numpy as np
import pyarrow as pa

from granary.llm import language_id as M
from granary.llm.common import held_out, table
from pyspark.sql import functions as F


def test_posteriors_against_enumeration():
    rng = np.random.RandomState(0)
    crf = M.Crf(["a", "b", "c"], np.zeros(0, np.uint64))
    crf.moves = rng.randn(3, 3).astype(np.float32)
    scores = rng.randn(9, 3).astype(np.float32)
    first, length = np.array([0, 4, 8]), np.array([4, 4, 1])
    got, pairs = crf.posteriors(scores, first, length)
    want, want_pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for f, n in zip(first, length):
        paths = list(product(range(3), repeat=n))
        w = np.array([np.exp(sum(scores[f + i, k] for i, k in enumerate(p)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w):
            for i, k in enumerate(p):
                want[f + i, k] += x
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += x
    assert np.allclose(got, want, atol=1e-5) and np.allclose(pairs, want_pairs, atol=1e-4)


def test_held_out_accuracy_and_code_switching(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = M.identify(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.93 and len(got) > 250
    crf = M.train(M.sample(docs))
    by = {r.lang: r.text for r in docs.where("n_chars > 600 AND lang IN ('en', 'de')").where(held_out("doc_id")).orderBy("doc_id").collect()}
    words = M.Words([" ".join(by["en"].split()[5:45] + by["de"].split()[5:45])])
    post, _ = crf.posteriors(crf.emissions(crf.features(words))[words.inverse], *M.chains(words.row, 1, M.BLOCK))
    en, de = crf.labels.index("en"), crf.labels.index("de")
    assert (post[:35].argmax(1) == en).mean() > 0.9 and (post[-35:].argmax(1) == de).mean() > 0.9


def test_edges(spark):
    rows = [
        (1, None, "en"), (2, "", None), (3, "12 34 !!", "en"), (4, "a " * 60000, "en"), (None, "the cat", "en"), (5, "the cat", "en"),
        (5, "the cat", "en")
    ]
    more = [(i, "the cat sat", "en") for i in range(10, 30)]
    rows += more
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in M.identify(df).collect())
    assert got == sorted(
        [
            ("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("None", "en"), ("5", "en"), ("5", "en"),
            *((str(i), "en") for i, _, _ in more)
        ]
    )
    assert M.identify(df.where("false")).count() == 0
    assert all(0 <= r.score <= 1 for r in M.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect())


def one_chain(crf, text):
    """Forward-backward over all words of a text, one word at a time."""
    words = M.Words([text])
    scores = crf.emissions(crf.features(words))[words.inverse].astype(np.float64)
    e, m = np.exp(scores - scores.max(1, keepdims=True)), np.exp(crf.moves.astype(np.float64))
    a, b = [e[0] / e[0].sum()], [np.ones(len(crf.labels))]
    for x in e[1:]:
        a.append((a[-1] @ m) * x)
        a[-1] /= a[-1].sum()
    for x in e[:0:-1]:
        b.append(m @ (x * b[-1]))
        b[-1] /= b[-1].sum()
    post = np.array(a) * np.array(b[::-1])
    return (post / post.sum(1, keepdims=True))[words.letter]


def test_query_against_one_chain_a_text(spark):
    """The rows of the query, by a plain chain over each whole text with the same weights."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    crf = M.train(M.sample(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in M.identify(docs).collect():
        if r.lang_pred == "und":
            assert not M.has_letter(texts[r.doc_id])
            continue
        mean = one_chain(crf, texts[r.doc_id]).mean(0)
        assert abs(mean.max() - r.score) < 1e-3 and mean[crf.labels.index(r.lang_pred)] > mean.max() - 1e-3
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_long_texts_in_slices(monkeypatch):
    samples = [("the cat and the dog were here", "en"), ("der Hund und die Katze waren hier", "de")] * 20
    crf = M.train(samples)
    rng = np.random.RandomState(0)
    text = " ".join(w for _ in range(400) for w in samples[rng.randint(2)][0].split() * rng.randint(1, 9))
    want = one_chain(crf, text).mean(0)
    monkeypatch.setattr(M, "SLICE", 700)
    mean, _, n = crf.texts(pa.array(["short text", text, None, "the cat"]))
    assert np.allclose(mean[1], want, atol=1e-4) and n[1] == len(text.split()) and n[2] == 0 and n[3] == 2


def test_more_than_500_languages(spark, monkeypatch):
    monkeypatch.setattr(M, "ROUNDS", 1)
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, word(i // 3) * 2, f"l{i // 3}") for i in range(1560)]
    sample = M.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len({lang for _, lang in sample}) > 500
