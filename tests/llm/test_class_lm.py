import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import class_lm as m


def lower(text):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")


def tokens(text):
    return re.findall("[^ \t-\r]+", lower(text)) + [None]


def corpus(seed, docs=200):
    """Two tongues, each of subjects, verbs and objects, so that the class before says much about a word."""
    rng = random.Random(seed)
    parts = {g: [[f"{g}{k}{i}{'xyz'[i % 3]}" for i in range(30)] for k in "svo"] for g in "ab"}
    text = lambda: " ".join(rng.choice(parts[g][i % 3]).capitalize() if i % 7 == 0 else rng.choice(parts[g][i % 3]) for g in [rng.choice("ab")] for i in range(rng.randrange(1, 60)))
    rows = [(i, text()) for i in range(docs)]
    return rows + [(docs, None), (docs + 1, ""), (docs + 2, "only-once \n\x0b twice twice é 日本"), (None, "a b c"), (None, None), (3, "repeated row"), (3, "repeated row")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, score double")


def learnt(rows):
    return [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]


@pytest.mark.parametrize("core,head", [(1 << 14, 1 << 18), (20, 60), (0, 0)])
def test_rows_equal_a_plain_model(spark, monkeypatch, core, head):
    """Counts, the base score and the class model's score, word by word from the classes that training gives; with rare words joined."""
    monkeypatch.setattr(m, "CORE", core)
    monkeypatch.setattr(m, "HEAD", head)
    monkeypatch.setattr(m, "BATCH", 700)
    rows = corpus(1)
    train = learnt(rows)
    model = m.train(frame(spark, train), classes=8, rounds=2)
    n = Counter(t for _, text in train for t in tokens(text))
    total, types = sum(n.values()), len(n)

    def of(word):
        return 0 if word is None else int(model.of_unit[model.head.units(pa.array([word.encode()], pa.large_binary()))[0][0]])

    kinds, once = Counter(), Counter()
    for w, k in n.items():
        kinds[of(w)] += k
        once[of(w)] += k == 1
    pairs = Counter()
    for _, text in train:
        seq = [0, *map(of, tokens(text))]
        pairs.update(zip(seq, seq[1:]))
    before = Counter()
    for (a, _), k in pairs.items():
        before[a] += k
    new = set(model.of_unit[1 + model.head.core :].tolist())
    some = {c: kinds[c] + (c in new) for c in range(8)}
    z = {c: kinds[c] + (once[c] + 1) * (c in new) for c in range(8)}

    def logp(prev, word):
        c = of(word)
        step = (pairs[prev, c] + m.PRIOR * some[c] / sum(some.values())) / (before[prev] + m.PRIOR)
        return math.log10(step * (n[word] or once[c] + 1) / z[c])

    got = m.scores(frame(spark, rows), model).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = []
    for doc_id, text in rows:
        t = tokens(text)
        base = sum(math.log10((n[x] + 1) / (total + types + 1)) for x in t)
        want.append((doc_id, len(t), sum(x in n for x in t), total, base, sum(logp(of(a), b) for a, b in zip([None, *t], t))))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want])
    # all that can follow a class has probability one together
    every = [*n] + [f"unseen{c}" for c in ()]
    for prev in {of(w) for w in n}:
        known = sum(10 ** logp(prev, w) for w in every)
        unknown = sum((pairs[prev, c] + m.PRIOR * some[c] / sum(some.values())) / (before[prev] + m.PRIOR) * (once[c] + 1) / z[c] for c in new)
        assert math.isclose(known + unknown, 1, rel_tol=1e-9)


def test_exchange_gains_equal_the_likelihood(spark):
    """best_class against moving the unit and counting again."""
    rng, k, units = np.random.RandomState(3), 5, 30
    counts = rng.poisson(0.7, (units, units)) * rng.poisson(2, (units, units))
    of = np.append(0, 1 + np.arange(units - 1) % (k - 1))

    def square(of):
        out = np.zeros((k, k))
        np.add.at(out, (of[:, None], of[None, :]), counts)
        return out

    for unit in range(1, units):
        right = np.bincount(of, np.where(np.arange(units) == unit, 0, counts[unit]), k)
        left = np.bincount(of, np.where(np.arange(units) == unit, 0, counts[:, unit]), k)
        to, gain = m.best_class(square(of), int(of[unit]), right, left, float(counts[unit, unit]))
        plain = [m.likelihood(square(np.where(np.arange(units) == unit, c, of))) for c in range(1, k)]
        assert to == 1 + int(np.argmax(plain)) and math.isclose(gain, max(plain) - m.likelihood(square(of)), abs_tol=1e-6)


def test_classes_beat_the_base_on_rows_held_out(spark):
    rows = m.report(frame(spark, corpus(5, 400)), classes=8, rounds=10).where("held_out")
    assert rows.count() > 30 and m.perplexity(rows) < 0.5 * m.perplexity(rows, "base_score")


def test_a_frequent_word_that_training_lacks(spark):
    rows = [(i, "new words" if zlib.crc32(str(i).encode()) % 7 == 2 else "old words") for i in range(60)]
    got = {r["held_out"]: r for r in m.report(frame(spark, rows), 4, 1).collect()}
    assert (got[True]["n_known"], got[False]["n_known"]) == (2, 3) and got[True]["score"] < got[False]["score"]


def test_nothing_to_learn_from(spark):
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = m.report(frame(spark, [(i, "some words") for i in held]), 4, 1).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(3, 0, 0, 0.0, 0.0)}
    assert m.report(frame(spark, []), 4, 1).count() == 0


def test_bands_keep_order(spark):
    ns = [1, 2, 1023, 1024, 1025, 1100, 2047, 2048, 10**6, 10**9, 10**12]
    bands = [r["b"] for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", m._band().alias("b")).orderBy("n").collect()]
    assert bands == sorted(bands) and bands[3] >= 1024 and bands[-1] < 4096
