import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import collocations as c
from granary.llm import filters


def brute(rows, least=10, longest=3, top=2000, covered=50):
    f, n = {}, Counter()
    for text, lang in rows:
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    key = (lang or "und", tuple(words[i : i + size]))
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in cand.items():
        inside = [b for (g, longer), b in cand.items() if g == lang and len(longer) > len(words)
                  and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))]
        if any(100 * b >= covered * a for b in inside):
            continue
        cuts = [(1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def corpus(seed, docs=60, words=120):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ab", "é", "ü x", "zz", "a", "the", "THE", "of", "日本"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! ", "\r\n", " "]
    rows = [("".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randrange(words))), rng.choice(["en", "de", None, "und"])) for _ in range(docs)]
    return rows + [("x y z " * 40, "en"), ("new york city. " * 30 + "new york. " * 5, "de"), (None, "fr"), ("", None), ("p q " * 9, "fr"), ("...;\n", "en")]


def frame(spark, rows):
    data = [(i, t, g, 7) for i, (t, g) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n int")


@pytest.mark.parametrize("longest,shards,batch", [(3, 3, 1 << 20), (2, 1, 200), (4, 8, 500), (5, 5, 3000)])
def test_rows_equal_brute_force(spark, monkeypatch, longest, shards, batch):
    monkeypatch.setattr(c, "BATCH", batch)
    rows = corpus(longest)
    got = sorted(map(tuple, c.collocations(frame(spark, rows).repartition(3), longest=longest, shards=shards).collect()))
    assert got == brute(rows, longest=longest) and len(got) > 10


def test_without_filters_the_rows_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(filters, "FILTER_BYTES", 0)
    rows = corpus(9)
    assert sorted(map(tuple, c.collocations(frame(spark, rows), longest=4).collect())) == brute(rows, longest=4)


def test_top_ties_and_support(spark):
    """Equal scores go by count, then by the phrase's bytes; the limit counts per language; support below it is no candidate."""
    rows = [(f"{w}1 {w}2. " * n, g) for g in ("en", "de") for w, n in (("b", 10), ("a", 10), ("é", 10), ("z", 12), ("rare", 9))]
    got = sorted(map(tuple, c.collocations(frame(spark, rows), top=3).collect()))
    assert got == brute(rows, top=3) and [x[2] for x in got[:3]] == ["z1 z2", "a1 a2", "b1 b2"]


def test_the_first_step_misses_nothing(spark):
    """Every phrase of enough support is frequent in some shard, even when its rows are dealt unevenly."""
    rows = corpus(5)
    for shards in (1, 2, 4, 7):
        keys = c.frequent_somewhere(frame(spark, rows), shards=shards)
        have = {r["phrase"] for r in c.counts(frame(spark, rows), keys).where("size > 1 AND n >= 10").collect()}
        assert have >= {x[2] for x in brute(rows)}


def test_exact_beyond_64_bits(spark):
    big = 10**14
    counted = spark.createDataFrame([("en", 2, "a b", big), ("en", 1, "a", big + 1), ("en", 1, "b", 3 * big)], "lang string, size int, phrase string, n long")
    assert c.scored(counted).collect()[0]["score"] == 1000000 * big * big // ((big + 1) * 3 * big)


def test_empty_table(spark):
    assert c.collocations(frame(spark, [])).count() == 0


def test_more_than_eight_shards_are_refused(spark):
    with pytest.raises(ValueError):
        c.frequent_somewhere(frame(spark, []), shards=9)


def test_words_are_hashed_together(monkeypatch):
    """Short words take no call each; a hash depends on the word's bytes alone, at any place of any batch."""
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 80))) for _ in range(20_000)} | {b"a" * n for n in range(1, 200)})
    calls, digest = [], c.xxhash.xxh64_intdigest
    monkeypatch.setattr(c.xxhash, "xxh64_intdigest", lambda *a: calls.append(a) or digest(*a))
    texts = pa.array(["one two three one"] * 3)
    c.Phrases(texts, np.zeros(3, np.int64), np.zeros(1, np.uint64))
    assert not calls
    every = c.word_hashes(pa.array(words, pa.large_binary()))
    assert len(set(every.tolist())) == len(words) and len(calls) == sum(len(w) > c.SHORT for w in words)
    back = c.word_hashes(pa.array([b"x", *words[::-1]], pa.large_binary()).slice(1))
    assert (back[::-1] == every).all() and len(c.word_hashes(pa.array([], pa.large_binary()))) == 0


def test_long_words_in_phrases(spark):
    long = "w" * 70
    rows = [(f"{long}a {long}b c. " * 6, "en"), (f"{long}a {long}b d, abcdefgh abcdefghi " * 12, "en")]
    got = sorted(map(tuple, c.collocations(frame(spark, rows)).collect()))
    assert got == brute(rows) and len(got) > 1


def _shuffled(spark, action):
    """Bytes that the action's stages write to shuffles."""
    store, n = spark.sparkContext._jsc.sc().statusStore(), [0, 0]
    for i, run in enumerate((lambda: None, action)):
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        n[i] = sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))
    return n[1] - n[0]


def test_shuffles_stay_in_proportion_beyond_the_filters(spark, monkeypatch):
    """A corpus with more frequent phrases than a broadcast filter takes: nothing that is shuffled holds the text of phrases."""
    monkeypatch.setattr(filters, "FILTER_BYTES", 0)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(5000)]
    rows = [(" ".join(rng.choice(words) for _ in range(500)), "en") for _ in range(400)] + [("new york city " * 20, "en")]
    size = sum(len(t) for t, _ in rows)
    docs = frame(spark, rows)
    got = []
    assert _shuffled(spark, lambda: got.extend(map(tuple, c.collocations(docs).collect()))) < 1.5 * size
    assert sorted(got) == brute(rows)
