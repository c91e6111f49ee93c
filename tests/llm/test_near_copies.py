import corpus_pipeline as P
import numpy as np

from granary.llm import near_copies as M
from granary.llm.common import table


def sets_of(texts, k=5):
    words = [(t or "").encode().lower().split() for t in texts]
    return [frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset() for w in words]


def brute_components(ids, sets):
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for d, b in zip(ids[:i], sets[:i], strict=True):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(ids[i]), root(d)))
                parent[y] = x
    return {d: root(d) for d in ids}


def edited(rng, words, edits):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"w{rng.randint(1 << 30)}"
    return words


def corpus():
    """Copies edited to about 0.7 to 0.97, a base with many copies which are less like each other, and odd texts."""
    rng = np.random.RandomState(3)
    texts = []
    for _ in range(60):
        base = [f"v{x}" for x in rng.randint(0, 5000, 200)]
        texts += [" ".join(base), *(" ".join(edited(rng, base, n)) for n in (1, 3, 4, 5, 7))]
    hub = [f"h{x}" for x in rng.randint(0, 5000, 60)]
    texts += [" ".join(hub), *(" ".join(edited(rng, hub, rng.randint(1, 3))) for _ in range(300))]
    texts += [None, "", " \n", "one", "One", "a b c", "A b  c", "a b c d e f g h i", "a b c d e f g h", texts[0].upper()]
    order = rng.permutation(len(texts))
    return [(int(i) * 3 + 1, texts[i]) for i in order]


def test_stage_against_brute_force_similarity(spark):
    rows = corpus()
    want = brute_components([d for d, _ in rows], sets_of([t for _, t in rows]))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], table(spark, "/root/testdata/sf0.001", "documents").schema)
    got = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    assert got == {d for d in want if want[d] == d}
    assert {r.doc_id: r.component_id for r in M.near_copies(docs).collect()} == want
    assert M.near_copies(docs.where("false")).count() == 0


def test_keys_meet_at_the_least_similarity():
    rng = np.random.RandomState(5)
    for n in (5, 45, 450):
        for _ in range(300):
            x = rng.randint(0, 1 << 62, n * 6 // 5, dtype=np.int64).astype(np.uint64) * np.uint64(3)
            cut = len(x) - 2 * (len(x) // 10) if n > 5 else 4
            shared, rest = x[:cut], x[cut:]
            a, b = np.unique(np.append(shared, rest[: len(rest) // 2])), np.unique(np.append(shared, rest[len(rest) // 2 :]))
            if M.similar(a, b):
                assert (M.band_keys(a) == M.band_keys(b)).any()


def test_blocks_count_as_pairs_do():
    rng = np.random.RandomState(6)
    sets = [np.unique(rng.randint(0, 60, rng.randint(0, 50)).astype(np.uint64)) for _ in range(70)]
    left, right = sets[:30], sets[20:]
    got = set(zip(*(x.tolist() for x in M.similar_pairs(left, right)), strict=True))
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if M.similar(a, b)}
    assert got == want and len(want) > 10


def test_great_ids_and_rows_without_one(spark):
    """A row without a doc_id never stays beside one with it, however great that is."""
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(top, a), (None, a), (None, b), (None, b)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text[:2]) for r in M.without_copies(docs).collect()) == [(0, "b0"), (top, "a0")]


def test_simhash_names_candidates_and_shingles_decide(spark, monkeypatch):
    """Without any MinHash key, copies within four bits are still linked where their shingles are similar, and only there."""
    rng = np.random.RandomState(8)
    sim = lambda t: M.majority(M.shingles(t.encode()))
    texts = []
    for words, edits, alike in ((600, 1, True), (600, 2, True), (40, 2, False)):
        for _ in range(4):
            while True:
                base = [f"v{x}" for x in rng.randint(0, 5000, words)]
                copy = edited(rng, base, edits)
                a, b = " ".join(base), " ".join(copy)
                if M.similar(M.shingles(a.encode()), M.shingles(b.encode())) == alike and (sim(a) ^ sim(b)).bit_count() <= 4:
                    break
            texts += [a, b]
    ids = list(range(len(texts)))
    want = brute_components(ids, sets_of(texts))
    assert len(set(want.values())) == 8 + 8
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    monkeypatch.setattr(M, "band_keys", lambda hashes: np.zeros(0, np.int64))
    assert {r.doc_id: r.component_id for r in M.near_copies(docs).collect()} == want
