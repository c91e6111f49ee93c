import numpy as np
import xxhash

from granary.llm import simhash as M


def brute_fp(t, k=4):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for a in order:
        for b in order:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)), key=lambda i: ids[i])
                parent[y] = x
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


def test_golay_code_is_perfect_and_keys_meet():
    rng = np.random.RandomState(0)
    x = rng.randint(0, 1 << 62, 500).astype(np.uint64) * np.uint64(3)
    for flips in range(5):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        (ra, ka), (rb, kb) = M.keys_of(x), M.keys_of(y)
        (la, wa), (lb, wb) = M.long_keys_of(x[ra], ka), M.long_keys_of(y[rb], kb)
        for i in range(len(x)):
            assert set(ka[ra == i]) & set(kb[rb == i])
            assert set(wa[ra[la] == i]) & set(wb[rb[lb] == i])


def test_documents_against_brute_force(spark):
    rng = np.random.RandomState(1)
    base = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta"], 60)) for _ in range(40)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(2):
            w = t.split()
            w[rng.randint(60)] = "other"
            texts.append(" ".join(w))
    texts += [None, "", " \n", "one", "One", "a b c", base[0].upper(), "long " * 30000]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, label string")
    got = {r.doc_id: r for r in M.near_duplicates(df).collect()}
    fps = [brute_fp(t) for _, t in rows]
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for (d, _), f in zip(rows, fps)}
    assert {d: r.component_id for d, r in got.items()} == brute_components([d for d, _ in rows], fps)
    assert M.near_duplicates(df.where("false")).count() == 0


def test_ids_of_any_size_nulls_and_repeats(spark):
    """No number is reserved: the greatest and negative ids are ids; rows without one join a component but never name it."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    top = (1 << 62) + 5
    rows = [(top, a), (top + 1, a), ((1 << 63) - 1, a), (None, a), (-7, b), (None, b), (9, b), (9, b), (None, c), (None, c), (None, None), (3, "")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    count = {}
    for r in got:
        key = (r.doc_id, r.component_id)
        count[key] = count.get(key, 0) + 1
    assert count == {(top, top): 1, (top + 1, top): 1, ((1 << 63) - 1, top): 1, (None, top): 1, (-7, -7): 1, (None, -7): 1, (9, -7): 2, (None, None): 2,
                     (None, 3): 1, (3, 3): 1}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 8)
    rng = np.random.RandomState(2)
    fps = set()
    for c in range(3):
        centre = int(rng.randint(0, 1 << 62))
        for _ in range(120):
            f = centre
            for b in rng.choice(64, rng.randint(2, 6), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, label long")
    got = {r.label0: r.label for r in M._linked(nodes, 4).join(nodes.withColumnRenamed("label", "label0"), "fp").collect()}
    assert got == brute_components(list(range(len(fps))), fps)
