import hashlib

import numpy as np

from granary.llm import suffix_dedup as M


def brute(rows, width):
    docs = [(d, (t or "").encode()) for d, t in rows]
    count, out = {}, {}
    for _, b in docs:
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            count[k] = count.get(k, 0) + 1
    for d, b in docs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        out[d] = (len(b), int(gone[:-1].sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_arrays_against_sorting():
    rng = np.random.RandomState(0)
    for n in [1, 2, 3, 5, 8, 20, 60, 200]:
        for k in (1, 2, 3, 20):
            for _ in range(30):
                s = [*rng.randint(1, k + 1, n).tolist(), 0]
                if rng.rand() < 0.3:
                    s = [*(s[: max(1, n // 7)] * 9)[:n], 0]
                sa = M.suffix_array(s)
                assert sa == sorted(range(len(s)), key=lambda i: s[i:])
                best = M.common_with_neighbours(s, sa)
                if n <= 20:
                    same = lambda a, b: next((x for x, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
                    assert best == [max([same(s[i:], s[j:]) for j in range(len(s)) if j != i] or [0]) for i in range(len(s))]


def corpus(seed):
    rng = np.random.RandomState(seed)
    rand = lambda n: "".join(rng.choice(list("abcdefgh é\n"), n))
    shared = [rand(700) for _ in range(4)]
    rows = []
    for i in range(70):
        t = rand(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            s = list(shared[rng.randint(4)])
            a = rng.randint(0, 300)
            s = s[a : a + rng.randint(150, 700)]
            if rng.rand() < 0.4:
                s[rng.randint(len(s))] = "X"
            t += "".join(s) + rand(rng.randint(0, 200))
        rows.append((i * 2, t))
    rows += [(201, None), (203, ""), (205, "ab" * 900), (207, "z" * 1000), (209, rows[3][1]), (211, "q" * 200), (213, "short")]
    return rows


def test_documents_against_brute_force(spark, monkeypatch):
    rows = corpus(0)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bytes string")
    want = brute(rows, 200)
    got = M.report(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    monkeypatch.setattr(M, "MOST", 3)  # larger groups by cells
    monkeypatch.setattr(M, "CHUNK", 10)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in M.report(df).collect()} == want
    assert M.report(df.where("false")).count() == 0


def test_repeated_rows(spark):
    t = corpus(2)[7][1] * 2
    got = M.report(spark.createDataFrame([(1, t), (1, t), (2, "y" * 199)], "doc_id long, text string")).collect()
    assert [(r.n_bytes - r.n_removed) for r in got if r.doc_id == 1] == [0, 0] and len(got) == 3


def judged(df):
    return sorted([(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in M.report(df).collect()])


def test_rows_without_an_id_count_like_others(spark):
    shared = corpus(3)[9][1][:260].ljust(260, "k")
    rows = [(None, shared + "one"), (5, "two" + shared), (None, "short"), (7, shared[:230])]
    want = sorted(brute([(i, t) for i, (_, t) in enumerate(rows)], 200).values())
    assert judged(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE", 1 << 12)
    rng = np.random.RandomState(5)
    long = "".join(rng.choice(list("abcdefghijklmnop"), 600_000))
    rows = [(1, long), (2, long[5000:5300] + "!"), (3, long[400_000:460_000][::-1]), (4, "x" + long[598_000:])]
    assert judged(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute(rows, 200).values())


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


def test_texts_whose_rolling_hashes_collide(spark):
    """Thue-Morse strings and their complements have equal polynomial hashes modulo 2^64."""
    rows = [(1, thue_morse(2048)), (2, "-" + thue_morse(2048, 1)), (3, "c" + thue_morse(4096)[1000:1700])]
    assert judged(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute(rows, 200).values())


def test_cells_of_large_groups(spark, monkeypatch):
    """One passage in many texts, each with its own surroundings: groups far over MOST."""
    monkeypatch.setattr(M, "MOST", 2)
    rng = np.random.RandomState(8)
    rand = lambda n: "".join(rng.choice(list("abcd"), n))
    core = rand(330)
    rows = [(i, rand(60) + core[rng.randint(0, 60) : 330 - rng.randint(0, 60)] + rand(60)) for i in range(40)]
    rows += [(100 + i, core[:150] + "X" * (i % 3) + core[150:]) for i in range(12)]
    assert judged(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute(rows, 200).values())
