import numpy as np

from granary.llm import decontaminate as M


def semi_global(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_distance_against_dynamic_programming():
    rng = np.random.RandomState(0)
    for _ in range(200):
        p, t = (bytes(rng.choice(list(b"abc"), rng.randint(1, n)).tolist()) for n in (80, 200))
        masks = {}
        for j, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << j
        assert M.least_distance(masks, len(p), t) == semi_global(p, t)


def test_documents_against_brute_force(spark):
    rng = np.random.RandomState(3)
    vocab = ["the", "and", "of", "thin", "erha", "ou", "stion", "re"]
    words = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, words(rng.randint(10, 30))) for i in range(8)] + [(50, None), (51, "Short"), (52, "a  bc"), (53, ""), (None, "null id " * 9)]
    docs = []
    for i in range(60):
        t = items[i % 8][1]
        m, n = len(t), rng.randint(0, 8)
        for _ in range(n):
            at = rng.randint(len(t))
            t = t[:at] + rng.choice(["", "q", "zz"]) + t[at + rng.randint(2) :]
        docs.append((i, words(40) + "\n " + t.replace(" ", "  ").upper() + " " + words(30)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, words(40000))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, leak_item string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = M.report(df, it).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for d, t in docs[:-1]:
        want = {}
        for i, x in items[:8]:
            p = M.plain(x)
            if len(p) < M.LEAST:
                if b" " + p + b" " in b" " + M.plain(t) + b" ":
                    want[i] = 0
            elif (e := semi_global(p, M.plain(t))) <= int(M.RATE * len(p)):
                want[i] = e
        assert by[d].leak_items == len(want), d
        if want:
            assert (by[d].leak_distance, by[d].leak_item) == min((e, i) for i, e in want.items())
    assert M.clean(df, it).columns == df.columns
    assert M.report(df.where("false"), it).count() == 0 and not any(r.contaminated for r in M.report(df, it.where("false")).collect())


def test_short_items_are_found_as_whole_words(spark):
    texts = ["this is short", "shorter", "SHORT\nand", "x a bc", "xa bc", "a b c", "", "a bc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, "Short"), (8, "a  bc"), (9, " "), (10, "short")], "item_id long, text string")
    got = {r.doc_id: (r.leak_items, r.leak_item) for r in M.report(df, items).collect()}
    assert got == {0: (2, 7), 1: (0, None), 2: (2, 7), 3: (1, 8), 4: (0, None), 5: (0, None), 6: (0, None), 7: (1, 8)}
