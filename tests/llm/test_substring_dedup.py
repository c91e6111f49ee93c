import hashlib

import numpy as np
import pytest

from granary.llm import filters
from granary.llm import substring_dedup as M


def brute(rows, width):
    docs = {d: (t or "").encode().split() for d, t in rows}
    seen, out = set(), {}
    for d in sorted(docs):
        w, gone = docs[d], set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone |= set(range(i, i + width))
            seen.add(k)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed):
    rng = np.random.RandomState(seed)
    rand = lambda n: " ".join(f"w{i}" for i in rng.randint(0, 500, n))
    shared = [rand(60) for _ in range(4)]
    rows = []
    for i in range(60):
        t = rand(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            s = shared[rng.randint(4)].split()
            a = rng.randint(0, 30)
            t += "\n " + " ".join(s[a : a + rng.randint(5, 60)]) + "\t" + rand(rng.randint(0, 30))
        rows.append((i * 2, t))
    rows += [(201, None), (203, ""), (205, "a b " * 3000), (207, "same " * 100), (209, rows[3][1]), (211, "x" * 10000)]
    return rows


def test_documents_against_brute_force(spark):
    rows = corpus(0) + [(300, corpus(0)[5][1]), (300, corpus(0)[5][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = M.report(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows, 20)
    assert M.report(df.where("false")).count() == 0


def test_batches_give_the_same_as_one(spark, monkeypatch):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index, out = M.SubstringIndex(spark), {}
    parts = [df.where("doc_id < 40"), df.where("doc_id >= 40 AND doc_id < 100"), df.where("doc_id >= 100")]
    for i, part in enumerate(parts):
        if i == 2:
            index.compact()
            monkeypatch.setattr(filters, "FILTER_BYTES", -1)  # and without filters
        past = None if i == 0 else df.where(f"doc_id < {[40, 100][i - 1]}")
        for r in index.dedup(part, past).collect():
            out[r.doc_id] = (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
    assert out == brute(rows, 20)


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_history_is_needed(spark):
    df = spark.createDataFrame(corpus(3), "doc_id long, text string")
    index = M.SubstringIndex(spark)
    index.add(df.where("doc_id < 40"))
    with pytest.raises(ValueError, match="earlier batches"):
        index.add(df.where("doc_id >= 40"))


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


def test_words_whose_rolling_hashes_collide(spark):
    """Two windows that differ in their last words, which polynomials modulo 2^64 don't tell apart."""
    same = " ".join(f"s{i}" for i in range(19))
    rows = [(1, f"{same} {thue_morse(2048, 0)} x y z"), (2, f"{same} {thue_morse(2048, 1)} p q r"), (3, f"k {same} {thue_morse(2048, 1)}")]
    assert rows_of(M.report(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 20)


def test_large_groups_and_slices(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST", 2)
    monkeypatch.setattr(M, "SLICE", 64)
    rng = np.random.RandomState(4)
    rand = lambda n: " ".join(f"w{i}" for i in rng.randint(0, 300, n))
    core = rand(40).split()
    rows = [(i, f"{rand(9)} {' '.join(core[rng.randint(0, 9) : 40 - rng.randint(0, 9)])} {rand(9)}") for i in range(40)]
    long = rand(5000)
    rows += [(50, long), (51, " ".join(long.split()[4000:]) + " end"), (52, " ".join(long.split()[1000:1100]))]
    assert rows_of(M.report(spark.createDataFrame(rows, "doc_id long, text string"), batches=3)) == brute(rows, 20)


def test_rows_without_an_id_come_last(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, "start " + text), (None, text), (8, text), (None, None)]
    got = M.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [
        (0, 0, 0), (0, 30, 30), (0, 30, 30), (0, 31, 30), (8, 30, 0)
    ]


def test_another_session_opens_the_index(spark):
    """Runs and segments are found again, without the catalog's entries, and hits in history are removed."""
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ids = sorted(d for d, _ in docs)
    parts = [df.where(df.doc_id.isin(p)) for p in (ids[: len(ids) // 3], ids[len(ids) // 3 : len(ids) // 2], ids[len(ids) // 2 :])]
    path, out, past = M.SubstringIndex(spark).path, {}, None
    for part in parts:
        index = M.SubstringIndex(spark, path)
        for name in index.runs:
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # as in a new session: only the files are left
        for r in index.dedup(part, past).collect():
            out[r.doc_id] = (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
        past = part if past is None else past.unionByName(part)
    assert out == brute(docs, 20) and any(x[1] for x in out.values())
    with pytest.raises(ValueError, match="earlier batches"):
        M.SubstringIndex(spark, path).add(parts[2])
    with pytest.raises(ValueError, match="windows of 20 words"):
        M.SubstringIndex(spark, path, width=5)
    M.SubstringIndex(spark, path).drop()


def test_batches_come_in_order(spark):
    """A batch that stands before an earlier one is refused and leaves nothing behind."""
    text = " ".join(f"w{i}" for i in range(40))
    frame = lambda d: spark.createDataFrame([(d, text)], "doc_id long, text string")
    index = M.SubstringIndex(spark)
    index.add(frame(1))
    tables = len(spark.catalog.listTables())
    with pytest.raises(ValueError, match="document 0 stands before document 1"):
        index.add(frame(0), frame(1))
    assert len(spark.catalog.listTables()) == tables
    again = M.SubstringIndex(spark, index.path)
    assert (len(again.runs), len(again.segments), again.last) == (1, 1, 1)
    assert again.dedup(frame(2), frame(1)).first().n_removed == 40
    again.drop()
