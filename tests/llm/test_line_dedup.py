import pytest
import hashlib
from collections import defaultdict

import numpy as np

from granary.llm import line_dedup as M
from granary.llm.common import SPACE


def brute(rows, least=10):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).lower()
    docs = [(d, (t or "").encode().split(b"\n")) for d, t in rows]
    for d, lines in docs:
        for line in lines:
            holders[key(line)].add(d)
    out = []
    for d, lines in docs:
        kept = [x for x in lines if len(key(x).decode()) < least or len(holders[key(x)]) < 2 or d == min(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out)


def corpus(seed=0):
    rng = np.random.RandomState(seed)
    pool = [f"shared line number {i}" for i in range(30)] + ["short", "ÉÀÜ éàü ñ", "ééééééééé", "", "  padded line here\t"]
    rows = []
    for i in range(50):
        lines = [pool[rng.randint(len(pool))] if rng.rand() < 0.6 else f"own {i} {rng.randint(1000)} text" for _ in range(rng.randint(1, 12))]
        rows.append((i * 3, "\n".join(x.upper() if rng.rand() < 0.2 and x.isascii() else x for x in lines)))
    rows += [
        (200, None), (201, ""), (202, "\n\n"), (203, "shared line number 1\n" * 4000), (9, rows[3][1]), (9, rows[3][1]),
        (204, "\r\x0b shared LINE number 2 \x0c")
    ]
    return rows


def result(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_documents_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lost_keys string")
    assert result(M.dedup_report(df)) == brute(rows)
    out = M.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"] and out.count() == len(rows)
    monkeypatch.setattr(M, "FILTER_BYTES", 0)  # filters that are too large for a broadcast
    monkeypatch.setattr(M, "SHARD_KEYS", 8)
    assert result(M.dedup_report(df)) == brute(rows)
    assert M.dedup_report(df.where("false")).count() == 0


def test_filters_hold_what_they_are_given():
    keys = np.random.RandomState(0).randint(0, 1 << 62, 50000).astype(np.uint64) * np.uint64(4)
    f = M.filled(keys[:40000])
    assert f.holds(keys[:40000]).all() and f.holds(keys[40000:]).mean() < 0.01
    f.delete(keys[:10000])
    assert f.holds(keys[10000:40000]).all() and f.holds(keys[:10000]).mean() < 0.01
    assert M.Cuckoo(blob=f.blob()).holds(keys[10000:40000]).all()


def test_documents_enter_and_leave(spark):
    rows = dict(corpus(1)[:40])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    index = M.LineIndex(spark)
    index.insert(df.where("doc_id < 60"))
    index.insert(df.where("doc_id >= 60"))
    assert result(index.dedup(df)) == brute(rows.items())
    gone = [0, 3, 30, 63]
    index.delete(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    left = {d: t for d, t in rows.items() if d not in gone}
    assert result(index.dedup(df.where(~df.doc_id.isin(gone)))) == brute(left.items())
    index.insert(df.where(df.doc_id.isin(gone)))
    assert result(index.dedup(df)) == brute(rows.items())


def test_random_inserts_and_deletes_against_brute_force(spark, monkeypatch):
    """Documents enter more than once, leave, and enter again; the filters grow by several doublings."""
    monkeypatch.setattr(M, "SHARD_KEYS", 16)
    rng = np.random.RandomState(7)
    rows = dict(corpus(2)[:50])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").cache()
    index, live, shards = M.LineIndex(spark), set(), []
    for turn in range(5):
        some = [int(d) for d in rng.choice(list(rows), 30, replace=False)]
        if turn in (1, 3):
            index.delete(spark.createDataFrame([(d,) for d in some[:12]], "doc_id long"))
            live -= set(some[:12])
        else:
            index.insert(df.where(df.doc_id.isin(some)))
            live |= set(some)
        shards.append(index.shards)
    assert result(index.dedup(df.where(df.doc_id.isin(live)))) == brute([(d, rows[d]) for d in live])
    assert {r.doc_id for r in index.postings().select("doc_id").distinct().collect()} <= live and shards[-1] > 4
    index.insert(df.where("doc_id = 3"))
    index.insert(df.where("doc_id = 3"))
    index.delete(spark.createDataFrame([(3,)], "doc_id long"))
    assert index.postings().where("doc_id = 3").count() == 0


def test_rows_without_an_id_keep_their_lines(spark):
    line = "a line that two documents hold"
    got = M.dedup_report(spark.createDataFrame([(None, line), (4, line), (5, line)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_dropped) for r in got) == [("4", 0), ("5", 1), ("None", 0)]


def test_another_session_opens_the_index(spark, monkeypatch):
    """Each step by a new object over the same folder: runs are merged, filters and counts go on, documents leave and come back."""
    monkeypatch.setattr(M, "FANOUT", 2)
    rows = dict(corpus(3)[:40])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    path, ids = M.LineIndex(spark).path, list(rows)
    opened = lambda: M.LineIndex(spark, path)
    for part in (ids[:10], ids[10:25], ids[25:]):
        opened().insert(df.where(df.doc_id.isin(part)))
    assert result(opened().dedup(df)) == brute(rows.items()) and len(opened().runs) < 3
    gone = ids[::4]
    opened().delete(spark.createDataFrame([(g,) for g in [*gone, None, 10**6]], "doc_id long"))
    left = {d: t for d, t in rows.items() if d not in gone}
    assert result(opened().dedup(df.where(~df.doc_id.isin(gone)))) == brute(left.items())
    assert opened().keys == opened().counts().count()
    opened().insert(df.where(df.doc_id.isin(gone)))
    assert result(opened().dedup(df)) == brute(rows.items())
    with pytest.raises(ValueError, match="at least 10"):
        M.LineIndex(spark, path, least=3)


def test_rows_without_an_id_do_not_enter_the_index(spark):
    line = "a line that two documents hold"
    df = spark.createDataFrame([(None, line), (5, line), (6, line)], "doc_id long, text string")
    index = M.LineIndex(spark)
    index.insert(df)
    got = sorted((str(r.doc_id), r.n_dropped) for r in index.dedup(df).collect())
    assert got == [("5", 0), ("6", 1), ("None", 0)] and index.postings().count() == 2
