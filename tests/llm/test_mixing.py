import math
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from granary.llm import mixing as M
from granary.llm.common import table


def test_period_keeps_windows_and_deviation():
    for shares in ({"a": 7, "b": 2, "c": 1}, {"a": 1}, {"h": 50, **{f"s{i}": 5 for i in range(10)}}, {"a": 333, "b": 1, "c": 666}):
        total, had = sum(shares.values()), Counter()
        rows = M.period_schedule(shares)
        for s, k, slot, release, due in rows:
            assert release <= slot < due
            had[s] += 1
            assert all(abs(had[x] * total - shares[x] * (slot + 1)) < total for x in shares)
        assert had == Counter(shares)


def test_mixture_keeps_all_rows_and_weights(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else ("mid" if i % 2 else "small")) for i in range(3000)]
    rows += [(None, "a", None), (5, None, None), (5, None, None), (5, "", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, mix_slot string")
    got = M.mix(df, {"big": 5, "mid": 3, "small": 2, "": 0.5}, block_rows=8, period=100).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.mix_slot, set()).add((r.source or "", r.mix_block))
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert all(len(x) == 1 for x in slots.values())
    sizes = Counter((r.source or "", r.mix_block) for r in got)
    for s in ("big", "mid", "small"):
        blocks = sorted(b for x, b in sizes if x == s)
        assert blocks == list(range(len(blocks))) and all(sizes[s, b] == 8 for b in blocks[:-1])
    assert len({(r.mix_slot, r.mix_offset) for r in got}) == len(got)
    shares = M.parts({"big": 5, "mid": 3, "small": 2, "": 0.5}, 100)
    owner, had = {t: next(iter(x))[0] for t, x in slots.items()}, Counter()
    for t in range(100):
        had[owner.get(t)] += 1
        assert all(abs(had[s] * 100 - shares[s] * (t + 1)) < 100 for s in ("big", "mid", "small"))
    assert M.mix(df.where("false")).count() == 0


def test_deviation_from_stated_weights_stays_below_one_block(spark):
    for weights in ({"big": 0.5, **{f"s{i:02}": 0.5 / 19 for i in range(19)}}, {"a": 1, "b": 1, "c": 1}, {"x": 2**0.5, "y": 3**0.5, "z": 0.01}):
        exact, had = M.parts(weights, 1), Counter()
        for s, _, slot, release, due in M.schedule(weights, {s: int(6000 * p) + 1 for s, p in exact.items()}):
            assert release <= slot < due
            had[s] += 1
            assert slot >= 5900 or all(abs(had[x] - exact[x] * (slot + 1)) < 1 for x in exact)
    weights = {"big": 19, **{f"s{i:02}": 1 for i in range(19)}}
    df = spark.range(4000).selectExpr(
        "id AS doc_id", "'t' AS text",
        "CASE WHEN id < 2000 THEN 'big' ELSE concat('s', lpad(CAST(id % 19 AS STRING), 2, '0')) END AS source"
    )
    got = M.mix(df, weights, block_rows=1).collect()
    assert len(got) == 4000 == len({r.mix_slot for r in got})
    for t in (1000, 2000, 3000):
        assert abs(sum(r.source == "big" and r.mix_slot < t for r in got) - t / 2) < 1


def test_sources_of_weight_zero_follow_and_a_short_source_ends():
    rows = list(M.schedule({"a": 1, "b": 3, "z": 0}, {"a": 5, "b": 2, "z": 3}))
    assert Counter(s for s, *_ in rows) == {"a": 5, "b": 2, "z": 3}
    assert all(release <= slot < due for _, _, slot, release, due in rows) and len({r[2] for r in rows}) == 10
    assert min(r[2] for r in rows if r[0] == "z") > max(r[2] for r in rows if r[0] != "z")


def plain_schedule(weights, blocks):
    """Slot by slot: of all released blocks the one whose deadline is first, by trying every source."""
    total = sum(weights.values())
    had, out, slot = dict.fromkeys(blocks, 0), {}, 0
    while any(had[s] < blocks[s] for s in blocks):
        free = []
        for s in blocks:
            k = had[s]
            if k < blocks[s] and Fraction(k) * total / weights[s] < slot + 1:
                free.append((math.ceil(Fraction(k + 1) * total / weights[s]), s))
        if free:
            due, s = min(free)
            out[s, had[s]] = (slot, math.floor(Fraction(had[s]) * total / weights[s]), due)
            had[s] += 1
        slot += 1
    return out


def test_rows_against_a_plain_schedule(spark):
    """Every column of the query's rows on the smallest documents, and on a corpus with a very long text and many sources."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "source")
    odd = spark.createDataFrame(
        [(i, f"t{i}" * (i % 4), f"s{i % 40}") for i in range(900)] + [(5000, "long " * 200_000, "s1"), (None, None, None)], docs.schema
    )
    for df in (docs, odd):
        rows = df.select(
            "doc_id", "text", F.coalesce("source", F.lit("")).alias("s"), F.xxhash64(F.lit(0), "doc_id", "text").alias("b"),
            F.xxhash64("text").alias("h")
        ).collect()
        n = 1 << max(0, min(M.MOST_BUCKETS, -(-len(rows) // M.BUCKET_ROWS)) - 1).bit_length()
        want, by = {}, {}
        for r in sorted(rows, key=lambda r: (r.s, r.b % n, r.doc_id is not None, r.doc_id or 0, r.h)):
            by.setdefault(r.s, []).append(r.doc_id)
        weights = {s: Fraction(math.sqrt(len(x))) for s, x in by.items()}
        plan = plain_schedule(weights, {s: -(-len(x) // M.BLOCK_ROWS) for s, x in by.items()})
        for s, ids in by.items():
            for i, d in enumerate(ids):
                want[d] = (plan[s, i // M.BLOCK_ROWS][0], i % M.BLOCK_ROWS, i // M.BLOCK_ROWS, *plan[s, i // M.BLOCK_ROWS][1:])
        got = {r.doc_id: tuple(r[c] for c in M.ADDED) for r in M.mix(df).select("doc_id", *M.ADDED).collect()}
        assert got == want


def test_more_than_20000_sources(spark):
    df = spark.range(21_000).selectExpr("id AS doc_id", "'t' AS text", "concat('s', id) AS source")
    got = M.mix(df).select("mix_slot").distinct().count()
    assert got == 21_000
