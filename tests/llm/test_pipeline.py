from collections import defaultdict

import corpus_pipeline as P
import pyarrow as pa
from pyspark.sql import functions as F
from granary.llm import decontaminate, language_id
from granary.llm.common import SPACE, table

from .test_near_copies import brute_components, sets_of

D = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = table(spark, D, "documents").cache()
    rows = {r.doc_id: r.text for r in docs.collect()}
    crf = language_id.train(language_id.sample(docs))
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, D).cache()
        seen[name] = docs
    after = {n: {r.doc_id: r.text for r in df.collect()} for n, df in seen.items()}
    assert all(df.columns == table(spark, D, "documents").columns for n, df in seen.items() if n != "mixing")

    want = {}
    for d, t in rows.items():
        _, sure, n = crf.texts(pa.array([t]))
        if n[0] and language_id.has_letter(t) and sure[0] >= P.MIN_SURE:
            want[d] = t
    assert after["language_id"] == want and len(want) > 190

    holders = defaultdict(set)
    key = lambda line: line.encode().strip(SPACE).lower()
    for d, t in want.items():
        for line in t.split("\n"):
            holders[key(line)].add(d)
    gone = lambda k, d: len(k.decode()) >= 10 and len(holders[k]) > 1 and d != min(holders[k])
    want = {d: "\n".join(x for x in t.split("\n") if not gone(key(x), d)) for d, t in want.items()}
    assert after["line_dedup"] == want

    ids = sorted(want)
    label = brute_components(ids, sets_of([want[d] for d in ids]))
    want = {d: want[d] for d in ids if label[d] == d}
    assert after["near_dedup"] == want

    items = [(r.item_id, decontaminate.plain(r.text)) for r in table(spark, D, "benchmark").collect()]
    items = [(i, t) for i, t in items if len(t) >= decontaminate.LEAST]

    def leaks(text):
        for _, t in items:
            masks = {}
            for j, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << j
            if decontaminate.least_distance(masks, len(t), decontaminate.plain(text)) <= int(decontaminate.RATE * len(t)):
                return True
        return False

    want = {d: t for d, t in want.items() if len(t) > 12000 or not leaks(t)}
    got = {d: t for d, t in after["decontaminate"].items()}
    assert {d: t for d, t in got.items() if len(t) <= 12000} == {d: t for d, t in want.items() if len(t) <= 12000}
    assert after["mixing"] == got
    assert seen["mixing"].select("mix_slot", "mix_offset").distinct().count() == len(got)


def test_run_writes_each_stage(spark):
    assert P.run(spark, D).count() > 100


def test_empty_and_null_documents(spark):
    docs = table(spark, D, "documents")
    none = docs.where("false")
    for _, stage in P.STAGES:
        none = stage(spark, none, D).cache()
        assert none.count() == 0


def kept(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_odd_rows_in_every_stage(spark):
    """Nulls in any column, repeated rows, ties, missing ids, a very long text and columns with clashing names."""
    docs = table(spark, D, "documents")
    line = "a line of plain english text that is long enough"
    other = "the quick brown fox jumps over the lazy dog and runs away"
    long = " ".join(f"the word{i % 977} and" for i in range(120_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, f"{line}\n{line}", "en", None, 30), (3, f"{line}\n{line}", "en", None, 30),
        (None, other, "en", "s", None), (None, other, "en", "s", None),
        (4, "something else entirely stands in this row of words", None, "s", 9), (5, long, "en", "t", 7), (6, line.upper(), "en", "s", 1),
    ]
    odd = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, lang_pred string, keys int"
    )
    real = [f.name for f in docs.schema.fields]
    one = P.language_id(spark, odd.select(*real).unionByName(docs.where("doc_id > 20").withColumn("n_chars", F.col("n_chars").cast("int"))), D)
    assert kept(one.where("doc_id IS NULL OR doc_id < 20")) == sorted((str(r[0]), r[1]) for r in rows if r[1])
    two = P.line_dedup(spark, odd, D)
    assert two.columns == odd.columns
    got = kept(two)
    assert len(got) == len(rows) and got.count(("3", f"{line}\n{line}")) == 2 and ("6", "") in got and ("1", "") in got
    three = kept(P.near_dedup(spark, odd, D))
    assert [x for x in three if x[0] == "None"] == [("None", other)] and [x[0] for x in three].count("3") == 2 and ("5", long) in three
    assert ("1", None) in three and ("2", "") not in three
    four = P.decontaminate(spark, odd, D)
    assert kept(four) == kept(odd) and four.columns == odd.columns
    five = P.mix_sources(spark, odd.withColumn("mix_slot", F.lit("clash")), D)
    assert kept(five) == kept(odd) and five.select("mix_slot", "mix_offset").distinct().count() == len(rows)
