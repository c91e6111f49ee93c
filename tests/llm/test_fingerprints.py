import hashlib
import random
import unicodedata

from pyspark.sql import functions as F

from granary.llm import fingerprints as M


def canon(t):
    return " ".join(unicodedata.normalize("NFKC", t).upper().lower().split())


def test_canonical_form_follows_the_unicode_database(spark):
    texts = ["Café  x", "Café x", "ＡＢＣ ｶ　d", "ﬁne ½ ™", "ậ ộ", "ǖ ǖ", "Straße STRASSE", "́ lone", "x́y", "Ω Å", "plain\ttext\n", ""]
    got = [
        r.c for r in spark.createDataFrame(
            [(i, t) for i, t in enumerate(texts)], "i int, t string"
        ).orderBy("i").select(M.canonical(F.col("t")).alias("c")).collect()
    ]
    assert got == [canon(t) for t in texts]


def test_canonical_equivalents_are_one(spark):
    """Every pair of marks of different classes in both orders, jamo against syllables, and random runs of what may be taken up."""
    rng = random.Random(4)
    classes = {}
    for cp in range(0x300, 0x1E950):
        if k := unicodedata.combining(chr(cp)):
            classes.setdefault(k, []).append(chr(cp))
    few = [c for k in sorted(classes) for c in rng.sample(classes[k], min(2, len(classes[k])))]
    texts = ["a" + x + y for x in few for y in few]
    texts += ["가각갛", "\u1100\u1161\u1100\u1161\u11a8", "가\u11a8\u11a8 \u1112\u1175\u11c2", "\u1161\u11a8", "\u0301\u0316a", "\u09c7\u09be \u09c7\u0301\u09be"]
    joining = [c for c in map(chr, range(0x300, 0x3200)) if unicodedata.combining(c)] + ["\u09be", "\u0b57", "\u1161", "\u11a8", "\u3099"]
    starts = ["a", "é", "ậ", "ש", "\u0627", "か", "가", "\u1100", " ", "𝒳", "\u09c7", "ﬁ", "Å"]
    texts += ["".join(rng.choice(starts if rng.random() < 0.35 else joining) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).select("i", M.normalised(F.col("t")).alias("n")).orderBy("i").collect()]
    wrong = [t for t, n in zip(texts, got) if n != unicodedata.normalize("NFKC", t)]
    assert not wrong, [x.encode("unicode_escape") for x in wrong[:5]]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(n) == canon(t))))
    return sorted(out, key=str)


def test_edges_against_brute_force(spark):
    rows = [(5, "Hello World"), (1, None), (2, ""), (9, "hello  world"), (9, "hello  world"), (7, "é" * 5000), (12, "x"), (30, "tie"), (31, "TIE")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, fingerprint string")
    got = M.fingerprints(df).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=str) == brute(rows)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[5] == by[9] and by[30] == by[31] and by[1] == by[2] and by[5] != by[7]
    assert M.fingerprints(df.where("false")).count() == 0
    assert M.fingerprints(df.where("doc_id = 7")).first().near_next == 1.0


def test_buckets_with_different_bytes_are_split(spark):
    rows = spark.createDataFrame([("0", "a"), ("0", "a"), ("0", "b"), ("1", "c")], "fingerprint string, __form string")
    assert {tuple(r) for r in M.collisions(rows).select("fingerprint", "__form", "__rank").collect()} == {("0", "a", 1), ("0", "b", 2)}
    assert M.collisions(rows.where("__form <> 'b'")) is None


def test_null_ids_wrap_around(spark):
    rows = [(None, "b b"), (None, "A long text"), (None, None), (None, "b  B")]
    for some in (rows, [*rows, (4, "four"), (2, "two"), (2, "FOUR")], rows[:1]):
        df = spark.createDataFrame(some, "doc_id long, text string")
        got = M.fingerprints(df).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=str) == brute(some)


def test_very_long_texts(spark):
    rows = [(1, "Ab " * 700_000), (2, "ab  " * 700_000), (3, "é\u0301x" * 60_000), (4, "end")]
    got = M.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=str) == brute(rows)


def test_many_blocks_against_brute_force(spark):
    rows = [(i * 7 % 501, f"text {i % 40}" * (i % 9)) for i in range(500)] + [(3, "again"), (3, "again")]
    got = M.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=str) == brute(rows)
