"""Canonical exact digests of documents, with DataFrame functions only.

A text's canonical form is its compatibility composition (NFKC), then both case mappings, then
every run of white space as one space, trimmed. Its fingerprint is two lanes of xxHash64 over
that form (128 bits, 32 hex digits). Buckets of equal fingerprints are compared byte by byte: in a
bucket that holds different canonical forms all but the least form get the suffix `-2`, `-3`, ...

Normalisation tables are made from the Unicode database by rule. Texts that hold only code
points which normalisation leaves alone skip them. Of the others those with marks or conjoining jamo are decomposed, each
run of marks is sorted by combining class, and then starters take up what follows them, as the Unicode standard has it; jamo by arithmetic.

Null texts are empty texts. Repeated rows of one doc_id are ordered by text and each gets its
row; null doc_ids sort last, and the last row is followed by the first even where no row has an id. One row
alone is its own next document; an empty table gives no rows. Extra columns are ignored; names starting with two underscores are reserved.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Anything but ASCII, composed Latin-1 letters, dashes and quotation marks.
_LATIN = r"[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0131\u2012-\u2015\u2018-\u201f]"


def _regex_class(points: list[int]) -> str:
    """A regex class of these ascending code points, neighbours as ranges."""
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


@functools.cache
def _unicode_tables() -> dict:
    """single/to: one code point to one; many: one to several; parts: canonical decompositions; pairs: compositions; classes: of marks;
    marks, joining: regex classes of what has a combining class, and of what a starter may take up; stable: a regex class."""
    single, many, parts, pairs, classes, joining, unstable = {}, {}, {}, {}, {}, set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)), set()
    for cp in range(0xA0, sys.maxunicode + 1):
        c = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3 or unicodedata.category(c) == "Cn":
            continue
        n = unicodedata.normalize("NFKC", c)
        if n != c:
            (single if len(n) == 1 and cp < 0x10000 and ord(n) < 0x10000 else many)[c] = n
            unstable.add(cp)
        if (d := unicodedata.normalize("NFD", c)) != c:
            parts[c] = d
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", c) == c:
            base, mark = (chr(int(x, 16)) for x in d.split())
            pairs[base + mark] = c
            joining.add(ord(mark))
        if k := unicodedata.combining(c):
            classes[c] = k
            joining.add(cp)
    unstable |= joining
    spans, start = [], 0
    for cp in [*sorted(x for x in unstable if x < 0x10000), 0x10000]:
        if cp - start >= 48 or start == 0:
            spans.append((start, cp - 1))
        start = cp + 1
    stable = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans if b >= a and not (a <= 0xD800 <= b)) + "À-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž«»¡¿§©®°±¶·“”‘’–—"
    return {
        "single": single, "many": many, "parts": parts, "pairs": pairs, "classes": classes, "stable": f"[^{stable}]",
        "marks": _regex_class(sorted(map(ord, classes))), "joining": _regex_class(sorted(joining)),
    }


def _map(name: str) -> Column:
    return F.from_json(F.lit(json.dumps(_unicode_tables()[name])), "map<string,string>")


def _found(table: Column, keys: list[str], c: Column) -> Column:
    """What a table has for a code point, or null. Maps are searched from end to end, so translate, which hashes, tells first whether there is anything."""
    return F.when(F.translate(c, "".join(keys), "") == "", F.try_element_at(table, c))


def _replaced(text: Column, name: str) -> Column:
    """text with each code point that a table has replaced by what it has for it."""
    table, keys = _map(name), list(_unicode_tables()[name])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(_found(table, keys, c), c)), "")


def _clusters(text: Column, following: str) -> Column:
    """text cut before each code point that isn't one of the following class."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:[^{following[1:]}|^){following}*"), F.lit(0))


def _code(c: Column) -> Column:
    """The number of one code point below 65,536."""
    return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _hangul(base: Column, c: Column) -> Column:
    """The syllable of a leading jamo and a vowel, or of such a syllable and a final; else null."""
    b, x = _code(base), _code(c)
    both = (F.octet_length(base) == 3) & c.rlike(r"[\u1161-\u1175\u11a8-\u11c2]")
    vowel = both & b.between(0x1100, 0x1112) & x.between(0x1161, 0x1175)
    final = both & b.between(0xAC00, 0xD7A3) & ((b - 0xAC00) % 28 == 0) & x.between(0x11A8, 0x11C2)
    return F.when(vowel, _char(0xAC00 + ((b - 0x1100) * 21 + x - 0x1161) * 28)).when(final, _char(b + x - 0x11A7))


def _composed(text: Column) -> Column:
    """NFC of a text whose code points each are in NFKC: only what follows a starter can change it."""
    t, pairs = _unicode_tables(), _map("pairs")
    marks, ranks = "".join(t["classes"]), "".join(chr(0xE000 + k) for k in t["classes"].values())
    seconds = sorted({p[1:] for p in t["pairs"]})

    def rank(c: Column) -> Column:
        """A code point's combining class as a text that sorts like it; that of a starter is empty."""
        to = F.translate(c, marks, ranks)
        return F.when(to == c, F.lit("")).otherwise(to)

    def in_order(cluster: Column) -> Column:
        rows = F.transform(F.split(cluster, ""), lambda c, i: F.struct(rank(c).alias("k"), i.alias("i"), c.alias("c")))
        return F.array_join(F.transform(F.array_sort(rows), lambda r: r["c"]), "")

    # done, then the starter that may still take something up, what follows it, and the class of the last of these
    none = F.lit("")
    state = lambda done, base, rest, last: F.struct(done.alias("done"), base.alias("base"), rest.alias("rest"), last.alias("last"))

    def take(acc: Column, c: Column) -> Column:
        k, base = rank(c), acc["base"]
        pair = F.when(F.translate(c, "".join(seconds), "") == "", F.try_element_at(pairs, F.concat(base, c)))
        joined = F.coalesce(pair, _hangul(base, c))
        free = (base != "") & ((acc["rest"] == "") | (acc["last"] < k))
        return F.when(free & joined.isNotNull(), state(acc["done"], joined, acc["rest"], acc["last"])).when(
            k == "", state(F.concat(acc["done"], base, acc["rest"]), c, none, none)
        ).otherwise(state(acc["done"], base, F.concat(acc["rest"], c), k))

    def whole(cluster: Column) -> Column:
        parts = F.transform(_clusters(_replaced(cluster, "parts"), t["marks"]), lambda x: F.when(F.char_length(x) > 1, in_order(x)).otherwise(x))
        chars = F.split(F.array_join(parts, ""), "")
        return F.aggregate(chars, state(none, none, none, none), take, lambda a: F.concat(a["done"], a["base"], a["rest"]))

    return F.array_join(F.transform(_clusters(text, t["joining"]), lambda x: F.when(F.char_length(x) > 1, whole(x)).otherwise(x)), "")


def normalised(text: Column) -> Column:
    """text in NFKC."""
    t = _unicode_tables()
    x = F.translate(text, "".join(t["single"]), "".join(t["single"].values()))
    # taking out the code points that several replace tells whether there are any
    has = F.octet_length(F.translate(x, "".join(t["many"]), "")) < F.octet_length(x)
    x = F.when(has, _replaced(x, "many")).otherwise(x)
    x = F.when(x.rlike(t["joining"]), _composed(x)).otherwise(x)
    # most texts are decided by the short class, whose code points are all composed and stable
    return F.when(text.rlike(_LATIN), F.when(text.rlike(t["stable"]), x).otherwise(text)).otherwise(text)


def canonical(text: Column) -> Column:
    """The canonical form; ASCII texts, which all but case and white space leave alone, take the short way."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    folded = F.replace(F.lower(F.upper(normalised(text))), F.lit("ß"), F.lit("ss"))
    # only runs and white space other than a single space change
    return F.trim(
        F.when(
            ascii_, F.regexp_replace(F.lower(text), r"[\t-\r]\s*| \s+", " ")
        ).otherwise(F.regexp_replace(folded, r"(?U)[\s&&[^ ]]\s*| \s+", " "))
    )


def digest(canon: Column) -> Column:
    """Two lanes of xxHash64: 32 hex digits."""
    lane = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(lane(1), lane(2))


def _bounds(docs: DataFrame, blocks: int) -> list[int]:
    """First doc_id of each of about `blocks` equal blocks: a list as long as asked, whatever the table's size."""
    got = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 100 * blocks)).first()
    return sorted({got[0], *(got[1] or [])}) if got[0] is not None else []


def with_next(docs: DataFrame, blocks: int, also: dict[str, Column] | None = None, marked: DataFrame | None = None) -> DataFrame:
    """Each row with __next: the text of the next document, ascending doc_id; after the last the first.

    also: columns that are computed once a row after the shuffle and looked up likewise, as __next_<name>.
    marked: distinct doc_ids, dealt out like the texts; __marked tells whether a row's doc_id is one of them.

    One shuffle by block; the first row of a block is also sent to the block before it. Without any
    doc_id all rows are one block, whose first row follows its last."""
    also = also or {}
    starts = _bounds(docs, blocks)
    step = max(1, int(len(starts) ** 0.5))
    lits = lambda x: F.array(*(F.lit(b) for b in x)).cast("array<bigint>")
    coarse = F.size(F.filter(lits(starts[::step]), lambda b: b <= F.col("doc_id"))) - 1
    within = F.slice(lits(starts), F.greatest(coarse, F.lit(0)) * step + 1, step)
    fine = F.size(F.filter(within, lambda b: b <= F.col("doc_id"))) - 1
    last = F.lit(max(0, len(starts) - 1))
    block = F.when(F.col("doc_id").isNull(), last).otherwise(F.greatest(F.lit(0), coarse * step + fine))

    def copy(block: Column, ghost: bool, wrap: bool, mark: bool = False) -> Column:
        return F.struct(block.cast("int").alias("block"), F.lit(ghost).alias("ghost"), F.lit(wrap).alias("wrap"), F.lit(mark).alias("mark"))

    b = docs.withColumn("__block", block)
    own = copy(F.col("__block"), False, False)
    first = F.col("doc_id").isNotNull() & F.array_contains(lits(starts), F.coalesce(F.col("doc_id"), F.lit(0)))
    copies = (
        F.when(~first, F.array(own))
        .when(F.col("doc_id") == (starts[0] if starts else None), F.array(own, copy(last, True, True)))
        .otherwise(F.array(own, copy(F.col("__block") - 1, True, False)))
    )
    b = b.select(*docs.columns, F.explode(copies).alias("__at"))
    if marked is not None:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields if f.name != "doc_id"]
        b = b.unionByName(marked.select("doc_id", *none, copy(block, False, False, True).alias("__at")))
    b = b.repartition("__at.block").withColumns(also)
    order = Window.partitionBy("__at.block").orderBy("__at.wrap", F.col("doc_id").asc_nulls_last(), F.desc("__at.mark"), "text")
    # at most one mark stands before the next document's text
    ahead = order.rowsBetween(1, 2)
    wrapped = lambda c: F.first(c, ignorenulls=True).over(order) if not starts else F.lit(None)
    ahead_of = lambda c: F.coalesce(F.first(c, ignorenulls=True).over(ahead), wrapped(c))
    looked = {"__next": ahead_of("text"), **{f"__next_{c}": ahead_of(c) for c in also}}
    mark = F.last(F.when(F.col("__at.mark"), F.struct("doc_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    looked["__marked"] = mark.isNotNull() & mark["doc_id"].eqNullSafe(F.col("doc_id")) & ~F.col("__at.wrap")
    return b.withColumns(looked).where(~F.col("__at.ghost") & ~F.col("__at.mark")).drop("__at")


def _same(fingerprint: str, text: str) -> Column:
    equal = F.when(F.col("fingerprint") == F.col(fingerprint), canonical(F.col("text")) == canonical(F.col(text)))
    return F.coalesce(equal, F.lit(False)).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once. Which fingerprints two rows share is known before, from a table of digests alone, so
    that pass also writes the canonical forms of just those rows, whose bytes are then compared."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    prints = settled(rows.select("doc_id", digest(canonical(F.col("text"))).alias("fingerprint")), "digests")
    # written, so that both sides of the join can be split where one fingerprint has very many rows
    shared = settled(prints.groupBy("fingerprint").agg(F.count("*").alias("__n")).where("__n > 1").select("fingerprint"), "shared-digests")
    marked = prints.join(shared, "fingerprint", "left_semi").select("doc_id").distinct()
    own = {"fingerprint": F.when(~F.col("__at.mark"), digest(canonical(F.col("text"))))}
    half = F.floor(F.length("text") / 2).cast("int")
    judged = (
        with_next(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), own, marked)
        .withColumn("__half", half).withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("__edited", F.concat(F.expr("left(text, cast(n_chars as int) - __half)"), F.expr("left(__next, __half)")))
        .withColumn("edited_fingerprint", digest(canonical(F.col("__edited"))))
        # equal digests are compared by their bytes, which are made again only then
        .select(
            "doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
            _same("edited_fingerprint", "__edited").alias("near_edited"), _same("__next_fingerprint", "__next").alias("near_next"),
            F.when(F.col("__marked"), canonical(F.col("text"))).alias("__form"),
        )
    )
    judged = settled(judged, "fingerprints")
    ranks = collisions(judged.where("__form IS NOT NULL").select("fingerprint", "__form"))
    if ranks is None:
        return judged.drop("__form")
    ranked = F.when(F.col("__rank") > 1, F.concat("fingerprint", F.lit("-"), F.col("__rank"))).otherwise(F.col("fingerprint"))
    return judged.join(
        ranks, ["fingerprint", "__form"], "left"
    ).withColumn("fingerprint", ranked).drop("__rank", "__form").select(*judged.drop("__form").columns)


def collisions(forms: DataFrame) -> DataFrame | None:
    """(fingerprint, __form, __rank) of fingerprints that different canonical forms share, or None if there are none."""
    mixed = forms.groupBy("fingerprint").agg(F.min("__form").alias("__lo"), F.max("__form").alias("__hi")).where("__lo <> __hi").select("fingerprint")
    mixed = settled(mixed, "fingerprint-collisions")
    if mixed.isEmpty():
        return None
    order = Window.partitionBy("fingerprint").orderBy("__form")
    return forms.join(mixed, "fingerprint", "left_semi").distinct().withColumn("__rank", F.dense_rank().over(order))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id (the smallest doc_id of the same canonical form)."""
    prints = fingerprints(docs).select("doc_id", "fingerprint")
    return prints.join(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id")), "fingerprint")
