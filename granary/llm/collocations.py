"""Phrases whose words keep company: SON mining of frequent phrases, exact counts, association scores.

The corpus is cut once into bins of about BATCH bytes of text, whose words become numbers; the bins are dealt to shards. Partitioned mining
then takes two steps. First each shard is mined completely at the support lowered in proportion, ceil(least / shards): a phrase found `least`
times or more reaches that in some shard. This goes level by level: words, then pairs, then longer phrases only where both phrases one word shorter
are frequent in some shard. Second, the phrases that any shard found frequent are counted over the whole corpus.

A frequent word, and a frequent phrase of each size, has a number of its own; a phrase is the number of its words but the last and that of the last.
So all counts are exact, and no text but that of words is shuffled. On each level a bin sends its distinct phrases, sorted, to the parts that
count them, and gets their numbers back in the same order: no task ever holds the frequent phrases of the whole corpus, and what is sent grows with the text.

A text is lower-cased (A-Z only), split into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words `[^\\x20\\x09]+`; phrases don't cross pieces.
Null texts are empty, a null language is `und`. Repeated rows count each. Counts up to 10^15 are exact; beyond it the decimal arithmetic raises
an error and never rounds. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, flat, mixed, pieces, released, scratch, settled, shipped
from .tokens import as_text, coded_words

LEAST, LONGEST, TOP, COVERED, UND = 10, 3, 2000, 50, "und"
#: Logical shards of the first step, 8 at most.
SHARDS = 3
#: Text bytes of one bin, and the salts of the first ranking.
BATCH, SALTS = 2 << 20, 64
#: A level's phrases are counted in so many parts, and one more for each so many bytes of text.
PARTS, PART_BYTES = 16, 16 << 20
SCALE = 1_000_000

#: Bytes of words, and those that end a piece.
_DARK, _ENDS = np.ones(256, bool), np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_DARK[list(b" \t.,;:!?\n\x0b\x0c\r")] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longest word, in bytes, that is hashed together with the others; masks of the first 0 to 8 bytes.
SHORT, _FIRST = 64, np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def hashes(values: pa.Array) -> np.ndarray:
    """XXH64 (seed 42) of each value."""
    return np.fromiter((xxhash.xxh64_intdigest(v, 42) for v in values.to_pylist()), np.uint64, len(values))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word by its bytes alone: of words up to SHORT bytes eight bytes at a time, all words at once; XXH64 of longer ones."""
    buf, offs = flat(words)
    size, start = np.diff(offs), offs[:-1]
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each byte on
    out, live = size.astype(np.uint64), np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        part = eight[start[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]
        out[live] = mixed(out[live] * _STEP + part)
    long = np.flatnonzero(size > SHORT)
    out[long] = hashes(words.take(pa.array(long)))
    return out


class Phrases:
    """The words of a batch of texts: each one's piece and number. A number stands for a word of a group (exactly, not by its hash) and has
    its hash, how often, and the first place."""

    def __init__(self, texts: pa.Array, group: np.ndarray, seeds: np.ndarray):
        """group: the number of each text's group, whose words are counted apart; seeds: a hash of each group."""
        self.words, self.word, row, start = coded_words(texts, _DARK)
        self.piece = np.cumsum(_ENDS[flat(texts)[0]], dtype=np.int32)[start] + row
        self.group = group[row]
        self.number, kinds = pd.factorize(self.group * max(1, len(self.words)) + self.word)
        self.n = np.bincount(self.number, minlength=len(kinds))
        self.first = np.zeros(len(kinds), np.int64)
        self.first[self.number[::-1]] = np.arange(len(self.word))[::-1]
        self.hash = mixed(word_hashes(self.words)[self.word[self.first]] * _STEP + seeds[self.group[self.first]])


_ZSTD = pa.Codec("zstd", 1)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, behind how many bytes they take: all first bytes, then all second ones, as small or sorted numbers get smaller so."""
    planes = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def _unpacked(data: bytes, kind: type = np.int32) -> np.ndarray:
    planes = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _grouped(batch: pa.RecordBatch, *columns: str) -> tuple[pd.DataFrame, np.ndarray]:
    """The distinct values of some columns and each row's number among them."""
    frame = batch.select(columns).to_pandas()
    number = frame.groupby(list(columns), sort=False, dropna=False).ngroup().to_numpy()
    first = pd.Series(number).drop_duplicates().index.to_numpy()
    return frame.iloc[first].reset_index(drop=True), number.astype(np.int64)


def _cut(order: np.ndarray, *labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of equal labels in this order."""
    changes = np.zeros(max(0, len(order) - 1), bool)
    for x in labels:
        changes |= np.diff(x[order].astype(np.int64)) != 0
    start = np.concatenate([np.zeros(min(1, len(order)), np.int64), np.flatnonzero(changes) + 1])
    return start, np.append(start[1:], len(order))[: len(start)]


_BIN = "bin long, shard int, part int, at int, lang string, keys binary, n binary, levels array<binary>"
_ANSWER = "bin long, at int, numbers binary, lang string, word string, number long, before long, last long, n long"


def _table(schema: str, columns: dict) -> pa.Table:
    """A table of some of the schema's columns; the others are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    rows = len(next(iter(columns.values())))
    made = {name: (columns[name], kinds[kind]) if name in columns else (None, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))}
    return pa.table({name: pa.nulls(rows, kind) if x is None else (x if isinstance(x, pa.Array) else pa.array(x, kind)).cast(kind) for name, (x, kind) in made.items()})


def _state(bin_: int, shard: int, levels: list[np.ndarray]) -> pa.Table:
    return _table(_BIN, {"bin": [bin_], "shard": [shard], "levels": [[_packed(x) for x in levels]]})


def _binned(docs: DataFrame, shards: int, parts: int, text: str, lang: str) -> DataFrame:
    """For each bin one row of its words in order, as places in its list of words, -1 between pieces; and this list, sorted by part and
    language, in a row for each of these (keys: words, joined by spaces; n: how often each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(pieces(batches, "text", BATCH)):
            groups, number = _grouped(batch, "lang")
            langs = pa.array(groups["lang"], pa.string())
            found = Phrases(batch["text"], number, hashes(langs))
            if not len(found.word):
                continue
            part, group = (found.hash % np.uint64(parts)).astype(np.int32), found.group[found.first]
            order = np.lexsort((group, part))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            start, end = _cut(order, part, group)
            words = found.words.take(pa.array(found.word[found.first[order]]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)), pa.int32()), words.cast(pa.binary()))
            n = found.n[order].astype(np.int32)
            own = {"bin": np.full(len(start), task << 32 | i), "shard": np.full(len(start), (task + i) % shards)}
            rows = {"part": part[order[start]], "at": np.arange(len(start)), "lang": langs.take(pa.array(group[order[start]])), "keys": pc.binary_join(lists, b" ")}
            between = np.flatnonzero(np.diff(found.piece)) + 1
            yield from _table(_BIN, own | rows | {"n": [_packed(n[a:b]) for a, b in zip(start, end, strict=True)]}).to_batches()
            yield from _state(task << 32 | i, (task + i) % shards, [np.insert(place[found.number], between, np.int32(-1))]).to_batches()

    texts = docs.select(F.coalesce(lang, F.lit(UND)).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    return shipped(texts).mapInArrow(run, _BIN)


def _numbered(key: np.ndarray, kinds: int, n: np.ndarray, shard: np.ndarray, part: int, parts: int, shards: int, local: int) -> np.ndarray:
    """The number of each kind that is found `local` times or more in some shard, else -1: low ones for the most frequent. key: the kind of each row."""
    frequent, total = np.zeros(kinds, bool), np.zeros(kinds)
    for s in range(shards):
        here = shard == s
        found = np.bincount(key[here], n[here], minlength=kinds)  # exact up to 2^53
        frequent |= found >= local
        total += found
    those = np.flatnonzero(frequent)
    out = np.full(kinds, -1)
    out[those[np.argsort(-total[those], kind="stable")]] = np.arange(len(those)) * parts + part
    if len(those) * parts >= 1 << 31:
        raise OverflowError("more than 2^31 frequent phrases of one size")
    return out


def _answers(rows: DataFrame, size: int, shards: int, parts: int, local: int) -> DataFrame:
    """Each row's numbers, in order, for its bin; and (bin null) a row for each number: word and language, or before and last. Of words, rows
    without a number have how many there are of a language."""

    def run(table: pa.Table) -> pa.Table:
        ns = [_unpacked(x) for x in table["n"].to_pylist()]
        each, n, part = np.array([len(x) for x in ns]), np.concatenate(ns), table["part"][0].as_py()
        shard = np.repeat(table["shard"].to_numpy(), each)
        if size == 1:
            langs = table["lang"].combine_chunks().dictionary_encode()
            words = pc.list_flatten(pc.split_pattern(table["keys"].combine_chunks().cast(pa.large_binary()), b" ")).dictionary_encode()
            group = np.repeat(langs.indices.to_numpy().astype(np.int64), each)
            both = group * len(words.dictionary) + words.indices.to_numpy()
        else:
            both = np.concatenate([_unpacked(x, np.int64) for x in table["keys"].to_pylist()])
        key, kinds = pd.factorize(both)
        number = _numbered(key, len(kinds), n, shard, part, parts, shards, local)
        mine, ends = number[key].astype(np.int32), np.cumsum(each)
        out = [_table(_ANSWER, {"bin": table["bin"].combine_chunks(), "at": table["at"].combine_chunks(), "numbers": [_packed(mine[b - a : b]) for a, b in zip(each, ends, strict=True)]})]
        frequent = np.flatnonzero(number >= 0)
        if size == 1:
            group_of, word_of = np.divmod(kinds[frequent], len(words.dictionary))
            out.append(_table(_ANSWER, {"number": number[frequent], "lang": langs.dictionary.take(pa.array(group_of)), "word": as_text(words.dictionary.take(pa.array(word_of)))}))
            out.append(_table(_ANSWER, {"lang": langs.dictionary, "n": np.bincount(group, n, minlength=len(langs.dictionary)).astype(np.int64)}))
        else:
            out.append(_table(_ANSWER, {"number": number[frequent], "before": kinds[frequent] >> 32, "last": kinds[frequent] & 0xFFFFFFFF}))
        released()
        return pa.concat_tables(out)

    return rows.select("bin", "shard", "part", "at", "lang", "keys", "n").groupBy("part").applyInArrow(run, _ANSWER)


def _longer(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases one word longer than the last level's start whose parts both have numbers there; their keys."""
    known = levels[-1]
    at = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0))
    return at, known[at].astype(np.int64) << 32 | levels[0][at + len(levels)]


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted by part and key; each one's part, how often, and each key's place among them."""
    kinds, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    part = (mixed(kinds.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return kinds[order], part[order], n[order].astype(np.int32), back[place]


def _levels(own: pa.Table, given: pa.Table, size: int, parts: int) -> list[np.ndarray]:
    """The numbers of a bin's phrases of 1 to `size` words at their places; the last level's are those given."""
    levels = [_unpacked(x) for x in own["levels"][0].as_py()]
    numbers = [_unpacked(x) for _, x in sorted(zip(given["at"].to_pylist(), given["numbers"].to_pylist(), strict=True))]
    numbers = np.concatenate([*numbers, np.full(1, -1, np.int32)])  # the last one is that of place -1
    if size == 1:
        return [numbers[levels[0]]]
    at, keys = _longer(levels)
    here = np.full(len(levels[0]), -1, np.int32)
    here[at] = numbers[_dealt(keys, parts)[3]]
    return [*levels, here]


def _answered(states: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """run(a bin, its answers) for each bin."""
    given = answers.where("bin is not null").select("bin", "at", "numbers")
    return states.select("bin", "shard", "levels").groupBy("bin").cogroup(given.groupBy("bin")).applyInArrow(run, schema)


def _next(states: DataFrame, answers: DataFrame, size: int, parts: int) -> DataFrame:
    """The bins with the numbers of phrases of `size` words at their places, and the phrases one word longer that are still to count."""

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        bin_, shard = own["bin"][0].as_py(), own["shard"][0].as_py()
        levels = _levels(own, given, size, parts)
        kinds, part, n, _ = _dealt(_longer(levels)[1], parts)
        cuts = list(zip(*_cut(np.arange(len(kinds)), part), strict=True))
        own_part = part[[a for a, _ in cuts]]
        rows = {"part": own_part, "at": own_part, "keys": [_packed(kinds[a:b]) for a, b in cuts], "n": [_packed(n[a:b]) for a, b in cuts]}
        out = [_state(bin_, shard, levels), _table(_BIN, {"bin": np.full(len(cuts), bin_), "shard": np.full(len(cuts), shard)} | rows)]
        released()
        return pa.concat_tables(out)

    return _answered(states, answers, run, _BIN)


def _written(bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to count and the bins' states, written at once to two folders."""
    spark, path = bins.sparkSession, scratch(bins.sparkSession, "bins")
    bins.withColumn("kind", F.when(F.col("part").isNull(), "state").otherwise("rows")).write.partitionBy("kind").parquet(path)
    out = []
    for kind in ("rows", "state"):
        out.append(spark.read.schema(f"{_BIN}, kind string").parquet(path).where(F.col("kind") == kind).drop("kind"))
        out[-1]._granary_path = f"{path}/kind={kind}"
    return out[0], out[1]


def _swept(*tables: DataFrame) -> None:
    """Deletes settled tables, and lets Spark delete the shuffle files that no plan needs any more: it does when the driver's garbage is collected."""
    discard(*tables)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


class Candidates:
    """The phrases of the first step. totals: lang, n; words: number, lang, word; levels: number, before, last of the phrases of two words, three and so
    on; states: the bins, with the numbers of phrases but the longest at their places, which answers have; counted: what counts() has written."""

    def __init__(self, parts: int):
        self.parts, self.levels, self.counted = parts, [], []

    def discard(self) -> None:
        """Also makes the rows of counts() unreadable."""
        _swept(self.totals, self.words, *self.levels, self.states, self.answers, *self.counted)


def frequent_somewhere(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, text: str = "text", lang: str = "lang") -> Candidates:
    """All phrases that some shard holds ceil(least / shards) times or more (SON's first step)."""
    if not 1 <= shards <= 8 or longest < 2:
        raise ValueError("1 to 8 shards, phrases of two words or more")
    local = -(-least // shards)
    parts = PARTS + (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART_BYTES
    out = Candidates(parts)
    rows, out.states = _written(_binned(docs, shards, parts, text, lang))
    for size in range(1, longest + 1):
        out.answers = settled(_answers(rows, size, shards, parts, local), "answers")
        _swept(rows)
        new = out.answers.where("bin is null")
        if size == 1:
            out.totals = settled(new.where("number is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
            out.words = settled(new.where("number is not null").select("number", "lang", "word"), "words")
        else:
            out.levels.append(settled(new.select("number", "before", "last"), f"frequent-{size}"))
        if size < longest:
            old = out.states
            rows, out.states = _written(_next(old, out.answers, size, parts))
            _swept(old, out.answers)
    return out


def _counted(found: Candidates) -> DataFrame:
    """size, number, n: how often the whole corpus holds each candidate."""
    parts, longest = found.parts, len(found.levels) + 1

    def within(own: pa.Table, given: pa.Table) -> pa.Table:
        out = {"part": [], "size": [], "numbers": [], "n": []}
        for size, level in enumerate(_levels(own, given, longest, parts), 1):
            kinds, n = np.unique(level[level >= 0], return_counts=True)
            part = kinds % parts
            order = np.argsort(part, kind="stable")
            kinds, part, n = kinds[order], part[order], n[order].astype(np.int32)
            for a, b in zip(*_cut(np.arange(len(kinds)), part), strict=True):
                for column, value in zip(out.values(), (part[a], size, _packed(kinds[a:b]), _packed(n[a:b])), strict=True):
                    column.append(value)
        released()
        return pa.table({"part": pa.array(out["part"], pa.int32()), "size": pa.array(out["size"], pa.int32()), "numbers": pa.array(out["numbers"], pa.binary()), "n": pa.array(out["n"], pa.binary())})

    def whole(table: pa.Table) -> pa.Table:
        key, kinds = pd.factorize(np.concatenate([_unpacked(x) for x in table["numbers"].to_pylist()]))
        n = np.bincount(key, np.concatenate([_unpacked(x) for x in table["n"].to_pylist()]), minlength=len(kinds)).astype(np.int64)
        released()
        return pa.table({"size": np.full(len(kinds), table["size"][0].as_py(), np.int32), "number": kinds.astype(np.int64), "n": n})

    rows = _answered(found.states, found.answers, within, "part int, size int, numbers binary, n binary")
    return rows.groupBy("size", "part").applyInArrow(whole, "size int, number long, n long")


def counts(docs: DataFrame, keys: Candidates, longest: int = LONGEST, text: str = "text", lang: str = "lang", least: int = 1) -> DataFrame:
    """lang, size, phrase, n: the candidates found `least` times or more in the whole corpus (SON's second step); size 0 counts all words."""
    counted = settled(_counted(keys).where(F.col("n") >= least), "counts")
    keys.counted.append(counted)
    of = lambda size: counted.where(F.col("size") == size).select("number", "n")
    named = keys.words.join(of(1), "number").select("number", "lang", F.col("word").alias("phrase"), "n")
    last = keys.words.select(F.col("number").alias("last"), "word")
    out = keys.totals.select("lang", F.lit(0).alias("size"), F.lit("").alias("phrase"), "n").union(named.select("lang", F.lit(1), "phrase", "n"))
    for size in range(2, longest + 1):
        before = named.select(F.col("number").alias("before"), "lang", "phrase")
        longer = keys.levels[size - 2].join(of(size), "number").join(before, "before").join(last, "last")
        named = settled(longer.select("number", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "n"), f"phrases-{size}")
        keys.counted.append(named)
        out = out.union(named.select("lang", F.lit(size), "phrase", "n"))
    return out


def _part(phrase: Column, start: Column, size: Column) -> Column:
    """`size` words of a phrase from word `start` (0 is the first) on."""
    return F.array_join(F.slice(F.split(phrase, " "), start + 1, size), " ")


def scored(counted: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, size, phrase, a, k, l, r, score: each candidate by its weakest cut."""
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    words = counted.where("size > 0")
    cuts = words.where((F.col("size") > 1) & (F.col("n") >= least)).select(
        "lang", "size", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", _part(F.col("phrase"), F.lit(0), F.col("k"))).withColumn("right", _part(F.col("phrase"), F.col("k"), F.col("size") - F.col("k")))
    both = cuts.join(words.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(
        words.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    raised = (whole("a") * whole("a")) * F.lit(SCALE).cast("decimal(7,0)")
    cut = both.withColumn("up", raised).withColumn("down", whole("l") * whole("r")).withColumn("score", F.expr("up div down").cast("long"))
    weakest = cut.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "size", "phrase", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, longest: int = LONGEST, covered: int = COVERED) -> DataFrame:
    """The candidates that no longer candidate holding their words makes up for `covered` per cent or more."""
    inner = candidates.where(F.col("size") > 2).select("lang", "phrase", "size", F.col("a").alias("longer"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(0), F.col("size") - n), lambda start: _part(F.col("phrase"), start, n))))
    within = inner.select("lang", "longer", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(covered) * F.col("a"), F.lit(False))
    return candidates.join(within, ["lang", "phrase"], "left").where(~held).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, a (both descending) and phrase."""
    keys = frequent_somewhere(docs, least, longest, shards)
    counted = settled(counts(docs, keys, longest, least=least), "phrases")
    keys.discard()
    best = uncovered(settled(scored(counted, least), "scored"), longest, covered)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = counted.where("size = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, r, unnest(ps) AS piece, unnest(range(len(ps))) AS p
  FROM (SELECT lang, doc_id, row_number() OVER () AS r, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), every AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM words WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM words WHERE len(w) > 2
), f AS (SELECT lang, size, phrase, count(*) AS f FROM every GROUP BY ALL
), total AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS lhs, array_to_string(w[k + 1:], ' ') AS rhs
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scores AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lhs JOIN f y ON y.lang = c.lang AND y.phrase = c.rhs
), weakest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE size = 3
), longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE o.most IS NULL OR 100 * o.most < 50 * w.a
)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""
