"""Brown class-based bigrams: exchange clustering of words, class transitions and word emissions.

log10 P(text) is the sum over its tokens of log10 T(class | class before) + log10 E(token | class). Tokens are the words `[^\\x20\\x09-\\x0D]+`
(A-Z lower-cased) and one end, which is also what stands before the first word.

Classes. The `CORE` most frequent words of the training rows are units of their own; every other word, seen or not, belongs to one of `SHAPES`
units by its last three bytes, so that each word has a class without a table of all words. Units are moved between classes by exchange: Spark
counts all neighbouring units of the training rows, writes for each unit its neighbours, and in each round tasks find for half of the units the class
that raises the likelihood of class bigrams most, against the class counts of the round's start. The driver holds one class a unit and the
classes' square of counts, both of fixed size. The best round's classes are kept. The end is class 0, alone.

Probabilities. T is additively smoothed towards the classes' own frequencies. E(w | c) is n(w) / Z(c); what a class doesn't know has together
(n1 + 1) / Z(c), n1 being the class's tokens of words seen once, and Z(c) the sum of both. So each class has one unseen symbol, as the base score has
one for all. Both sums are over all training rows; words beyond the `HEAD` most frequent ones are looked up by a join, their texts are not shuffled.

Null and empty texts are one end. Repeated rows count each. Rows without a doc_id are training rows (their remainder isn't 2).
Without training rows all tokens are the one unseen symbol: both scores are 0. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, pieces, settled, shipped
from .tokens import as_text, coded_words

CLASSES, ROUNDS, PRIOR = 64, 12, 5.0
#: Words that are units of their own; units of all others; words whose counts tasks hold; the longest of these in bytes (so at most 16 MB together).
CORE, SHAPES, HEAD, WIDEST = 1 << 14, 1 << 12, 1 << 18, 64
BATCH = 1 << 20
_END = 0


@dataclass
class Head:
    """The frequent words, most frequent first, of which the first `core` are units."""

    words: pa.Array
    n: np.ndarray
    core: int

    def units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's unit, and its place in the head or -1."""
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where((place >= 0) & (place < self.core), place + 1, 1 + self.core + _shape(words)), place

    @property
    def size(self) -> int:
        return 1 + self.core + SHAPES


def _shape(words: pa.Array) -> np.ndarray:
    _, offsets, data = words.buffers()
    offs = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data, ends = np.frombuffer(data, np.uint8) if data is not None and len(words) else np.zeros(1, np.uint8), offs[1:]
    key = np.zeros(len(words), np.uint64)
    for back in (1, 2, 3):
        key = key * np.uint64(257) + np.where(ends - offs[:-1] >= back, data[np.maximum(ends - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mixed(key) % np.uint64(SHAPES)).astype(np.int64)


@dataclass
class ClassModel:
    head: Head
    of_unit: np.ndarray  # class of each unit
    step: np.ndarray  # log10 T[before, class]
    seen: np.ndarray  # log10 of 1 / Z of each class
    unseen: np.ndarray  # log10 of the weight of what a class doesn't know
    tokens: int  # N: all training tokens
    types: int  # V: distinct ones
    ends: int  # training rows
    rare: DataFrame  # word, n: what isn't in the head


def _sequence(texts: pa.Array, head: Head):
    """The words, each token's unit with the ends in place, and where in it words and ends are."""
    words, code, row, _ = coded_words(texts)
    units, place = head.units(words)
    sequence = np.full(len(code) + len(texts), _END, np.int64)
    at = np.arange(len(code)) + row
    sequence[at] = units[code]
    return words, code, row, place, sequence, at


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all rows; the null word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH):
            words, code, _, _ = coded_words(batch["text"])
            n = np.append(np.bincount(code, minlength=len(words)), batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([as_text(words), pa.nulls(1, pa.string())]), pa.array(n)], ["word", "n"])

    return shipped(texts).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _band() -> F.Column:
    """A count's band: itself, or from 1,024 on a 64th of an octave, so that there are few thousands of bands."""
    return F.when(F.col("n") < 1024, F.col("n")).otherwise(F.lit(1024 - 640) + F.floor(F.log2("n") * 64)).cast("long")


def _frequent(words: DataFrame) -> tuple[Head, DataFrame]:
    """The head, and the words that aren't in it."""
    short = words.where(F.col("word").isNotNull() & (F.octet_length("word") <= WIDEST))
    bands = sorted(((r["band"], r["types"]) for r in short.groupBy(_band().alias("band")).agg(F.count("*").alias("types")).collect()), reverse=True)
    floor, held = (bands[0][0] + 1 if bands else 0), 0
    for band, types in bands:
        if held + types > HEAD:
            break
        floor, held = band, held + types
    inside = (F.octet_length("word") <= WIDEST) & (_band() >= floor)
    rows = sorted(((-r["n"], r["word"].encode()) for r in short.where(_band() >= floor).collect()))
    head = Head(pa.array([w for _, w in rows], pa.large_binary()), np.array([-n for n, _ in rows], np.int64), min(CORE, len(rows)))
    return head, words.where(F.col("word").isNotNull() & ~inside)


def _neighbours(texts: DataFrame, head) -> DataFrame:
    """before, after, n: how often one unit follows another."""
    size = head.value.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH):
            sequence = _sequence(batch["text"], head.value)[4]
            pairs = np.append(_END, sequence[:-1]) * size + sequence
            kinds, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n.astype(np.int64))], ["pair", "n"])

    counted = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.select(F.expr(f"pair div {size}").cast("int").alias("before"), F.expr(f"pair % {size}").cast("int").alias("after"), "n")


def _contexts(pairs: DataFrame) -> DataFrame:
    """A row a unit: the units after and before it with their counts, as packed arrays. At most one entry a unit and side."""
    sides = pairs.select(F.col("before").alias("unit"), F.lit(0).alias("side"), F.col("after").alias("other"), "n").unionAll(
        pairs.select(F.col("after").alias("unit"), F.lit(1).alias("side"), F.col("before").alias("other"), "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []  # columns of the unit that may go on in the next batch
        for batch in batches:
            columns = [np.concatenate([k, batch[c].to_numpy()]) if kept else batch[c].to_numpy() for k, c in zip(kept or [None] * 4, ("unit", "side", "other", "n"), strict=True)]
            whole = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            yield from _packed(*(c[:whole] for c in columns))
            kept = [c[whole:] for c in columns]
        if kept:
            yield from _packed(*kept)

    return sides.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(run, "unit int, after binary, after_n binary, before binary, before_n binary")


def _packed(unit, side, other, n):
    if not len(unit):
        return
    units, start = np.unique(unit, return_index=True)
    rows = []
    for u, a, b in zip(units.tolist(), start.tolist(), [*start[1:].tolist(), len(unit)], strict=True):
        half = a + int(np.searchsorted(side[a:b], 1))
        rows.append((u, other[a:half].astype(np.int32).tobytes(), n[a:half].tobytes(), other[half:b].astype(np.int32).tobytes(), n[half:b].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (pa.array([r[0] for r in rows], pa.int32()), *([r[i] for r in rows] for i in range(1, 5)))],
                                     ["unit", "after", "after_n", "before", "before_n"])


def _vector(ids: bytes, n: bytes, of_unit: np.ndarray, k: int, but: int) -> tuple[np.ndarray, float]:
    """Counts by class of the neighbours other than the unit itself, and how often it neighbours itself."""
    other, count = np.frombuffer(ids, np.int32), np.frombuffer(n, np.int64)
    own = other == but
    return np.bincount(of_unit[other[~own]], count[~own], k), float(count[own].sum())


def _class_counts(contexts: DataFrame, of_unit: np.ndarray, k: int) -> np.ndarray:
    shared = contexts.sparkSession.sparkContext.broadcast(of_unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for unit, ids, n in zip(*(batch[c].to_pylist() for c in ("unit", "after", "after_n")), strict=True):
                total[shared.value[unit]] += np.bincount(shared.value[np.frombuffer(ids, np.int32)], np.frombuffer(n, np.int64), k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    out = np.zeros(k * k)
    for r in contexts.select("unit", "after", "after_n").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    shared.destroy()
    return out.reshape(k, k)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(square: np.ndarray) -> float:
    """What classes add to the log likelihood of the training rows."""
    return float(_h(square).sum() - _h(square.sum(0)).sum() - _h(square.sum(1)).sum())


def best_class(square: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, itself: float) -> tuple[int, float]:
    """Where a unit of class `own` raises the likelihood most (class 0 takes none), and by how much over staying."""
    n = square.copy()
    n[own] -= right
    n[:, own] -= left
    n[own, own] -= itself
    rows, columns = n.sum(1) + left, n.sum(0) + right  # its neighbours stay where they are
    a, b = np.flatnonzero(right), np.flatnonzero(left)
    of_row = _h(n[:, a] + right[a]) - _h(n[:, a])  # class x its new successors
    of_column = _h(n[b] + left[b, None]) - _h(n[b])  # its new predecessors x class
    gain = of_row.sum(1) + of_column.sum(0)
    gain[a] -= of_row[a, np.arange(len(a))]
    gain[b] -= of_column[np.arange(len(b)), b]
    diagonal = np.diagonal(n)
    gain += _h(diagonal + right + left + itself) - _h(diagonal)
    out, come = right.sum() + itself, left.sum() + itself
    gain -= _h(rows + out) - _h(rows) + _h(columns + come) - _h(columns)
    gain[0] = -np.inf
    to = int(np.argmax(gain))
    return to, float(gain[to] - gain[own])


def _moves(contexts: DataFrame, of_unit: np.ndarray, square: np.ndarray, turn: int) -> list[tuple[int, int]]:
    """(unit, class) of half of the units that have a better class."""
    k = len(square)
    shared = contexts.sparkSession.sparkContext.broadcast((of_unit, square))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = shared.value
        for batch in batches:
            found = []
            for unit, after, after_n, before, before_n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                right, itself = _vector(after, after_n, of, k, unit)
                to, gain = best_class(counts, int(of[unit]), right, _vector(before, before_n, of, k, unit)[0], itself)
                if gain > 1e-6:
                    found.append((unit, to))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)], ["unit", "to"])

    half = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(2)) == 0
    rows = contexts.where(half & (F.col("unit") != _END)).mapInArrow(run, "unit int, to int").collect()
    shared.destroy()
    return [(r["unit"], r["to"]) for r in rows]


def exchange(contexts: DataFrame, units: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit and the counts of class after class, by the round of the greatest likelihood."""
    of_unit = np.append(0, 1 + np.arange(units - 1) % (classes - 1)).astype(np.int16)
    square = _class_counts(contexts, of_unit, classes)
    best = (likelihood(square), of_unit, square)
    for turn in range(rounds):
        moves = _moves(contexts, of_unit, square, turn)
        of_unit = of_unit.copy()
        for unit, to in moves:
            of_unit[unit] = to
        square = _class_counts(contexts, of_unit, classes)
        if (now := likelihood(square)) > best[0]:
            best = (now, of_unit, square)
    return best[1], best[2]


def _emissions(words: DataFrame, head, of_unit: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each class, and those of words seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, _ = head.value.units(batch["word"].cast(pa.large_binary()))
            n = batch["n"].to_numpy()
            of, size = of_unit[units], classes
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.bincount(of, n, size)), pa.array(np.bincount(of, n == 1, size))], ["class", "n", "once"])

    n, once = np.zeros(classes), np.zeros(classes)
    rows = words.where("word IS NOT NULL").mapInArrow(run, "class long, n double, once double").groupBy("class").agg(F.sum("n").alias("n"), F.sum("once").alias("once"))
    for r in rows.collect():
        n[r["class"]], once[r["class"]] = r["n"], r["once"]
    return n, once


def train(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> ClassModel:
    """A model of all rows of docs."""
    spark = docs.sparkSession
    texts = shipped(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    words = settled(_word_counts(texts), "lm-words")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).first()
    head, rare = _frequent(words)
    shared = spark.sparkContext.broadcast(head)
    pairs = settled(_neighbours(texts, shared), "lm-pairs")
    contexts = settled(_contexts(pairs), "lm-contexts")
    discard(pairs)
    of_unit, square = exchange(contexts, head.size, classes, rounds)
    discard(contexts)
    n, once = _emissions(words, shared, of_unit, classes)
    n[0] = total["ends"] or 0
    open_ = np.isin(np.arange(classes), of_unit[1 + head.core :])  # classes that hold words which nobody has seen
    weight = np.where(open_, once + 1, 0.0)
    some = n + weight > 0
    prior = np.where(some, n + open_, 0.0)
    prior /= max(prior.sum(), 1.0)
    with np.errstate(divide="ignore"):
        step = np.log10(square + PRIOR * prior) - np.log10(square.sum(1) + PRIOR)[:, None]
        model = ClassModel(head, of_unit, step, -np.log10(np.maximum(n + weight, 1.0)), np.log10(weight), total["n"] or 0, total["types"], total["ends"] or 0, rare)
    return model


def scores(docs: DataFrame, model: ClassModel) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark, rare = docs.sparkSession, model.rare
    shared = spark.sparkContext.broadcast((model.head, model.of_unit, model.step, model.seen, model.unseen, model.ends))
    every = math.log10(model.tokens + model.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of_unit, step, seen, unseen, ends = shared.value
        of_end = np.log10(max(ends, 1))
        with np.errstate(divide="ignore"):
            log_n, log_n1 = np.log10(head.n), np.log10(head.n + 1)
        for batch in pieces(batches, "text", BATCH):
            rows = batch.num_rows
            words, code, row, place, sequence, at = _sequence(batch["text"], head)
            of = of_unit[sequence].astype(np.int64)
            steps = step[np.append(0, of[:-1]), of] + seen[of]
            size = np.bincount(row, minlength=rows) + 1
            last = np.cumsum(size) - 1
            owner = np.repeat(np.arange(rows), size)
            score = np.bincount(owner, steps, rows) + of_end
            base = np.full(rows, np.log10(ends + 1))
            known = place[code] >= 0
            hit, of_word = row[known], place[code[known]]
            score += np.bincount(hit, log_n[of_word], rows)
            base += np.bincount(hit, log_n1[of_word], rows)
            n_known = np.bincount(hit, minlength=rows) + (ends > 0)
            pairs, many = np.unique(row[~known] * max(1, len(words)) + code[~known], return_counts=True)
            whose, which = pairs // max(1, len(words)), pairs % max(1, len(words))
            units, _ = head.units(words)
            tail = pa.StructArray.from_arrays([as_text(words.take(pa.array(which))), pa.array(many.astype(np.int64)), pa.array(unseen[of_unit[units[which]]])], ["word", "m", "unseen"])
            offsets = np.searchsorted(whose, np.arange(rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], pa.array(size), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), tail)],
                ["row", "doc_id", "n_tokens", "n_known", "base", "score", "tail"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    parts = settled(shipped(source).mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, tail array<struct<word:string,m:long,unseen:double>>"), "lm-parts")
    tail = parts.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(rare, "word", "left")
    sums = tail.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("tail_known"), F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("tail_base"),
        F.sum(F.col("m") * F.coalesce(F.log10("n"), F.col("unseen"))).alias("tail_score"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    none = F.lit(model.tokens == 0)
    return parts.drop("tail").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("tail_known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base") - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        F.when(none, F.lit(0.0)).otherwise(F.col("score") + zero("tail_score")).alias("score"))


def perplexity(scored: DataFrame, score: str = "score") -> float:
    """10 to the negative mean log10 probability of a token."""
    r = scored.agg(F.sum(score).alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-r["s"] / r["n"]) if r["n"] else 1.0


def left_out(doc_id: F.Column) -> F.Column:
    """True for the rows that the report's model doesn't learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def report(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: every row by a model of the rows not held out."""
    out = scores(docs, train(docs.where(~left_out(F.col("doc_id"))), classes, rounds))
    return out.select("doc_id", left_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
