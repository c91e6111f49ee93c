"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes may occur with up to e = floor(rate * m) edits. It is cut into e + 1
pieces; any occurrence within e edits holds one piece unchanged. All pieces are looked up at all
positions of a text with one rolling hash, a hit's surroundings must share the q-grams that e edits
leave (q-gram lemma), and Myers' bit-parallel algorithm then gives the least edit distance of the
item to any part of those surroundings.

Texts and items are compared as UTF-8 with A-Z lower-cased and white space runs as one space.
Items shorter than `least` bytes are looked for without edits, and as whole words. The item table is sent to the tasks in
blocks of at most `ITEM_BYTES`; more items take more passes over the documents. Null and
empty texts match nothing; null and empty items are ignored; repeated rows each get their result; columns
named leak_items, leak_item or leak_distance are replaced, others are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, pieces, shipped

RATE, LEAST, ITEM_BYTES = 0.1, 40, 16 << 20
_GRAM, _GRAMS = 4, 1 << 13
_ADDED = ("leak_items", "leak_item", "leak_distance")


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def least_distance(masks: dict[int, int], m: int, text: bytes) -> int:
    """Least edit distance of a pattern to any part of the text (Myers, one big integer a column)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(xv | up)), up & xv
    return best


def hashed_grams(buf: np.ndarray) -> np.ndarray:
    """13-bit hash of the four bytes at each position."""
    if len(buf) < _GRAM:
        return np.zeros(0, np.int64)
    x = buf.astype(np.uint32)
    code = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
    return (code * np.uint32(2654435761)) >> np.uint32(19)


class Items:
    """Pieces and bit masks of a block of test items."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items, self.rate = items, rate
        self.masks: dict[int, dict[int, int]] = {}
        self.errors = [int(rate * len(t)) for _, t in items]
        cuts = [np.linspace(0, len(t), e + 2).astype(int) for (_, t), e in zip(items, self.errors, strict=True)]
        self.width = min((int(np.diff(c).min()) for c in cuts), default=1)
        places: dict[int, list[tuple[int, int, bytes]]] = {}
        for i, ((_, t), c) in enumerate(zip(items, cuts, strict=True)):
            for a, b in zip(c[:-1].tolist(), c[1:].tolist(), strict=True):
                key = int(Rolling(np.frombuffer(t[a : a + self.width], np.uint8)).every(self.width)[0])
                places.setdefault(key, []).append((i, a, t[a:b]))
        self.places = places
        self.hashes = np.array(sorted(places), np.uint64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.grams: dict[int, np.ndarray] = {}

    def hits(self, text: bytes) -> list[tuple[int, int]]:
        """(position, hash) of every place of the text where some piece begins."""
        if len(text) < self.width or not len(self.hashes):
            return []
        h = Rolling(np.frombuffer(text, np.uint8)).every(self.width)
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = at[self.hashes[np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)] == h[at]]
        return list(zip(at.tolist(), h[at].tolist(), strict=True))

    def verified(self, i: int, part: bytes, grams: np.ndarray) -> int | None:
        """Distance of item i within this part, or None if it is over the budget. grams: the part's, hashed.

        Equal hashes of different grams only raise the count, so the filter loses nothing."""
        _, t = self.items[i]
        m, e = len(t), self.errors[i]
        need = m + 1 - _GRAM - _GRAM * e
        if need > 0:
            if i not in self.grams:
                self.grams[i] = np.zeros(_GRAMS, bool)
                self.grams[i][hashed_grams(np.frombuffer(t, np.uint8))] = True
            if np.count_nonzero(self.grams[i][grams]) < need:
                return None
        if i not in self.masks:
            masks: dict[int, int] = {}
            for j, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << j
            self.masks[i] = masks
        d = least_distance(self.masks[i], m, part)
        return d if d <= e else None

    def search(self, texts: list[bytes]) -> list[dict[int, int]]:
        """Of each text its items within the budget and their distances."""
        whole = b"\n".join(texts)
        grams = hashed_grams(np.frombuffer(whole, np.uint8))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        found: list[dict[int, int]] = [{} for _ in texts]
        seen: set[tuple[int, int, int]] = set()
        for at, key in self.hits(whole):
            row = -1
            for i, offset, piece in self.places[key]:
                if whole[at : at + len(piece)] != piece:
                    continue
                row = int(np.searchsorted(starts, at, "right")) - 1 if row < 0 else row
                e, m, lo, hi = self.errors[i], len(self.items[i][1]), int(starts[row]), int(starts[row + 1]) - 1
                # neighbouring diagonals share one window of twice the slack
                diagonal = (at - offset) // (e + 1)
                if (row, i, diagonal) in seen:
                    continue
                seen.add((row, i, diagonal))
                begin = diagonal * (e + 1) - e
                a, b = max(lo, begin), max(0, min(hi, begin + m + 3 * e + 1))
                d = self.verified(i, whole[a:b], grams[a : max(a, b - _GRAM + 1)])
                if d is not None:
                    found[row][i] = min(d, found[row].get(i, d))
        return found


class Exact:
    """Short items, by length: each is looked up between white space or a text's ends."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.by_length: dict[int, dict[bytes, list[int]]] = {}
        for i, t in items:
            padded = b" " + t + b" "
            self.by_length.setdefault(len(padded), {}).setdefault(padded, []).append(i)
        self.hashes = {n: np.unique([Rolling(np.frombuffer(t, np.uint8)).every(n)[0] for t in ts]) for n, ts in self.by_length.items()}

    def search(self, texts: list[bytes]) -> list[set[int]]:
        """Of each text the ids of the items that it holds."""
        found: list[set[int]] = [set() for _ in texts]
        if not self.by_length:
            return found
        whole = b"".join(b" " + t + b" \n" for t in texts)
        ends = np.cumsum([len(t) + 3 for t in texts])
        roll = Rolling(np.frombuffer(whole, np.uint8))
        for n, items in self.by_length.items():
            for at in np.flatnonzero(np.isin(roll.every(n), self.hashes[n])).tolist():
                found[int(np.searchsorted(ends, at, "right"))].update(items.get(whole[at : at + n], ()))
        return found


def annotate(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """docs with leak_items (how many test items it holds), leak_item (the nearest, then smallest id) and leak_distance."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BYTES))
    out = shipped(docs).drop(*_ADDED)
    out = out.withColumns({"leak_items": F.lit(0).cast("long"), "leak_item": F.lit(None).cast("long"), "leak_distance": F.lit(None).cast("int")})
    schema = out.schema
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        held = sorted((r["item_id"], t) for r in rows if (t := plain(r["text"])))
        if held:
            out = out.mapInArrow(_searcher(held, rate, least), schema)
    return out


def _searcher(held: list[tuple[int, bytes]], rate: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([x for x in held if len(x[1]) >= least], rate)
        short = Exact([x for x in held if len(x[1]) < least])
        for batch in pieces(batches, "text"):
            names = batch.schema.names
            texts = [plain(t) for t in batch["text"].to_pylist()]
            found = items.search(texts)
            n, best, distance = [], [], []
            for f, exact, n0, b0, d0 in zip(found, short.search(texts), *(batch[c].to_pylist() for c in _ADDED), strict=True):
                per = dict.fromkeys(exact, 0)
                for i, d in f.items():
                    per[items.items[i][0]] = min(d, per.get(items.items[i][0], d))
                nearest = min([(d, k) for k, d in per.items()] + ([(d0, b0)] if b0 is not None else []), default=(None, None))
                n.append(n0 + len(per))
                distance.append(nearest[0])
                best.append(nearest[1])
            new = {"leak_items": pa.array(n, pa.int64()), "leak_item": pa.array(best, pa.int64()), "leak_distance": pa.array(distance, pa.int32())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in names], names)

    return run


def report(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """doc_id, contaminated, leak_items, leak_item, leak_distance."""
    found = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, rate, least)
    return found.select("doc_id", (F.col("leak_items") > 0).alias("contaminated"), *_ADDED)


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The documents that hold no test item, with docs' columns."""
    return annotate(docs, items, rate, least).where("leak_items = 0").select(*docs.columns)
