"""Substring removal by suffix grouping: every byte under a repeated string of `width` bytes goes.

Texts are UTF-8 bytes; matches never cross documents, and strings are judged on the input.

Suffixes are sorted in linear time by grouping: `suffix_array` first puts suffixes into groups of equal Lyndon
prefix, from the greatest group down, by way of pointers to the previous smaller suffix, and then emits
each group's order in one pass, without renaming or recursion. All steps are bucket sorts or single passes.

Spark deals the work. Neighbouring strings that share the place of their leftmost least 32-byte hash (their
anchor) form a stretch; equal strings have equal anchors and lie equally far from them, so only stretches of
anchors met more than once matter. Equal stretches are one, told apart by 128-bit BLAKE2b digests of their bytes.
The different stretches of one anchor form a group. A group of up to `MOST` stretches goes to one task, where their
common core becomes a single symbol and one suffix array over the groups of a chunk tells the repeated strings.
The stretches of a larger group are cut by their strings' distance from the anchor, into cells of 64, 16, 4
and last 1 distances. The bytes that all strings of a cell must share part the group into new, smaller groups, which
are treated in the same way: whatever a group's size, no task holds more than MOST stretches, and all
different stretches meet in a suffix array or differ in bytes that they would have to share.

Null texts are empty. Repeated rows are documents like others: what they hold is repeated; where rows of one doc_id
differ each loses what either would lose. Rows without a doc_id are told apart by a hash of their text. Texts over `SLICE` bytes are read in overlapping slices. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, digests, discard, flat, keyed, pieces, settled, shipped, signed, sliding_min
from .filters import key_filter, passing

WIDTH, GRAM, MOST, CHUNK, SLICE = 200, 32, 64, 3000, 1 << 20
#: Distances of a cell at each cut of a large group, for strings of 200 bytes and less.
CELLS = (64, 16, 4, 1)
_INSTANCE = "g long, u long, v long, doc_id long, start int, n int"


def bucket_order(s: np.ndarray) -> np.ndarray:
    """Places of s in ascending order, equal symbols in text order: radix sorts of 16 bits."""
    order = np.argsort((s & 0xFFFF).astype(np.uint16), kind="stable")
    high = s >> 16
    while high.any():
        order = order[np.argsort((high[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        high = high >> 16
    return order


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of symbols, whose last one is less than all others.

    A group is a range of `order`; group[i] is the first place of suffix i's range."""
    s = np.asarray(symbols, np.int64)
    n = len(s)
    by_symbol = bucket_order(s)
    sorted_ = s[by_symbol]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    begins = np.flatnonzero(new)
    first_place, widths = begins[np.cumsum(new) - 1], np.zeros(n, np.int64)
    widths[begins] = np.diff(np.append(begins, n))
    at, of = np.empty(n, np.int64), np.empty(n, np.int64)
    at[by_symbol], of[by_symbol] = np.arange(n), first_place
    order, place, group, size = by_symbol.tolist(), at.tolist(), of.tolist(), widths.tolist()
    smaller = [-2] * n  # the previous smaller suffix; -1: none; -2: not known yet
    pointing = [0] * n
    end = n
    while end:
        begin = group[order[end - 1]]
        pointed: list[int] = []
        for first in order[begin:end]:
            if smaller[first] != -2:
                continue
            waiting = [first]  # each suffix once: those of the same group that stand before it come first
            while waiting:
                i = waiting[-1]
                p = i - 1
                while p >= 0 and group[p] >= begin:
                    if smaller[p] == -2:
                        break
                    p = smaller[p]
                if p >= 0 and group[p] >= begin:
                    waiting.append(p)
                    continue
                waiting.pop()
                smaller[i] = p
                if p >= 0:
                    if not pointing[p]:
                        pointed.append(p)
                    pointing[p] += 1
        # who is pointed at most often gets the longest prefix: the last part of its group becomes a group
        if pointed:
            rounds: list[list[int]] = [[] for _ in range(1 + max(pointing[p] for p in pointed))]
            for p in pointed:
                rounds[pointing[p]].append(p)
                pointing[p] = 0
            for members in reversed(rounds):
                parts: dict[int, list[int]] = {}
                for p in members:
                    parts.setdefault(group[p], []).append(p)
                for old, same in parts.items():
                    if len(same) == size[old]:
                        continue
                    head = old + size[old] - len(same)
                    k = head + len(same) - 1
                    for p in same:  # swap to the end of the old range
                        other, spot = order[k], place[p]
                        order[k], order[spot], place[p], place[other] = p, other, k, spot
                        group[p] = head
                        k -= 1
                    size[old] -= len(same)
                    size[head] = len(same)
        end = begin
    # each suffix, in order, emits those that end where it begins
    out, fill, done = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            done[j] = True
            j = smaller[j]
    return out


def common_with_neighbours(s: list[int], sa: list[int]) -> list[int]:
    """Of each suffix the longest prefix, in symbols, that it shares with any other suffix."""
    n = len(s)
    rank, best = [0] * n, [0] * n
    for k, i in enumerate(sa):
        rank[i] = k
    h = 0
    for i in range(n):
        if rank[i]:
            j = sa[rank[i] - 1]
            while s[i + h] == s[j + h]:  # the last symbol is unique
                h += 1
            if h > best[i]:
                best[i] = h
            if h > best[j]:
                best[j] = h
            h = max(0, h - 1)
        else:
            h = 0
    return best


class Stretches:
    """Strings of `width` bytes of a batch by anchor, in whole-array steps."""

    def __init__(self, column, width: int):
        self.buf, self.offs = flat(column)
        gram = min(GRAM, width)
        grams = Rolling(self.buf, 2).every(gram)
        least = sliding_min(grams, width - gram + 1)
        rows = len(self.offs) - 1
        count = np.maximum(0, np.diff(self.offs) - width + 1)
        row = np.repeat(np.arange(rows), count)
        at = self.offs[row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        a = least[at]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (grams[at[:-1]] == a[:-1]) | (row[1:] != row[:-1])
        cut = np.flatnonzero(new)
        self.first, self.row, self.anchor = at[cut], row[cut], a[cut]
        self.length = np.diff(np.append(cut, len(a)))


def sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """Texts as binary columns, their doc_ids and where in its text a slice begins; a string of `width` bytes begins in one slice."""
    for batch in pieces(batches, "text"):
        texts, ids = batch["text"].cast(pa.large_binary()), batch["doc_id"].to_numpy(zero_copy_only=False)
        buf, _ = flat(texts)
        if batch.num_rows > 1 or len(buf) <= SLICE:
            yield texts, ids, 0
            continue
        raw = memoryview(buf)
        for at in range(0, len(buf) - width + 1, SLICE):
            yield pa.array([bytes(raw[at : at + SLICE + width - 1])], pa.large_binary()), ids, at


def _stretch_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids, skipped in sliced(batches, width):
            s = Stretches(texts, width)
            raw = s.buf.tobytes()
            ends = s.first + s.length + width - 1
            u, v = digests(raw[a:b] for a, b in zip(s.first.tolist(), ends.tolist(), strict=True))
            start = (s.first - s.offs[s.row] + skipped).astype(np.int32)
            columns = [
                signed(s.anchor), u, v, pa.array(ids[s.row], pa.int64(), from_pandas=True), pa.array(start),
                pa.array(s.length.astype(np.int32))
            ]
            yield pa.RecordBatch.from_arrays(columns, ["g", "u", "v", "doc_id", "start", "n"])

    return run


_PIECE = "g long, u long, v long, bytes binary"


def _bytes_of(width: int):
    """The bytes of each asked stretch; several rows may answer for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            buf, offs = flat(batch["text"])
            raw, asked = buf.tobytes(), batch["asked"]
            sizes = np.diff(asked.offsets.to_numpy())
            f = asked.flatten()
            first = offs[np.repeat(np.arange(batch.num_rows), sizes)] + f.field("start").to_numpy()
            n = f.field("n").to_numpy()
            cut = [raw[a : a + k + width - 1] for a, k in zip(first.tolist(), n.tolist(), strict=True)]
            made = digests(cut)
            # rows of one doc_id may hold different texts: only the asked bytes count
            right = pa.compute.and_(pa.compute.equal(made[0], f.field("u")), pa.compute.equal(made[1], f.field("v")))
            out = pa.RecordBatch.from_arrays([f.field("g"), f.field("u"), f.field("v"), pa.array(cut, pa.binary())], ["g", "u", "v", "bytes"])
            yield out.filter(right)

    return run


def places(raws: list[bytes], width: int) -> list[int]:
    """Where the anchor of each stretch lies: the leftmost least hash of its last string."""
    if not raws:
        return []
    gram = min(GRAM, width)
    h = Rolling(np.frombuffer(b"".join([r[-width:] for r in raws]), np.uint8), 2).every(gram)
    h = np.append(h, np.zeros(gram - 1, np.uint64)).reshape(len(raws), width)[:, : width - gram + 1]
    return (h.argmin(1) + np.array([len(r) for r in raws]) - width).tolist()


def cells(raw: bytes, place: int, width: int, cell: int) -> list[tuple[int, int, bytes]]:
    """Of a stretch its parts whose strings lie in one cell of distances: first string, strings, and the bytes all of the cell share."""
    n = len(raw) - width + 1
    out, k = [], 0
    while k < n:
        near = (place - k) // cell * cell  # the least distance of the cell; distances fall as k rises
        more = min(n, place - near + 1) - k
        out.append((k, more, raw[place - near : max(place - near, place - near + width - cell + 1)]))
        k += more
    return out


def _cell_rows(width: int, cell: int):
    """(cg, cu, cv, cn, g, u, v, lo): each cell of each stretch, its group and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, lo, n, keys, parts = [], [], [], [], []
            raws = batch["bytes"].to_pylist()
            for i, (g, raw, place) in enumerate(zip(batch["g"].to_pylist(), raws, places(raws, width), strict=True)):
                for k, more, core in cells(raw, place, width, cell):
                    take.append(i)
                    lo.append(k)
                    n.append(more)
                    keys.append(b"%d " % g + core)
                    parts.append(raw[k : k + more + width - 1])
            cg, _ = digests(keys)
            cu, cv = digests(parts)
            of = pa.array(take, pa.int64())
            columns = [cg, cu, cv, pa.array(n, pa.int32()), *(batch[c].take(of) for c in ("g", "u", "v")), pa.array(lo, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["cg", "cu", "cv", "cn", "g", "u", "v", "lo"])

    return run


def _cell_bytes(width: int):
    """The bytes of the asked cells of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, raws = batch["asked"], batch["bytes"].to_pylist()
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy())).tolist()
            f = asked.flatten()
            cut = [raws[i][a : a + k + width - 1] for i, a, k in zip(row, f.field("lo").to_pylist(), f.field("cn").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([f.field("cg"), f.field("cu"), f.field("cv"), pa.array(cut, pa.binary())], ["g", "u", "v", "bytes"])

    return run


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    lo = 0
    step = 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
    while a[lo] == b[lo]:
        lo += 1
    return lo


def _neighbours(parts: list[bytes]) -> list[int]:
    """Of each part the longest prefix that it shares with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    best = [0] * len(parts)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = _shared(parts[a], parts[b])
        best[a], best[b] = max(best[a], n), max(best[b], n)
    return best


class _Chunk:
    """Stretches of several anchors, recoded and joined for one suffix array.

    Of each stretch only what it can share with another one of its anchor is kept, and what all of an
    anchor's stretches share is one symbol."""

    def __init__(self, width: int):
        self.width, self.cores = width, 0
        self.symbols: list[int] = []
        self.strings: list[tuple] = []

    def add(self, names: list[tuple], raws: list[bytes], at: list[int]) -> None:
        right = [r[p:] for r, p in zip(raws, at, strict=True)]
        left = [r[:p][::-1] for r, p in zip(raws, at, strict=True)]
        far, back = _neighbours(right), _neighbours(left)
        live = [i for i in range(len(raws)) if far[i] + back[i] >= self.width]
        if len(live) < 2:
            return
        right, left = {i: right[i][: far[i]] for i in live}, {i: left[i][: back[i]] for i in live}
        ends = lambda d: _shared(min(d.values()), max(d.values()))  # noqa: E731  of all: of the least and the greatest
        core_right, core_left = ends(right), ends(left)
        self.cores += 1
        for i in live:
            before, after = left[i][core_left:][::-1], right[i][core_right:]
            begin = len(self.symbols)
            self.symbols += [x + 2 for x in before]
            self.symbols.append(257 + self.cores)
            self.symbols += [x + 2 for x in after]
            self.symbols.append(1)
            self.strings.append((names[i], begin, len(before), core_left + core_right, len(after), at[i] - core_left - len(before)))

    def spans(self) -> list[tuple[tuple, list[tuple[int, int]]]]:
        """Of each stretch its name and the spans of repeated bytes from its first byte."""
        if not self.strings:
            return []
        s = [*self.symbols, 0]
        best = common_with_neighbours(s, suffix_array(s))
        out, width = [], self.width
        for name, begin, before, core, after, first in self.strings:
            starts: list[tuple[int, int]] = []  # first and last repeated string
            for k in range(before + 1):
                symbols = min(best[begin + k], before - k + 1 + after)
                more = symbols - (before - k) - 1  # symbols after the core
                if more < 0:
                    continue
                length = before - k + core + more
                if length >= width:
                    starts.append((first + k, first + k + (length - width if k == before else 0)))
            merged: list[list[int]] = []
            for a, b in starts:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b + width)
                else:
                    merged.append([a, b + width])
            if merged:
                out.append((name, [(a, b) for a, b in merged]))
        return out


_SPANS = "g long, u long, v long, rel array<struct<a:int,b:int>>"


def _sorted_spans(width: int):
    """Over stretches sorted by group: repeated spans of each, a chunk of groups to a suffix array."""

    def result(chunk: _Chunk) -> pa.RecordBatch:
        rows = chunk.spans()
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        rel = pa.array([[{"a": a, "b": b} for a, b in spans] for _, spans in rows], kind)
        names = [pa.array([name[k] for name, _ in rows], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*names, rel], ["g", "u", "v", "rel"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple, tuple[bytes, int]] = {}  # the stretches of one group, each once
        now, chunk, held = None, _Chunk(width), 0

        def add() -> None:
            chunk.add(list(group), *([x[k] for x in group.values()] for k in (0, 1)))

        for batch in batches:
            raws = batch["bytes"].to_pylist()
            for *name, raw, place in zip(*(batch[c].to_pylist() for c in "guv"), raws, places(raws, width), strict=True):
                if group and name[0] != now:
                    add()
                    held += len(group)
                    group.clear()
                    if held >= CHUNK or len(chunk.symbols) > 100_000:
                        yield result(chunk)
                        chunk, held = _Chunk(width), 0
                now = name[0]
                group[tuple(name)] = raw, place
        if group:
            add()
        yield result(chunk)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "replace")
            parts, end, runs, gone = [], 0, 0, 0
            for x in spans or ():
                a, b = min(x["a"], len(raw)), min(x["b"], len(raw))
                if b <= end:
                    continue
                if a > end or runs == 0:
                    parts.append(raw[end:a])
                    runs += 1
                    gone += b - a
                else:
                    gone += b - end
                end = b
            parts.append(raw[end:])
            n_bytes.append(len(raw))
            n_removed.append(gone)
            n_spans.append(runs)
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [
                batch["own_id"], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                pa.array(kept, pa.binary())
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _group_spans(pieces_: DataFrame, width: int, level: int = 0) -> DataFrame:
    """(g, u, v, rel): of stretches (g, u, v, bytes) the spans that another stretch of their group holds as well."""
    sort = lambda df: df.repartition("g").sortWithinPartitions("g").mapInArrow(_sorted_spans(width), _SPANS)
    large = settled(pieces_.groupBy("g").agg(F.count("*").alias("kinds")).where(F.col("kinds") > MOST).select("g"), "suffix-large")
    if large.isEmpty():
        return sort(pieces_)
    many = settled(pieces_.join(large, "g"), "suffix-many")
    inst = settled(
        many.mapInArrow(_cell_rows(width, CELLS[level]), "cg long, cu long, cv long, cn int, g long, u long, v long, lo int"),
        "suffix-cells"
    )
    cell, own = ["cg", "cu", "cv"], ["g", "u", "v"]
    parent = F.struct(*own, "lo")
    agg = inst.groupBy(*cell).agg(F.first("cn").alias("cn"), F.min(parent).alias("one"), F.max(parent).alias("other"))
    agg = settled(agg.select(*cell, "cn", "one", (F.col("one") != F.col("other")).alias("twice")), "suffix-cell-kinds")
    kinds = settled(agg.groupBy("cg").agg(F.count("*").alias("kinds")).where("kinds > 1").select("cg"), "suffix-open-cells")
    asked = agg.join(kinds, "cg").groupBy("one.g", "one.u", "one.v").agg(F.collect_list(F.struct("one.lo", "cn", *cell)).alias("asked"))
    below = settled(many.join(asked, own).mapInArrow(_cell_bytes(width), _PIECE), "suffix-cell-bytes")
    rel = _group_spans(below, width, level + 1).toDF(*cell, "rel")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("cn") + width - 1).alias("b")))
    found = agg.join(rel, cell, "left").select(*cell, F.when(F.col("twice"), whole).otherwise(F.col("rel")).alias("rel")).where("rel IS NOT NULL")
    moved = lambda x: F.struct((F.col("lo") + x["a"]).alias("a"), (F.col("lo") + x["b"]).alias("b"))
    up = inst.join(settled(found, "suffix-cell-spans"), cell).select(*own, F.transform("rel", moved).alias("rel"))
    up = up.groupBy(*own).agg(F.flatten(F.collect_set("rel")).alias("rel"))
    return sort(pieces_.join(large, "g", "left_anti")).unionByName(up)


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, spans): sorted byte spans under repeated strings; they may touch and overlap. docs: doc_id, text."""
    key = ["g", "u", "v"]
    rows = settled(shipped(docs).mapInArrow(_stretch_rows(width), _INSTANCE), "suffix-stretches")
    often = settled(rows.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g"), "suffix-often")
    known = key_filter(often, "g")
    met = settled((rows if known is None else passing(rows, known, "g")).join(often, "g"), "suffix-met")
    place = F.min(F.struct("doc_id", "start")).alias("first")
    whole = settled(met.groupBy(*key).agg(place, F.first("n").alias("n"), F.count("*").alias("copies")), "suffix-whole")
    kinds = settled(whole.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g"), "suffix-kinds")
    open_ = whole.join(kinds, "g").select("first.doc_id", "first.start", "n", *key)
    side = settled(open_.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", *key)).alias("asked")), "suffix-asked")
    known = key_filter(side, "doc_id")
    texts = (docs if known is None else passing(docs, known, "doc_id")).join(side, "doc_id")
    put = settled(texts.mapInArrow(_bytes_of(width), _PIECE), "suffix-pieces")
    rel = settled(_group_spans(put, width), "suffix-rel")
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + width - 1).alias("b")))
    judged = whole.join(rel, key, "left").where("copies > 1 OR rel IS NOT NULL")
    judged = settled(judged.select(*key, F.when(F.col("copies") > 1, all_of_it).otherwise(F.col("rel")).alias("rel")), "suffix-judged")
    moved = lambda x: F.struct((F.col("start") + x["a"]).alias("a"), (F.col("start") + x["b"]).alias("b"))
    spans = met.join(judged, key).select("doc_id", F.transform("rel", moved).alias("s"))
    spans = settled(spans.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_set("s"))).alias("spans")), "suffix-spans")
    discard(rows, often, met, whole, kinds, side, put, rel, judged)
    return spans


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    rows = keyed(docs)
    side = repeated_spans(rows.select("doc_id", "text"), width)
    known = key_filter(side, "doc_id")
    if known is None:
        return rows.join(side, "doc_id", "left").mapInArrow(_kept, _KEPT)
    hit = passing(rows, known, "doc_id").join(side, "doc_id", "left").mapInArrow(_kept, _KEPT)
    rest = passing(rows, known, "doc_id", hits=False).withColumn("spans", F.lit(None).cast(side.schema["spans"].dataType))
    return hit.unionByName(rest.mapInArrow(_kept, _KEPT))


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup(docs, width).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS p FROM h WHERE length(x) >= 400)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
i AS (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS g
      FROM (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 1 ELSE 0 END AS n FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, g),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM s)
SELECT h.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a) AS n_spans,
       sha256(unhex(coalesce(string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a), '') || substr(x, 2 * coalesce(max(b), 0) + 1))) AS kept_sha256
FROM h LEFT JOIN e ON h.doc_id = e.doc_id GROUP BY h.doc_id, x
"""
