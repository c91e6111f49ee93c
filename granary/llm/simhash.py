"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 values
(seed 42) of its word shingles. Fingerprints within `radius` 4 bits are linked; a component is
what links reach. Links are found by fuzzy hashing: the 64 bits are three segments of 23, 23
and 18 bits (the last filled up with zeros). Of at most four differing bits, some two segments
hold at most two. So for each pair of segments a fingerprint gives the keys of itself and of all its neighbours
at one flipped bit: two fingerprints within two bits over the pair share the keys of a fingerprint midway. A key
holds the Golay codeword indices (12 bits) of the pair's two segments. Most flips decode to the same codeword, hence
about a dozen keys a pair and not 47. A key that more than `CHUNK` fingerprints have is replaced by long keys, which
also hold the codeword indices of the same 46 bits in a fixed other order: unrelated fingerprints share its 48 bits by
chance only, and two near ones still share those of the fingerprint midway. So buckets stay small however many fingerprints
there are. Shared keys make candidates, which are verified bit by bit.

Equal fingerprints are one node. A bucket is compared in chunks of at most `CHUNK` nodes, each
giving a spanning forest of its links and never all pairs. After those links are
joined, most buckets lie in one component; in any other bucket each node outside the bucket's
largest component is compared with every chunk of it, so no link between components is missed.

Null texts and texts without words have fingerprint zero and are linked like any other.
Repeated rows of a doc_id each get their row; a row without a doc_id is linked like any other and names a component
only where no row of it has one (component_id is null then). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, pieces, settled, shipped

SHINGLE, RADIUS, CHUNK = 4, 4, 256
_SEED = 42
#: Generator polynomial of the binary Golay code of 23 bits, x^11+x^10+x^6+x^5+x^4+x^2+1, and first bits and widths of the segments.
_GENERATOR, _SEGMENTS = 0b110001110101, ((0, 23), (23, 23), (46, 18))


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    x = x.astype(np.int64)
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (_GENERATOR << (bit - 11)), x)
    return x


def _error_table() -> np.ndarray:
    """The one error of weight three or less that has each syndrome: the code is perfect."""
    from itertools import combinations

    errors = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(23), k)], np.int64)
    table = np.zeros(2048, np.int64)
    table[_syndromes(errors)] = errors
    return table


_ERRORS: np.ndarray | None = None


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the Golay codeword next to each 23-bit word."""
    global _ERRORS
    if _ERRORS is None:
        _ERRORS = _error_table()
    words = words.astype(np.int64)
    return (words ^ _ERRORS[_syndromes(words)]) >> 11


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], _SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """own_id, fp: the doc_id as given, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            fps = np.array([fingerprint((t or "").encode("utf-8", "replace"), shingle) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["own_id"], pa.array(fps.view(np.int64))], ["own_id", "fp"])

    return shipped(keyed(docs)).select("own_id", "text").mapInArrow(run, "own_id long, fp long")


#: The other order of a pair's 46 bits: bit i goes to place _ORDER[i].
_ORDER = np.random.RandomState(23).permutation(46)


#: Pairs of segments, and the bit that tells long keys from others.
_PAIRS, _LONG = ((0, 1), (0, 2), (1, 2)), 1 << 52


def _reordered(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit, to in enumerate(_ORDER.tolist()):
        out |= (x >> bit & 1) << to
    return out


def _codes(fps: np.ndarray, pair: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint and each of its neighbours at one flipped bit or none over the pair: key and long key."""
    decode(np.zeros(1, np.int64))  # makes the error table
    fps, low = fps.astype(np.uint64), (1 << 23) - 1
    (a, a_bits), (b, b_bits) = (_SEGMENTS[i] for i in _PAIRS[pair])
    segment = lambda first, width: (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
    own = segment(a, a_bits) | segment(b, b_bits) << 23
    flips = np.array([0, *(1 << i for i in range(a_bits)), *(1 << 23 + i for i in range(b_bits))], np.int64)
    keys, k = [], np.full((len(fps), len(flips)), pair, np.int64)
    for whole, flip in ((own, flips), (_reordered(own), _reordered(flips))):
        for shift in (0, 23):
            word, change = whole >> shift & low, flip >> shift & low
            # syndromes are linear: a flip's is added to the word's
            error = _ERRORS[_syndromes(word)[:, None] ^ _syndromes(change)[None, :]]
            k = k << 12 | ((word[:, None] ^ change[None, :]) ^ error) >> 11
        keys.append(k)
    return keys[0], keys[1] | _LONG


def _distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct keys of each row; a negative key is none."""
    keys = np.sort(keys, 1)
    new = keys >= 0
    new[:, 1:] &= keys[:, 1:] != keys[:, :-1]
    return rows[np.nonzero(new)[0]], keys[new]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct keys: pair of segments (2 bits) and the codeword indices of its segments (24 bits)."""
    parts = [_distinct(_codes(fps, pair)[0], np.arange(len(fps))) for pair in range(len(_PAIRS))]
    return np.concatenate([r for r, _ in parts]), np.concatenate([k for _, k in parts])


def long_keys_of(fps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct long keys of those neighbours of each fingerprint that have the given key."""
    parts = []
    for pair in range(len(_PAIRS)):
        rows = np.flatnonzero(keys >> 24 == pair)
        short, long = _codes(fps[rows], pair)
        parts.append(_distinct(np.where(short == keys[rows, None], long, -1), rows))
    return np.concatenate([r for r, _ in parts]), np.concatenate([k for _, k in parts])


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    a, b = a.view(np.uint64), b.view(np.uint64)  # of a signed number the count is that of its absolute value
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of these links those that join two parts which were apart."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


_LINKS = "a long, b long"


def _chunk_links(radius: int):
    """Within each (key, chunk) of a partition sorted by them: a spanning forest of the links."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            group = numbered(frame)
            last = np.searchsorted(group, group[-1])
            rest = frame.iloc[last:]
            yield links(frame.iloc[:last], group[:last])
        if rest is not None and len(rest):
            yield links(rest, np.zeros(len(rest), np.int64))

    def numbered(frame: pd.DataFrame) -> np.ndarray:
        key, chunk = frame["key"].to_numpy(), frame["chunk"].to_numpy()
        return np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]))])

    def links(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        fps, out = frame["fp"].to_numpy(), []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        size = np.diff(cuts)
        few = np.flatnonzero(np.repeat((size > 1) & (size <= 8), size))  # most buckets: neighbours at each lag at once
        f, g = fps[few].view(np.uint64), group[few]
        for lag in range(1, 8):
            near = np.flatnonzero((g[lag:] == g[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= radius))
            out.append(np.stack([f[near], f[near + lag]], 1).view(np.int64))
        for lo, hi in zip(cuts[:-1][size > 8].tolist(), cuts[1:][size > 8].tolist(), strict=True):
            own = np.unique(fps[lo:hi])
            for at in range(0, len(own), 2 * CHUNK):  # rows of the matrix in blocks
                left, right = np.nonzero(_near(own[at : at + 2 * CHUNK], own, radius))
                left += at
                keep = left < right
                if forest := _forest(len(own), left[keep], right[keep]):
                    out.append(own[np.array(forest)])
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    return run


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, label): each node's label is the smallest label reachable over the links.

    nodes has fp and label. Rounds of hooking and halving over written tables: each round joins every
    label to the smallest label of its neighbours, and then labels to their own labels."""
    both = settled(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    own = settled(nodes.select("fp", "label"), "nodes")
    moving = settled(own.join(both.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi"), "moving")
    while True:
        # the links between current labels; both ends of each
        at = both.join(
            moving.select(F.col("fp").alias("a"), F.col("label").alias("la")), "a"
        ).join(moving.select(F.col("fp").alias("b"), F.col("label").alias("lb")), "b")
        hooks = at.where("la <> lb").groupBy("la").agg(F.min("lb").alias("to")).where("to < la")
        hooks = found = settled(hooks, "hooks")
        if hooks.isEmpty():
            break
        for _ in range(3):  # follow hooks of hooks
            next_ = hooks.select(F.col("la").alias("to"), F.col("to").alias("then"))
            hooks = hooks.join(next_, "to", "left").select("la", F.least("to", F.coalesce("then", "to")).alias("to"))
        old, label = moving, F.coalesce("to", "label").alias("label")
        moving = settled(moving.join(hooks, moving["label"] == hooks["la"], "left").select("fp", label), "moving")
        discard(old, found)
    return own.join(moving.select("fp", F.col("label").alias("moved")), "fp", "left").select("fp", F.coalesce("moved", "label").alias("label"))


def _linked(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, label) over all links within radius of the nodes (fp, label: the smallest that links reach)."""

    def keyed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for at in range(0, len(fps), 5_000):
                part = fps[at : at + 5_000]
                row, key = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    def long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = batch["fp"].to_numpy(), batch["key"].to_numpy()
            for at in range(0, len(fps), 5_000):
                part = fps[at : at + 5_000]
                row, key = long_keys_of(part.view(np.uint64), keys[at : at + 5_000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    def large_of(rows: DataFrame, name: str) -> DataFrame:
        return settled(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), name)

    every = settled(nodes.select("fp").mapInArrow(keyed_rows, "key long, fp long"), "golay-keys")
    crowded = large_of(every, "golay-crowded")
    small = every.join(crowded, "key", "left_anti").select("key", "fp", F.lit(None).cast("long").alias("n"), F.lit(0).alias("chunk"))
    parted = settled(every.join(crowded.select("key"), "key").mapInArrow(long_rows, "key long, fp long"), "golay-long-keys")
    # a bucket of up to CHUNK nodes is one chunk, a larger one is dealt out by hash
    chunk = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / CHUNK))).cast("int")
    parted = parted.join(large_of(parted, "golay-large"), "key", "left").select("key", "fp", "n", chunk.alias("chunk"))
    keyed = settled(small.unionByName(parted), "golay-buckets")
    discard(every, crowded)
    dealt = keyed.select("key", "chunk", "fp").repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    first = settled(dealt.mapInPandas(_chunk_links(radius), _LINKS), "near-links")
    labels = settled(components(first, nodes), "near-labels")
    large = keyed.where(F.col("n") > CHUNK)
    if large.isEmpty():
        return labels
    labelled = large.join(labels, "fp")
    spread = labelled.groupBy("key", "label").agg(F.count("*").alias("m"))
    whole = spread.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("labels"))
    apart = settled(labelled.join(whole.where("labels > 1"), "key"), "open-buckets")
    if apart.isEmpty():
        return labels
    # each node outside its bucket's main component meets every chunk of the bucket
    asking = apart.where("label <> main").select(
        "key", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / CHUNK) - 1).cast("int"))).alias("chunk"), "fp", F.lit(True).alias("asks")
    )
    meeting = asking.unionByName(apart.select("key", "chunk", "fp", F.lit(False).alias("asks")))

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        ask, all_ = part.loc[part["asks"], "fp"].to_numpy(), part.loc[~part["asks"], "fp"].to_numpy()
        out = []
        for at in range(0, len(ask), CHUNK):
            left, right = np.nonzero(_near(ask[at : at + CHUNK], all_, radius))
            if len(left):
                links = _forest(len(all_) + CHUNK, right, left + len(all_))
                names = np.concatenate([all_, ask[at : at + CHUNK]])
                out += [(names[x], names[y]) for x, y in links if names[x] != names[y]]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    more = meeting.groupBy("key", "chunk").applyInPandas(meet, _LINKS)
    return components(first.unionByName(more), nodes)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach)."""
    if not 0 <= radius <= 4:
        raise ValueError("segment pairs find links of up to four bits")
    prints = settled(fingerprints(docs, shingle), "simhash")
    # nodes without any doc_id come last, each under a label of its own
    label = F.struct(F.col("own_id").isNull().alias("missing"), F.coalesce("own_id", "fp").alias("id"))
    nodes = settled(prints.groupBy("fp").agg(F.min(label).alias("label")), "simhash-nodes")
    labels = _linked(nodes, radius)
    component = F.when(~F.col("label.missing"), F.col("label.id"))
    out = prints.join(labels, "fp")
    return out.select(F.col("own_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
