"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash candidates, each verified on the shingles.

A document is the set of the XXH64 values (seed 42) of its shingles of `shingle` words, cut as in
simhash.py. Sets with a similarity (shared over all) of at least LEAST are linked; a component is
what links reach. Candidates share a key. One key is the component of the set's SimHash, as simhash.py
finds it by Golay codewords within RADIUS bits (each shingle votes once, so that a set has one SimHash).
Most sets of a similarity of 0.8 to 0.9 lie further apart, so there are BANDS more keys, each made of ROWS least values
under random orders: two sets of similarity s share none with probability (1 - s^ROWS)^BANDS, 5 in 10^8 at 0.8
and less above. Every link is verified by counting the shingles themselves.

Equal sets are one node. The nodes of a key stand in one order and meet their next LAGS ones, so a key
gives a few pairs a node and never all. After those links are joined, most keys lie in one component; in
any other key of more nodes each one outside the key's largest component meets all of them, in
blocks. Texts without words are one node. Repeated rows of a doc_id each get their row, rows without one are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import key_of, keyed, mixed, pieces, settled, shipped
from .filters import key_filter, passing
from .simhash import _LINKS, _SEED, _forest, components, majority, shingle_hashes

SHINGLE, BANDS, ROWS, LAGS, BLOCK = 5, 32, 4, 3, 256
#: The least similarity of a link, as a fraction: sizes are compared in whole numbers.
LEAST = (4, 5)
_ORDERS = np.random.RandomState(7).randint(0, 1 << 62, (2, BANDS * ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a shorter text is one shingle."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band of a set that is not empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        x = hashes[at : at + 512, None] * _ORDERS[0]
        x ^= x >> np.uint64(32)
        x *= _ORDERS[1]
        np.minimum(least, x.min(0), out=least)
    least = mixed(least).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, row])
    return key


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[list[np.ndarray], pa.Array]:
    """The texts' sets of shingles and the hashes of these sets."""
    sets = [shingles((t or "").encode("utf-8", "replace"), shingle) for t in batch["text"].to_pylist()]
    return sets, pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), _SEED) for s in sets], np.uint64).view(np.int64))


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, missing (as `keyed` gives them), fp (hash of the set), sim (SimHash of the set), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets, fps = _sets(batch, shingle)
            keys = pa.array([band_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64()))
            sims = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["missing"], fps, sims, keys], ["doc_id", "missing", "fp", "sim", "keys"])

    return shipped(keyed(docs)).select("doc_id", "missing", "text").mapInArrow(run, "doc_id long, missing boolean, fp long, sim long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(fp, hashes: eight bytes a shingle) of the wanted (doc_id, fp), made again from those documents' texts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets, fps = _sets(batch, shingle)
            yield pa.RecordBatch.from_arrays([fps, pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "hashes"])

    rows, known = shipped(keyed(docs)).select("doc_id", "text"), key_filter(wanted, "doc_id")
    made = (rows if known is None else passing(rows, known, "doc_id")).mapInArrow(run, "fp long, hashes binary")
    return made.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    up, down = LEAST
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * down >= (len(a) + len(b) - shared) * up


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all similar pairs of two lists of sets, counted over the shingles found in both."""
    up, down = LEAST
    every = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    sizes = [np.array([len(s) for s in x], np.int64) for x in (left, right)]
    both = np.intersect1d(*every)
    shared = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    at = [np.searchsorted(both, x) for x in every]
    found = [
        (p < len(both)) & (both[np.minimum(p, len(both) - 1)] == x) if len(both) else np.zeros(len(x), bool) for p,
        x in zip(at, every, strict=True)
    ]
    for lo in range(0, len(both), 4096):  # columns of the matrices in blocks
        width = min(4096, len(both) - lo)
        marks = []
        for side, n in enumerate(sizes):
            m = np.zeros((len(n), width), np.float32)
            hit = found[side] & (at[side] >= lo) & (at[side] < lo + width)
            m[rows[side][hit], at[side][hit] - lo] = 1
            marks.append(m)
        shared += marks[0] @ marks[1].T
    shared = shared.astype(np.int64)
    return np.nonzero(shared * down >= (sizes[0][:, None] + sizes[1][None, :] - shared) * up)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = [[np.frombuffer(x, np.uint64) for x in batch[c].to_pylist()] for c in ("ha", "hb")]
            keep = pa.array([similar(x, y) for x, y in zip(*view, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(keep)

    side = lambda x: sets.select(F.col("fp").alias(x), F.col("hashes").alias("h" + x))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb").mapInArrow(run, _LINKS)


def _meet(part: pd.DataFrame) -> pd.DataFrame:
    """Links of a block of asking nodes to a block of all."""
    ask, all_ = part[part["asks"]], part[~part["asks"]]
    view = [[np.frombuffer(x, np.uint64) for x in side["hashes"]] for side in (ask, all_)]
    left, right = similar_pairs(*view)
    names = np.concatenate([ask["fp"].to_numpy(), all_["fp"].to_numpy()])
    links = [(names[x], names[y]) for x, y in _forest(len(names), left, right + len(ask)) if names[x] != names[y]]
    return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])


def _groups(rows: DataFrame) -> DataFrame:
    """key, fp: sets whose SimHashes reach one another in steps of up to RADIUS bits (simhash.py) share a key."""
    own = settled(rows.select("fp", "sim").dropDuplicates(["fp"]), "shingle-simhash")
    sims = settled(own.select(F.col("sim").alias("fp"), F.col("sim").alias("label")).distinct(), "simhash-nodes")
    reached = simhash._linked(sims).select(F.col("fp").alias("sim"), F.col("label").alias("key"))
    return own.join(reached, "sim").select("key", "fp")


def _linked(docs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(fp, label) over all links of the nodes (fp, label: whether it has no doc_id, and the smallest; rows: their keys)."""
    one = rows.select("fp", "keys").dropDuplicates(["fp"]).select(F.explode("keys").alias("key"), "fp").unionByName(_groups(rows))
    order = Window.partitionBy("key").orderBy("fp")
    ahead = [F.lead("fp", lag).over(order).alias(f"next{lag}") for lag in range(1, LAGS + 1)]
    size = F.count("*").over(Window.partitionBy("key")).alias("n")
    buckets = settled(one.select("key", "fp", size, *ahead).where("n > 1"), "shingle-buckets")
    pairs = buckets.select(F.col("fp").alias("a"), F.explode(F.array(*(f"next{lag}" for lag in range(1, LAGS + 1)))).alias("b"))
    pairs = settled(pairs.where("b IS NOT NULL").distinct(), "shingle-pairs")
    # only sets that share a key with another are needed; each from the document that names its node
    wanted = settled(nodes.join(buckets.select("fp").distinct(), "fp").select(F.col("label.id").alias("doc_id"), "fp"), "shingle-wanted")
    sets = settled(sets_of(docs, wanted, shingle), "shingle-sets")
    first = settled(_verified(pairs, sets), "shingle-links")
    labels = settled(components(first, nodes), "shingle-labels")
    # in a key of up to LAGS + 1 nodes all pairs have met
    labelled = buckets.where(F.col("n") > LAGS + 1).select("key", "fp", "n").join(labels, "fp")
    spread = labelled.groupBy("key", "label").agg(F.count("*").alias("m"))
    main = spread.groupBy("key").agg(
        F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("labels"), (F.sum("m") - F.max("m")).alias("asking")
    )
    apart = settled(labelled.join(main.where("labels > 1"), "key"), "open-shingle-keys")
    if apart.isEmpty():
        return labels
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("fp"), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    wide = apart.join(sets, "fp")
    asking = wide.where("label <> main").select(
        "key", deal("asking").alias("ours"), each("n").alias("theirs"), "fp", "hashes", F.lit(True).alias("asks")
    )
    meeting = asking.unionByName(
        wide.select("key", each("asking").alias("ours"), deal("n").alias("theirs"), "fp", "hashes", F.lit(False).alias("asks"))
    )
    more = meeting.groupBy("key", "ours", "theirs").applyInPandas(_meet, _LINKS)
    return components(first.unionByName(more), nodes)


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, missing (as `keyed` gives them), component_id (the smallest doc_id that links reach), component_missing (no row there has a doc_id;
    component_id is a stand-in then)."""
    rows = settled(prints(docs, shingle), "shingles")
    nodes = settled(rows.groupBy("fp").agg(F.min(F.struct("missing", F.col("doc_id").alias("id"))).alias("label")), "shingle-nodes")
    found = rows.select("doc_id", "missing", "fp").join(_linked(docs, rows, nodes, shingle), "fp")
    return found.select("doc_id", "missing", F.col("label.id").alias("component_id"), F.col("label.missing").alias("component_missing"))


def without_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents of the smallest doc_id of each component, with docs' columns. Rows of one doc_id are one document and stay
    or go together; of rows without a doc_id that stay, equal texts stay once."""
    groups = near_copies(docs, shingle)
    first = groups.where("doc_id = component_id AND missing = component_missing")
    keepers = settled(first.select(F.struct("missing", "doc_id").alias("__key")).distinct(), "shingle-keepers")
    own = F.struct(F.col("doc_id").isNull(), key_of())
    kept = docs.withColumn("__own", own).join(keepers, F.col("__own") == F.col("__key"), "left_semi").drop("__own")
    return kept.where("doc_id IS NOT NULL").unionByName(kept.where("doc_id IS NULL").dropDuplicates(["text"]))
