"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The documents of each source, in a seeded random order, make blocks of `block_rows`. A source of
weight w (its share of all weights, an exact fraction) gives its k-th block (from 1) the release time
floor((k-1)/w) and the deadline ceil(k/w), in slots of one block; in each slot the released block with
the earliest deadline goes (ties: source name). While a source lasts, the number of blocks that it has had
differs from w times the slots by less than one, however long the input is. The schedule has one
row a block: the driver holds one entry a source and makes the schedule `period` blocks at a time, each piece is
written to the shared folder, and a bucket of documents is joined with the blocks that it reaches.

Documents are numbered within hashed buckets of a source, and bucket offsets are summed up
over at most `MOST_BUCKETS` rows a source, so a source with a third of all rows is many groups.
After a source's last block the others may go earlier within their windows; slots that no block may take
stay empty. Every row is kept: a null source is the source
'', repeated rows are repeated, null doc_ids come first in their bucket. An empty table
gives no rows. Sources without a stated weight get the default, the square root of their rows;
sources of weight 0 follow after all others, in equal parts.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

BLOCK_ROWS, PERIOD, MOST_BUCKETS, BUCKET_ROWS = 16, 50_000, 1 << 16, 256
ADDED = ("mix_slot", "mix_offset", "mix_block", "mix_release", "mix_deadline")


def parts(weights: Mapping[str, float], period: int) -> dict[str, Fraction]:
    """Exact parts of so many slots."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w * period / total for s, w in exact.items()}


def schedule(weights: Mapping[str, float | Fraction], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block from 0, slot, release, deadline) of each source's blocks by earliest deadline first."""
    exact = {s: Fraction(weights[s]) for s in blocks}
    if any(w < 0 for w in exact.values()):
        raise ValueError("a weight is below 0")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    total, end = sum(whole.values()), 0
    release = lambda s, k: k * total // whole[s]
    deadline = lambda s, k: -(-(k + 1) * total // whole[s])
    waiting = [(0, s, 0) for s in blocks if whole[s] and blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, k), s, k))
        due, s, k = heapq.heappop(ready)
        yield s, k, slot, release(s, k), due
        end = max(end, due)
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
        slot += 1
    last = {s: n for s, n in blocks.items() if not whole[s] and n}
    for s, k, at, free, due in schedule(dict.fromkeys(last, 1), last) if last else ():
        yield s, k, end + at, end + free, end + due


def period_schedule(shares: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The schedule of as many slots as the shares are together."""
    return list(schedule(shares, shares))


def _bucket(n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(n)).cast("int")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, seed: int = 0) -> DataFrame:
    """docs with mix_slot (the order of blocks), mix_offset (the order within a block), mix_block (the
    source's block number from 0), mix_release and mix_deadline. Order by mix_slot, mix_offset to read the mixture."""
    docs = docs.drop(*ADDED)
    key = F.coalesce(F.col("source"), F.lit(""))
    sizes = {r["s"]: r["n"] for r in docs.groupBy(key.alias("s")).agg(F.count("*").alias("n")).collect()}
    wanted = {s: float((weights or {}).get(s, math.sqrt(n))) for s, n in sizes.items()}
    plan = _written(docs.sparkSession, schedule(wanted, {s: -(-n // block_rows) for s, n in sizes.items()}), period)
    n = 1 << max(0, min(MOST_BUCKETS, -(-sum(sizes.values()) // BUCKET_ROWS)) - 1).bit_length()
    rows = docs.withColumns({"__s": key, "__b": _bucket(n, seed)})
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__s", "__b").agg(F.count("*").alias("__n")).select(
        "__s", "__b", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    first = F.floor(F.col("__before") / block_rows)
    reached = offsets.select(
        "__s", "__b", "__before", F.explode(F.sequence(first, F.floor((F.col("__before") + F.col("__n") - 1) / block_rows))).alias("__k")
    )
    reached = reached.join(plan, (F.col("__s") == F.col("__ps")) & (F.col("__k") == F.col("__pk")))
    # a bucket and its blocks in order: rows are looked up in it and their texts are not shuffled again
    offsets = reached.groupBy(F.col("__s").alias("__os"), F.col("__b").alias("__ob")).agg(
        F.min("__before").alias("__before"), F.array_sort(F.collect_list(F.struct("__k", "__slot", "__rel", "__due"))).alias("__blocks")
    )
    within = Window.partitionBy("__s", "__b").orderBy("doc_id", F.xxhash64("text"))
    numbered = rows.withColumn("__rn", F.row_number().over(within)).join(offsets, (F.col("__s") == F.col("__os")) & (F.col("__b") == F.col("__ob")))
    place = F.col("__before") + F.col("__rn") - 1
    numbered = numbered.withColumns({"mix_block": F.floor(place / block_rows).cast("long"), "mix_offset": (place % block_rows).cast("int")})
    placed = numbered.withColumn("__at", F.col("__blocks")[(F.col("mix_block") - first).cast("int")])
    return placed.select(
        *docs.columns, F.col("__at.__slot").alias("mix_slot"), "mix_offset", "mix_block", F.col("__at.__rel").alias("mix_release"),
        F.col("__at.__due").alias("mix_deadline")
    )


def _written(spark: SparkSession, blocks: Iterator[tuple[str, int, int, int, int]], piece: int) -> DataFrame:
    """The schedule as a table, written in pieces: no more than one is held at once."""
    path, kind = scratch(spark, "mix-schedule"), "array<struct<__ps:string,__pk:long,__slot:long,__rel:long,__due:long>>"
    more = True
    while more:
        part = list(islice(blocks, piece))
        if part and max(due for *_, due in part) >= 1 << 63:
            raise ValueError("a weight is too small: a slot number is beyond 64 bits")
        rows = json.dumps([dict(zip(("__ps", "__pk", "__slot", "__rel", "__due"), row, strict=True)) for row in part])
        spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind))).write.mode("append").parquet(path)
        more = len(part) == piece
    return spark.read.parquet(path)
