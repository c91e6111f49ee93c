"""Broadcast cuckoo filters of a long column: rows that cannot join are left out before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, released
from .cuckoo import SHARD_KEYS, Cuckoo, filled

#: The most bytes of one filter that are sent to all tasks; beyond it the shuffle join alone does the work.
FILTER_BYTES = 32 << 20
#: Rows that are copied at once.
ROWS = 1024


def key_filter(side: DataFrame, column: str):
    """A filter of side's keys (side is a written table), or None if it could pass FILTER_BYTES."""
    n = side.count()
    if n * 8 > FILTER_BYTES:
        return None
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, n) / SHARD_KEYS))))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(part["key"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "filter": [filled(mixed(keys.view(np.uint64))).blob()]})

    key = F.col(column).cast("long")
    rows = side.where(F.col(column).isNotNull()).select(key.alias("key"), key.bitwiseAND(F.lit(shards - 1).cast("long")).cast("int").alias("shard"))
    blobs = {r["shard"]: bytes(r["filter"]) for r in rows.groupBy("shard").applyInPandas(build, "shard int, filter binary").collect()}
    return side.sparkSession.sparkContext.broadcast([blobs.get(i, Cuckoo(1).blob()) for i in range(shards)])


def _held(held: list[Cuckoo], keys: np.ndarray) -> np.ndarray:
    hit, shard = np.zeros(len(keys), bool), keys & (len(held) - 1)
    mix = mixed(keys.view(np.uint64))
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(keys) else ():
        hit[part] = held[shard[part[0]]].holds(mix[part])
    return hit


def passing(df: DataFrame, known, column: str, hits: bool = True) -> DataFrame:
    """The rows of df whose key the filter knows, or else those that it doesn't; null keys aren't known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Cuckoo(blob=b) for b in known.value]
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            hit = _held(held, batch[column].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            hit &= batch[column].is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit if hits else ~hit))
        released()

    return df.mapInArrow(run, df.schema)
