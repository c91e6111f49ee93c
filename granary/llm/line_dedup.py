"""Line deduplication with sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least
`least` code points that two documents hold keeps its lines only in the smallest doc_id. The
exact table has a row for each repeated key: how many documents refer to it and which one
keeps it. Cuckoo filters, one for each shard of the key space, stand before that table: a line
which its filter doesn't know is unique and does not reach the exact table. Filters of up to `FILTER_BYTES` together
are broadcast; larger ones are sent to their shard's keys, `SALTS` tasks a shard, so that a task holds one at a time.

Null and empty texts are one empty line. Repeated rows of one doc_id count as one document and
are treated alike; a row without a doc_id keeps all its lines, as it is not larger than any other, and takes none from others.
Extra columns are ignored by `dedup_report` and carried by `dedup_lines`.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Manifest, discard, pieces, remove, scratch, settled, shipped
from .cuckoo import SHARD_KEYS, Cuckoo, filled
from .filters import key_filter, passing

LEAST = 10
#: The most bytes of all filters together that are broadcast.
FILTER_BYTES = 32 << 20
#: Tasks that share the keys of a shard, where filters are not broadcast: a very common line is spread over them.
SALTS = 8
#: Buckets of an index's postings by key (a power of two), and how many runs of one size are merged.
BUCKETS, FANOUT = 64, 4


def keys_of(text: bytes, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and of each line the 16-byte digest of its key (None: too short)."""
    lines = text.split(b"\n")
    digests: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE).lower()
        n = len(key)
        if n < least or n < 4 * least and len(key.decode("utf-8", "replace")) < least:
            digests.append(None)
        else:
            digests.append(xxhash.xxh3_128_digest(key))
    return lines, digests


def _bytes(x) -> bytes:
    return b"" if x is None else x.encode("utf-8", "replace")


def _line_keys(least: int, filters=None):
    """Rows (h1, h2, doc_id) of each document's distinct keys; with filters only those they know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Cuckoo(blob=b) for b in filters.value] if filters is not None else None
        for batch in pieces(batches, "text"):
            found, ids = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = {d for d in keys_of(_bytes(text), least)[1] if d}
                found += own
                ids += [doc] * len(own)
            h = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
            docs = pa.array(ids, pa.int64())
            if known is not None and len(h):
                shard = (h[:, 1] % np.uint64(len(known))).astype(np.int64)
                hit = np.zeros(len(h), bool)
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    hit[part] = known[shard[part[0]]].holds(h[part, 0])
                h, docs = h[hit], docs.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].view(np.int64).copy()), pa.array(h[:, 1].view(np.int64).copy()), docs], ["h1", "h2", "doc_id"]
            )

    return run


_KEY_ROWS = "h1 long, h2 long, doc_id long"


def _narrow(docs: DataFrame) -> DataFrame:
    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def reference_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The exact table: each key of two documents or more, its keeper and its number of references."""
    rows = _narrow(docs).mapInArrow(_line_keys(least), _KEY_ROWS)
    return (
        rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("refs"))
        .where("last > keeper").drop("last")
    )


def shard_filters(table: DataFrame, shards: int, room: int = 0) -> DataFrame:
    """(shard, filter): one cuckoo filter for each shard of the table's keys, with room for so many more."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = filled(part["h1"].to_numpy().view(np.uint64), room)
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "filter": [made.blob()]})

    return table.select("h1", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def _shard(shards: int):
    # h2 as an unsigned number modulo a power of two is its low bits
    return F.col("h2").bitwiseAND(F.lit(shards - 1).cast("long")).cast("int")


def _probe(batch: pa.RecordBatch, known: Cuckoo) -> pa.RecordBatch:
    return batch.filter(pa.array(known.holds(batch["h1"].to_numpy().view(np.uint64))))


def known_rows(rows: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows (h1, h2, doc_id) that their shard's filter knows. Filters and rows meet in tasks by shard and salt: a filter
    stands before its rows, which stream past it."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    dealt = rows.select(
        "h1", "h2", "doc_id", _shard(shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        none("filter", "binary")
    )
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sent = filters.select(none("h1", "long"), none("h2", "long"), none("doc_id", "long"), "shard", copies, "filter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, Cuckoo(1)
        for batch in batches:
            group = batch["shard"].to_numpy().astype(np.int64) * SALTS + batch["salt"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if group[a] != now:
                    now, known = group[a], Cuckoo(1)
                if (blob := part["filter"][0].as_py()) is not None:
                    known, part = Cuckoo(blob=blob), part.slice(1)
                yield _probe(part.select(["h1", "h2", "doc_id"]), known)

    both = dealt.unionByName(sent).repartition("shard", "salt")
    return both.sortWithinPartitions("shard", "salt", F.col("filter").isNull()).mapInArrow(run, _KEY_ROWS)


def shards_for(n: int) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1, n) / SHARD_KEYS))))


def _dropped(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, keys): digests of the keys whose lines this document loses."""
    spark = docs.sparkSession
    counts = settled(reference_counts(docs, least), "line-refs")
    n = counts.count()
    shards = shards_for(n)
    filters = shard_filters(counts, shards)
    if n * 8 <= FILTER_BYTES:  # at most 2 bytes of table a slot, and half of the slots empty
        blobs = {r["shard"]: bytes(r["filter"]) for r in filters.collect()}
        held = spark.sparkContext.broadcast([blobs.get(i, Cuckoo(1).blob()) for i in range(shards)])
        rows = _narrow(docs).mapInArrow(_line_keys(least, held), _KEY_ROWS)
    else:
        rows = known_rows(_narrow(docs).mapInArrow(_line_keys(least), _KEY_ROWS), settled(filters, "line-filters"), shards)
    lost = rows.join(counts.select("h1", "h2", "keeper"), ["h1", "h2"]).where("doc_id > keeper").select("doc_id", "h1", "h2")
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost_keys"))


def _without(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lists = batch["lost_keys"]
            n_lines, n_dropped, kept_texts = [], [], []
            for text, lost in zip(batch["text"].to_pylist(), lists.to_pylist(), strict=True):
                text = _bytes(text)
                if not lost:
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    kept_texts.append(text)
                    continue
                gone = {np.array([k["h1"], k["h2"]], np.int64).tobytes() for k in lost}
                lines, digests = keys_of(text, least)
                kept = [line for line, d in zip(lines, digests, strict=True) if d not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                kept_texts.append(b"\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in batch.schema.names if c not in ("text", "lost_keys")),
                    pa.array([k.decode("utf-8", "replace") for k in kept_texts], pa.string()), pa.array(n_lines, pa.int64()),
                    pa.array(n_dropped, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept_texts], pa.string())
                ],
                [*(c for c in batch.schema.names if c not in ("text", "lost_keys")), "text", "n_lines", "n_dropped", "kept_sha256"],
            )

    return run


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with `text` cleared of repeated lines, and n_lines, n_dropped, kept_sha256."""
    reserved = {"n_lines", "n_dropped", "kept_sha256", "lost_keys"}
    docs = docs.drop(*[c for c in docs.columns if c in reserved])
    lost = _dropped(docs, least).withColumnRenamed("doc_id", "__lost_id")
    joined = docs.join(lost, docs["doc_id"] == lost["__lost_id"], "left").drop("__lost_id")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string", "n_lines long", "n_dropped long", "kept_sha256 string"]
    )
    return joined.mapInArrow(_without(least), schema)


def dedup_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each document."""
    return dedup_lines(_narrow(docs), least).drop("text")


class LineIndex:
    """A line index that documents can enter and leave, and that any session can open again: postings in sorted-by-size runs, filters by shard, a manifest.

    A posting says that a document holds a key, or from its generation on no more. The newest generation of each
    (key, document) counts, so a document that enters twice is in once and leaves at once. The exact reference counts
    are sums of live postings: when a document leaves, the next smallest holder becomes the keeper again. A batch asks only for
    the postings of its own keys: these are let through by a filter of the batch's keys, so the index is read in the key's buckets but not shuffled. `FANOUT` runs of
    one size are merged into one of the next size, which drops what is outdated; what is dead goes when the oldest run takes part.

    The filters know every live key. They grow with the index: as soon as shards hold more than SHARD_KEYS keys on average
    there are twice as many, made anew from the exact table; else only the new or dead keys of a batch are put in or
    taken out. `known` asks the filters first; only rows that they know reach the exact counts.

    Rows without a doc_id are no documents of the index: they don't enter it, and keep their lines. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = LEAST):
        self.spark, self.path = spark, path or scratch(spark, "line-index")
        self._manifest = Manifest(spark, self.path)
        state = self._manifest.read() or {"least": least, "generation": 0, "keys": 0, "shards": 1, "filters": None, "runs": []}
        if state["least"] != least:
            raise ValueError(f"the index was made for lines of at least {state['least']} code points")
        self.least, self.generation, self.keys, self.shards = least, state["generation"], state["keys"], state["shards"]
        self._filters: str | None = state["filters"]
        self.runs: list[dict] = state["runs"]

    def _save(self, *gone: str | None) -> None:
        """The state as it is now, and then without the folders that it no longer names."""
        self._manifest.write({"least": self.least, "generation": self.generation, "keys": self.keys, "shards": self.shards, "filters": self._filters, "runs": self.runs})
        for path in gone:
            if path:
                remove(self.spark, f"{self.path}/{path}")

    def _write_run(self, rows: DataFrame, level: int) -> dict:
        """rows: h1, h2, doc_id, live, generation."""
        name = f"postings/{uuid.uuid4().hex}"
        bucket = F.col("h2").bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")
        rows.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return {"name": name, "level": level}

    def _put(self, rows: DataFrame, live: bool) -> list[str]:
        """A run of new postings; names of runs that merges have replaced."""
        self.generation += 1
        self.runs.append(self._write_run(rows.select("h1", "h2", "doc_id", F.lit(live).alias("live"), F.lit(self.generation).alias("generation")), 0))
        gone = []
        while len(some := [r for r in self.runs if r["level"] == self.runs[-1]["level"]]) >= FANOUT:
            at = self.runs.index(some[0])  # runs of one size follow each other, the oldest and largest first
            rows = _newest(self._read(some))
            self.runs[at:] = [self._write_run(rows if at else rows.where("live"), some[0]["level"] + 1)]
            gone += [r["name"] for r in some]
        return gone

    def _read(self, runs: list[dict]) -> DataFrame:
        schema = "h1 long, h2 long, doc_id long, live boolean, generation int, bucket int"
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{r['name']}") for r in runs]
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def postings(self, keys: DataFrame | None = None) -> DataFrame:
        """Live (h1, h2, doc_id); of some keys (h1, h2: distinct, written) only."""
        rows = self._read(self.runs)
        if keys is not None:
            at = [r["b"] for r in keys.select(F.col("h2").bitwiseAND(F.lit(BUCKETS - 1).cast("long")).alias("b")).distinct().collect()]
            rows, held = rows.where(F.col("bucket").isin(at)), key_filter(keys, "h1")
            rows = (rows if held is None else passing(rows, held, "h1")).join(keys.select("h1", "h2"), ["h1", "h2"], "left_semi")
        return _newest(rows).where("live").select("h1", "h2", "doc_id")

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        return self.postings(keys).groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min("doc_id").alias("keeper"))

    def insert(self, docs: DataFrame) -> None:
        """Takes documents in; those that are in already change nothing."""
        rows = settled(_narrow(docs).mapInArrow(_line_keys(self.least), _KEY_ROWS).where("doc_id IS NOT NULL").distinct(), "line-batch")
        keys = settled(rows.select("h1", "h2").distinct(), "line-batch-keys")
        new = settled(keys.join(self.counts(keys).select("h1", "h2"), ["h1", "h2"], "left_anti"), "line-new-keys")
        gone = self._put(rows, True)
        self._save(*gone, self._refilter(new, new.count()))
        discard(rows, keys, new)

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes documents out."""
        ids = settled(doc_ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct(), "line-leaving")
        held, rows = key_filter(ids, "doc_id"), self._read(self.runs)
        rows = (rows if held is None else passing(rows, held, "doc_id")).join(ids, "doc_id", "left_semi")
        leaving = settled(_newest(rows).where("live").select("h1", "h2", "doc_id"), "line-gone")
        keys = settled(leaving.select("h1", "h2").distinct(), "line-gone-keys")
        gone = self._put(leaving, False)
        dead = settled(keys.join(self.counts(keys).select("h1", "h2"), ["h1", "h2"], "left_anti"), "line-dead-keys")
        self._save(*gone, self._refilter(dead, -dead.count()))
        discard(ids, leaving, keys, dead)

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, filter binary").parquet(f"{self.path}/{self._filters}")

    def _refilter(self, keys: DataFrame, change: int) -> str | None:
        """keys: those that become live (change > 0) or dead. Returns the folder of the filters before."""
        self.keys += change
        old, add, at = self._filters, change > 0, f"filters/{uuid.uuid4().hex}"
        if old is None or self.keys > self.shards * SHARD_KEYS:
            self.shards = 2 * shards_for(self.keys)
            return self._written(shard_filters(self.counts(), self.shards, SHARD_KEYS), at, old)

        def update(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            shard = (left if len(left) else right)["shard"].iloc[0]
            h = left["h1"].to_numpy(np.int64).view(np.uint64) if len(left) else np.zeros(0, np.uint64)
            kept = Cuckoo(blob=right["filter"].iloc[0]) if len(right) else Cuckoo(2 * SHARD_KEYS)
            try:
                kept.insert(h) if add else kept.delete(h)
            except OverflowError:  # an unusually full shard: all filters are made anew
                return pd.DataFrame({"shard": [shard], "filter": [None]})
            return pd.DataFrame({"shard": [shard], "filter": [kept.blob()]})

        side = keys.select("h1", _shard(self.shards).alias("shard"))
        self._written(side.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(update, "shard int, filter binary"), at, old)
        if not self.filters().where("filter IS NULL").isEmpty():
            self.shards *= 2
            self._written(shard_filters(self.counts(), self.shards, SHARD_KEYS), at + "-anew", old)
            remove(self.spark, f"{self.path}/{at}")
        return old

    def _written(self, filters: DataFrame, at: str, old: str | None) -> str | None:
        filters.write.parquet(f"{self.path}/{at}")
        self._filters = at
        return old

    def known(self, docs: DataFrame) -> DataFrame:
        """Key rows of docs that the filters know, checked against the exact counts of these keys."""
        rows = _narrow(docs).mapInArrow(_line_keys(self.least), _KEY_ROWS)
        if self._filters is None:
            return rows.where("false").join(self.counts(), ["h1", "h2"])
        rows = settled(known_rows(rows, self.filters(), self.shards), "line-known")
        return rows.join(self.counts(settled(rows.select("h1", "h2").distinct(), "line-known-keys")), ["h1", "h2"])

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs' lines against the live index: keys kept by a smaller document go."""
        lost = self.known(docs).where("doc_id > keeper").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost_keys"))
        joined = _narrow(docs).join(lost, "doc_id", "left")
        return joined.mapInArrow(_without(self.least), "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string")


def _newest(rows: DataFrame) -> DataFrame:
    """Of each (key, document) its newest posting."""
    return rows.groupBy("h1", "h2", "doc_id").agg(F.max_by("live", "generation").alias("live"), F.max("generation").alias("generation"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT y.doc_id, y.line, y.pos, (r.k IS NOT NULL AND y.doc_id > r.keeper) AS gone
  FROM keyed y LEFT JOIN repeated r ON y.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
