"""What the corpus operators share: scratch tables, batched text columns and rolling hashes.

Texts travel as UTF-8 bytes. Kernels work on one flat byte buffer for a batch of rows, so
their cost is a few numpy passes a batch and not a Python loop a character.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"

_MULT = 0xD6E8FEB86659FD93
_INVERSE = pow(_MULT, -1, 1 << 64)


#: This process's part of the shared folder.
_OWN = uuid.uuid4().hex


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/granary/{_OWN}"


@functools.cache
def _local_base() -> str:
    """Where driver and executors are one process (tests, a laptop) and nothing is set."""
    return tempfile.mkdtemp(prefix="granary-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one written table, below spark.checkpoint.dir."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later steps survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Manifest:
    """The state of an index below its folder: one small file a change. The newest whole one counts, so a change that breaks off is none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.at = spark, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
        self.fs = self.at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at)) if self.fs.exists(self.at) else []

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.at, name)

    def read(self) -> dict | None:
        for name in reversed(self._names()):
            stream = self.fs.open(self._path(name))
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:  # the writer died meanwhile
                continue
            finally:
                stream.close()
        return None

    def write(self, value: dict) -> None:
        names = self._names()
        n = int(names[-1].removesuffix(".json")) + 1 if names else 1
        stream = self.fs.create(self._path(f"{n:012d}.json"), False)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        for name in names[:-1]:
            self.fs.delete(self._path(name), False)


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_granary_path", None):
            remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has left in the shared folder; results that are still unread go with it."""
    remove(spark, _base(spark))


def held_out(doc_id: Column | str) -> Column:
    """True for the rows that no model may learn labels from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: From here on numbers stand for rows without a doc_id. A doc_id as large is one all the same: only where ids are compared with rows that have none,
#: `missing` tells them apart (near copies), or the two may share a place in the order (removed substrings).
NO_ID = 1 << 62


def key_of(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """The doc_id, or where there is none NO_ID plus a hash of the text: never null."""
    own = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long")
    return F.coalesce(own, F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2) + F.lit(NO_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """own_id, missing, doc_id, text: doc_id by key_of, own_id as given, missing where that is null; a null text is empty."""
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("own_id"), own.isNull().alias("missing"), key_of().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers, once a Spark context, so that they need no installed copy."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if getattr(sc, "_granary_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="granary-code-"), "granary_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._granary_shipped = True


def shipped(df: DataFrame) -> DataFrame:
    """df, once Python workers can import the package. Kernels cut Spark's batches into smaller ones by `pieces`."""
    ship(df.sparkSession)
    return df


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text is a batch of its own. At the end the worker, which Spark
    keeps, gives back what it no longer uses."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = flat(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offs, offs[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    released()


def released() -> None:
    """Gives unused memory of this Python worker back to its machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def powers(n: int, base: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006  kept for the life of a worker
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _kept or len(_kept[base]) < n:
        a = np.full(max(n, 1 << 16), base, np.uint64)
        a[0] = 1
        _kept[base] = np.multiply.accumulate(a)
    return _kept[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(_MULT)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any slices of one symbol sequence, each in constant time (polynomial modulo 2^64)."""

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        rng = np.random.RandomState(seed)
        self.base = (_MULT + 2 * int(rng.randint(1, 1 << 30))) % (1 << 64) | 1
        if symbols.dtype == np.uint8:
            values = (rng.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))[symbols]
        else:
            values = mixed(symbols.astype(np.uint64) + np.uint64(seed))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(values * powers(len(symbols), self.base), out=self.sums[1:])
        self.back = powers(len(symbols) + 1, pow(self.base, -1, 1 << 64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Of the slices of this length that start at 0, 1, 2, ..."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    if rest := width - have:
        out = np.minimum(out[:-rest], out[rest:])
    return out


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run without white space; rows never share a word."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    dark = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    first[cut] = dark[cut]
    last[cut - 1] = dark[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def digests(parts: Iterable[bytes]) -> tuple[pa.Array, pa.Array]:
    """128-bit BLAKE2b of each part, as two columns."""
    joined = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts])
    both = np.frombuffer(joined, np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
