"""Incremental substring deduplication over a log-structured index of window hashes.

A window is `width` consecutive words of one document. A word goes if a window that covers it also starts
earlier: in a smaller doc_id, or in the same document at an earlier word.

The fingerprint of a window is its anchor: the least hash of its `GRAM`-word groups. Neighbouring windows that share the place
of their leftmost anchor form a stretch. Each batch adds to the index, once and never changed:

* a run: the distinct fingerprints of the batch, sorted, in a table bucketed by fingerprint. Runs of the same number of
  buckets are merge-joined bucket by bucket without a shuffle, which tells the fingerprints that the batch shares with
  history or with itself. `compact` merges all runs into one; `add` does so at `FANOUT` runs.
* a segment of stretches: fingerprint, 128-bit BLAKE2b digest of all words, place and number of windows.

Only stretches with a shared fingerprint are looked at further, and every hit is verified. Equal digests of all words make two
stretches one. Where stretches of one fingerprint differ, the words of each (read from the texts of the batch and of
history) are compared: in one task for up to `MOST` different stretches; of more, each window is looked up by
the BLAKE2b digest of its words, so that no task holds a large group.

Null texts have no words. Repeated rows of one doc_id are one document's copies: the same words at the same places are
not earlier than themselves, so such rows get equal results; where such rows' texts differ each loses what either would
lose. Rows without a doc_id come after all others, in the order of a hash of their text. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Manifest, Rolling, digests, discard, flat, keyed, pieces, remove, scratch, settled, shipped, signed, sliding_min, words_of
from .filters import key_filter, passing

WIDTH, GRAM, MOST, FANOUT, SLICE = 20, 5, 64, 4, 1 << 17
_ROWS = "g long, u long, v long, doc_id long, start int, n int"
_PIECE = "g long, u long, v long, words binary"
_SPANS = "g long, u long, v long, rel array<struct<a:int,b:int>>"
_KEY = ["g", "u", "v"]


def plain(texts: pa.Array) -> pa.Array:
    """Each text's words, one space between them."""
    return pa.array([b" ".join((t or "").encode("utf-8", "replace").split()) for t in texts.to_pylist()], pa.large_binary())


class Stretches:
    """Windows of the words begin .. end of a buffer by anchor, in whole-array steps."""

    def __init__(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, width: int):
        gram = min(GRAM, width)
        lo = int(begin[0]) if len(begin) else 0
        hi = int(end[-1]) if len(end) else 0
        word = Rolling(buf[lo:hi], 3).of(begin - lo, end - lo)
        grams = Rolling(word, 4).every(gram)
        least = sliding_min(grams, width - gram + 1)
        n = len(least)  # windows; those across rows don't count
        inside = row[:n] == row[width - 1 : width - 1 + n] if n else np.zeros(0, bool)
        windows = np.flatnonzero(inside)
        a = least[windows]
        new = np.ones(len(a), bool)
        # a stretch ends where its leftmost least hash leaves, so no two windows of a stretch can be equal
        new[1:] = (a[1:] != a[:-1]) | (grams[windows[:-1]] == a[:-1]) | (row[windows[1:]] != row[windows[:-1]])
        at = np.flatnonzero(new)
        self.first, self.length, self.anchor = windows[at], np.diff(np.append(at, len(a))), a[at]


def _stretch_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            buf, offs = flat(plain(batch["text"]))
            raw, ids = buf.tobytes(), batch["doc_id"].to_numpy(zero_copy_only=False)
            begin, end, row = words_of(buf, offs)
            first_word = np.searchsorted(row, np.arange(batch.num_rows))
            for at in range(0, max(1, len(begin) - width + 1), SLICE):  # a window begins in one slice
                part = slice(at, at + SLICE + width - 1)
                s = Stretches(buf, begin[part], end[part], row[part], width)
                first = s.first + at
                cut = zip(begin[first].tolist(), end[first + s.length + width - 2].tolist(), strict=True)
                u, v = digests([raw[a:b] for a, b in cut])
                start = (first - first_word[row[first]]).astype(np.int32)
                columns = [signed(s.anchor), u, v, pa.array(ids[row[first]], pa.int64()), pa.array(start), pa.array(s.length.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*_KEY, "doc_id", "start", "n"])

    return run


def _words_of(width: int):
    """The words of each asked stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            buf, offs = flat(plain(batch["text"]))
            raw, asked = buf.tobytes(), batch["asked"]
            begin, end, row = words_of(buf, offs)
            of = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            f = asked.flatten()
            first = np.searchsorted(row, of) + f.field("start").to_numpy()
            last = first + f.field("n").to_numpy() + width - 2
            # rows of one doc_id may hold different texts: only the asked words count
            inside = last < len(begin)
            first, last = np.where(inside, first, 0), np.where(inside, last, 0)
            if not len(begin):
                continue
            words = [raw[a:b] for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)]
            made = digests(words)
            right = pa.compute.and_(pa.compute.equal(made[0], f.field("u")), pa.compute.equal(made[1], f.field("v")))
            yield pa.RecordBatch.from_arrays([*(f.field(k) for k in _KEY), pa.array(words, pa.binary())], [*_KEY, "words"]).filter(right)

    return run


def windows(words: bytes, width: int) -> list[bytes]:
    w = words.split(b" ")
    return [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]


def merged(offsets: list[int], width: int) -> list[dict[str, int]]:
    """Words under the windows at these ascending offsets."""
    out: list[dict[str, int]] = []
    for o in offsets:
        if out and o <= out[-1]["b"]:
            out[-1]["b"] = o + width
        else:
            out.append({"a": o, "b": o + width})
    return out


def _compared(width: int):
    """Over stretches sorted by fingerprint, each with its first place: the windows that start earlier in another one."""

    def lost(group: dict[tuple, tuple]) -> Iterator[tuple]:
        if len(group) < 2:
            return
        own = {name: windows(words, width) for name, (words, _) in group.items()}
        earliest: dict[bytes, tuple] = {}
        for name, (_, (doc, start)) in group.items():
            for off, w in enumerate(own[name]):
                place = (doc, start + off)
                if w not in earliest or place < earliest[w]:
                    earliest[w] = place
        for name, (_, (doc, start)) in group.items():
            offsets = [off for off, w in enumerate(own[name]) if earliest[w] != (doc, start + off)]
            if offsets:
                yield name, merged(offsets, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple, tuple] = {}
        now = None
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            out = []
            for *name, words, doc, start in zip(*(batch[c].to_pylist() for c in (*_KEY, "words", "doc_id", "start")), strict=True):
                if name[0] != now:
                    out += lost(group)
                    group, now = {}, name[0]
                group[tuple(name)] = words, (doc, start)
            yield _spans(out, kind)
        yield _spans(list(lost(group)), kind)

    return run


def _spans(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = [pa.array([name[k] for name, _ in rows], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays([*names, pa.array([rel for _, rel in rows], kind)], [*_KEY, "rel"])


def _window_rows(width: int):
    """(h1, h2, g, u, v, doc_id, start, off): every window of each stretch by the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [windows(words, width) for words in batch["words"].to_pylist()]
            n = np.array([len(w) for w in every], np.int64)
            of = pa.array(np.repeat(np.arange(len(n)), n))
            h1, h2 = digests([w for part in every for w in part])
            off = pa.array((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))
            columns = [h1, h2, *(batch[c].take(of) for c in (*_KEY, "doc_id", "start")), off]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", *_KEY, "doc_id", "start", "off"])

    return run


class SubstringIndex:
    """Runs, segments and a manifest below one folder, which any session can open again. `add` takes a batch in and tells which words it loses.

    Batches come in ascending doc_ids: one whose smallest doc_id stands before the greatest of earlier batches is refused. Rows without a doc_id are not
    held to it; they come last in their own batch. One writer at a time; a batch that fails leaves the index as it was."""

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch(spark, "substring-index")
        self._manifest = Manifest(spark, self.path)
        state = self._manifest.read() or {"width": width, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "segments": [], "last": None}
        if state["width"] != width:
            raise ValueError(f"the index holds windows of {state['width']} words")
        self.width, self.buckets, self.last = width, state["buckets"], state["last"]
        self.runs: list[str] = state["runs"]
        self.segments: list[str] = state["segments"]

    def _save(self) -> None:
        self._manifest.write({"width": self.width, "buckets": self.buckets, "runs": self.runs, "segments": self.segments, "last": self.last})

    def _run(self, name: str) -> DataFrame:
        """A run by its name; a session that doesn't know it yet learns of its buckets."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (g BIGINT, m BIGINT) USING parquet CLUSTERED BY (g) SORTED BY (g) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _written_run(self, rows: DataFrame) -> str:
        """A sorted, bucketed table of (g, m); rows: one for each fingerprint."""
        name = f"granary_run_{uuid.uuid4().hex}"
        try:
            rows.write.bucketBy(self.buckets, "g").sortBy("g").option("path", f"{self.path}/{name}").saveAsTable(name)
        except Exception:
            self._forget([name])
            raise
        return name

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{self.path}/{name}")

    def compact(self) -> None:
        """All runs as one; drops nothing."""
        if len(self.runs) < 2:
            return
        rows = self._run(self.runs[0])
        for name in self.runs[1:]:
            rows = rows.unionByName(self._run(name))
        old, self.runs = self.runs, [self._written_run(rows.groupBy("g").agg(F.sum("m").alias("m")))]
        self._save()
        self._forget(old)

    def drop(self) -> None:
        """Deletes the index."""
        self._forget(self.runs)
        remove(self.spark, self.path)
        self.runs, self.segments, self.last = [], [], None

    def _hits(self, fresh: DataFrame) -> DataFrame:
        """The fingerprints that the batch's run shares with history or itself."""
        hits = fresh.where("m > 1").select("g")
        for run in self.runs:  # bucket by bucket: neither side is shuffled
            hits = hits.unionByName(fresh.where("m = 1").join(self._run(run).select("g"), "g", "left_semi").select("g"))
        return settled(hits.distinct() if len(self.runs) > 1 else hits, "substring-hits")

    def add(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Adds docs (doc_id, text) to the index; (doc_id, spans): of its documents the words that they lose.

        history: the documents of all earlier batches; it must be given if there are any. No document of a batch may stand
        before one of an earlier batch."""
        if self.segments and history is None:
            raise ValueError("the index holds earlier batches: their documents are needed to verify hits")
        segment = f"segment-{uuid.uuid4().hex}"
        read = lambda *names: self.spark.read.schema(_ROWS).parquet(*(f"{self.path}/{n}" for n in names))
        shipped(docs).mapInArrow(_stretch_rows(self.width), _ROWS).write.parquet(f"{self.path}/{segment}")
        run = None
        try:
            lo, hi = read(segment).where(F.col("doc_id") < NO_ID).agg(F.min("doc_id"), F.max("doc_id")).first()
            if lo is not None and self.last is not None and lo < self.last:
                raise ValueError(f"document {lo} stands before document {self.last} of an earlier batch")
            run = self._written_run(read(segment).groupBy("g").agg(F.count("*").alias("m")))
            spans = self._lost(docs, history, read(segment).withColumn("fresh", F.lit(True)), read, self._run(run))
        except Exception:
            self._forget([run] if run else [])
            remove(self.spark, f"{self.path}/{segment}")
            raise
        self.runs.append(run)
        self.segments.append(segment)
        self.last = hi if self.last is None or hi is not None and hi > self.last else self.last
        self._save()
        if len(self.runs) >= FANOUT:
            self.compact()
        return spans

    def _lost(self, docs: DataFrame, history: DataFrame | None, batch: DataFrame, read: Callable, fresh: DataFrame) -> DataFrame:
        """(doc_id, spans) of a batch, whose stretches and run are written, against itself and history."""
        width, hits = self.width, self._hits(fresh)
        log = read(*self.segments).withColumn("fresh", F.lit(False)).unionByName(batch) if self.segments else batch
        known = key_filter(hits, "g")
        met = settled((log if known is None else passing(log, known, "g")).join(hits, "g"), "substring-met")
        place = F.min(F.struct("doc_id", "start")).alias("first")
        whole = settled(met.groupBy(*_KEY).agg(place, F.first("n").alias("n"), F.count("*").alias("copies")), "substring-whole")
        texts = docs if history is None else docs.unionByName(history)
        rel = self._different(whole, texts)
        judged = whole.join(rel, _KEY, "left").where("copies > 1 OR rel IS NOT NULL").select(*_KEY, "first", "rel")
        judged = settled(judged, "substring-judged")
        start = F.col("start")
        all_of_it = F.array(F.struct(start.alias("a"), (start + F.col("n") + width - 1).alias("b")))
        moved = F.transform("rel", lambda x: F.struct((start + x["a"]).alias("a"), (start + x["b"]).alias("b")))
        is_first = (F.col("doc_id") == F.col("first.doc_id")) & (start == F.col("first.start"))
        mine = met.where("fresh").drop("fresh").join(judged, _KEY)
        spans = mine.select("doc_id", F.when(is_first, moved).otherwise(all_of_it).alias("s")).where("s IS NOT NULL")
        spans = settled(spans.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_set("s"))).alias("spans")), "substring-lost")
        discard(hits, met, whole, judged, rel)
        return spans

    def _different(self, whole: DataFrame, texts: DataFrame) -> DataFrame:
        """(g, u, v, rel): of stretches whose fingerprint others share, the words that start earlier in one of those."""
        kinds = settled(whole.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"), "substring-kinds")
        open_ = settled(whole.join(kinds, "g").select("first.doc_id", "first.start", "n", *_KEY, "kinds"), "substring-open")
        side = settled(open_.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", *_KEY)).alias("asked")), "substring-asked")
        known = key_filter(side, "doc_id")
        asked = (texts if known is None else passing(texts, known, "doc_id")).join(side, "doc_id")
        # a copy of a doc_id may answer as well, with the same words
        words = asked.mapInArrow(_words_of(self.width), _PIECE)
        put = settled(words.join(open_, _KEY).select(*_KEY, "words", "doc_id", "start", "kinds"), "substring-words")
        few = put.where(F.col("kinds") <= MOST).repartition("g").sortWithinPartitions("g")
        rel = few.mapInArrow(_compared(self.width), _SPANS)
        many = put.where(F.col("kinds") > MOST)
        if not many.isEmpty():
            rows = settled(
                many.mapInArrow(_window_rows(self.width), "h1 long, h2 long, g long, u long, v long, doc_id long, start int, off int"),
                "substring-windows"
            )
            at = F.struct("doc_id", (F.col("start") + F.col("off")).alias("at"))
            first = rows.groupBy("h1", "h2").agg(F.min(at).alias("e"), F.max(at).alias("last")).where("e <> last").select("h1", "h2", "e")
            late = rows.join(settled(first, "substring-first"), ["h1", "h2"]).where(at != F.col("e"))
            span = F.struct(F.col("off").alias("a"), (F.col("off") + self.width).alias("b"))
            rel = rel.unionByName(late.groupBy(*_KEY).agg(F.sort_array(F.collect_set(span)).alias("rel")))
        rel = settled(rel, "substring-rel")
        discard(kinds, open_, side, put)
        return rel

    def dedup(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Adds docs; doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
        rows = keyed(docs)
        past = None if history is None else keyed(history).select("doc_id", "text")
        return self._cleaned(rows, self.add(rows.select("doc_id", "text"), past))

    def _cleaned(self, docs: DataFrame, side: DataFrame) -> DataFrame:
        known = key_filter(side, "doc_id")
        if known is None:
            return docs.join(side, "doc_id", "left").mapInArrow(_kept, _KEPT)
        hit = passing(docs, known, "doc_id").join(side, "doc_id", "left").mapInArrow(_kept, _KEPT)
        rest = passing(docs, known, "doc_id", hits=False).withColumn("spans", F.lit(None).cast(side.schema["spans"].dataType))
        return hit.unionByName(rest.mapInArrow(_kept, _KEPT))


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "replace").split()
            n_words.append(len(words))
            if spans:
                gone = np.zeros(len(words) + 1, np.int64)
                for x in spans:
                    gone[min(x["a"], len(words))] += 1
                    gone[min(x["b"], len(words))] -= 1
                stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                n_removed.append(len(words) - len(stay))
                words = [words[i] for i in stay.tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        columns = [batch["own_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def report(docs: DataFrame, width: int = WIDTH, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: the table as batches of ascending doc_ids into a new index, then compacted."""
    rows = keyed(docs)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0], 1000)).first()[0] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    index, spans = SubstringIndex(docs.sparkSession, width=width), None
    try:
        for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
            part = rows if lo is None else rows.where(F.col("doc_id") > lo)
            part = part if hi is None else part.where(F.col("doc_id") <= hi)
            history = None if lo is None else rows.where(F.col("doc_id") <= lo).select("doc_id", "text")
            new = index.add(part.select("doc_id", "text"), history)
            spans = new if spans is None else spans.unionByName(new)
        index.compact()
    finally:
        index.drop()  # all that is lost is written by now
    out = index._cleaned(rows, settled(spans, "substring-all-lost"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, p, sha256(array_to_string(ws[p:p + 19], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)),
lost AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM lost)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w),
kept AS (SELECT a.doc_id, count(*) AS k, string_agg(word, ' ' ORDER BY a.q) AS s
         FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.q = g.q WHERE g.q IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
