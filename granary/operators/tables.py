"""Snapshot tables on plain Parquet: replace, append, merge and their history.

Data files are written once, below `data/_v=<id>/`, the table's partition columns and its bucket, and never changed. A version is one small JSON
file that names its folders, schema and layout; `_manifest/_head` names the newest version, so a read opens two small files however many versions there
are. Two writers of one version can't both win: the second one's file exists already, which is an error.

A table may be bucketed: `_bucket`, the keys' hash modulo a number, is a stored partition column. An append adds folders. A merge rewrites only folders whose
partition values and bucket the source touches, as far as the merge's keys hold these columns. Folders are told apart by their names, no data is read for it.
Figures of what is written (rows, rows of each kind of change, watermarks) are observed while it's written.

A merge may name its batch (a stream and a number): the newest number of each stream is part of the version, and a batch that is not newer is skipped.
Partition columns are texts, integers or dates; an empty text is stored as null there. A path that is being read is never overwritten."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from granary.functions.exprs import union_typed

_MANIFEST = (
    "version int, operation string, n_rows long, folders array<string>, schema string, partition_by array<string>, bucket_by array<string>, "
    "buckets int, batches map<string,long>, at timestamp"
)
_NULL = "__HIVE_DEFAULT_PARTITION__"
BUCKET = "_bucket"


@dataclass(frozen=True)
class Layout:
    """Partition columns, and the keys whose hash makes one of so many buckets (0: none)."""

    partition_by: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0

    def columns(self) -> tuple[str, ...]:
        return (*self.partition_by, *((BUCKET,) if self.buckets else ()))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")


@dataclass
class Staged:
    """Rows that are written but not yet part of the table, and what was observed of them; n is their number."""

    folders: list[str]
    schema: StructType
    layout: Layout = Layout()
    figures: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        return self.figures.get("n", 0)


class Table:
    """A table below a folder. The layout counts when the table is made; an existing table keeps its own."""

    def __init__(self, spark: SparkSession, root: str, layout: Layout = Layout()):
        self.spark, self.root, self._new = spark, root.rstrip("/"), layout

    # --- files of the driver ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("data").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _get(self, name: str) -> str | None:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs().create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    @staticmethod
    def _file(version: int) -> str:
        return f"_manifest/v{version:09d}.json"

    # --- versions ---

    def exists(self) -> bool:
        return self._version() > 0

    def _version(self) -> int:
        """The newest version; a writer that died before it named its version is caught up with."""
        version = int(self._get("_manifest/_head") or 0)
        while self._fs().exists(self._path(self._file(version + 1))):
            version += 1
        return version

    def head(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or of the newest one."""
        text = self._get(self._file(self._version() if version is None else version))
        return json.loads(text) if text else None

    def layout(self) -> Layout:
        head = self.head()
        return Layout(tuple(head["partition_by"]), tuple(head["bucket_by"]), head["buckets"]) if head else self._new

    def history(self, n: int | None = None) -> DataFrame:
        """version, operation, n_rows, folders, schema, layout, batches, at; newest first."""
        if not self.exists():
            return self.spark.createDataFrame([], _MANIFEST)
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/_manifest").orderBy(F.desc("version"))
        return rows.limit(n) if n else rows

    def n_rows(self) -> int:
        head = self.head()
        return head["n_rows"] if head else 0

    def applied(self, stream: str, number: int) -> bool:
        """Whether this batch of a stream, or a newer one, is part of the table."""
        head = self.head()
        return bool(head) and head["batches"].get(stream, -1) >= number

    def read(self, version: int | None = None) -> DataFrame:
        row = self.head(version)
        return self._rows(row["folders"], StructType.fromJson(json.loads(row["schema"])))

    def _rows(self, folders: list[str], schema: StructType) -> DataFrame:
        """With the stored types: a partition value '01' stays a text, and columns that old files lack are nulls."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        full = StructType([*schema.fields, StructField("_v", StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*folders).select(*(f"`{c}`" for c in schema.names))

    def stage(self, df: DataFrame, layout: Layout | None = None, drop: str = "", **figures: Column) -> Staged:
        """Evaluates df once and writes it, without the column `drop`, beside the table; figures are aggregates of its rows, taken meanwhile."""
        layout = self.layout() if layout is None else layout
        schema, version = StructType([StructField(f.name, f.dataType) for f in df.schema if f.name != drop]), f"_v={uuid.uuid4().hex}"
        seen, places = Observation(), layout.columns()
        rows = df.withColumn(BUCKET, layout.bucket()) if layout.buckets else df
        rows = rows.hint("rebalance", *(F.col(c) for c in places)) if places else rows  # few files a folder, large folders in several
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in figures.items())).drop(drop)
        rows.write.partitionBy(*places).parquet(f"{self.root}/data/{version}")
        return Staged(self._leaves(version) if seen.get["n"] else [], schema, layout, seen.get)

    def _leaves(self, version: str) -> list[str]:
        """The folders of a written version that hold files: one for each partition value and bucket."""
        top = self._fs().makeQualified(self._path("data")).toString()
        files, found = self._fs().listFiles(self._path(f"data/{version}"), True), set()
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().endswith(".parquet"):
                found.add(f"{self.root}/data{path.getParent().toString().removeprefix(top)}")
        return sorted(found)

    def commit(self, staged: Staged, operation: str, keep: tuple[list[str], int] = ([], 0), batch: tuple[str, int] | None = None) -> None:
        """Makes staged rows, and the kept folders with so many rows, the newest version."""
        head = self.head()
        version = (head["version"] if head else 0) + 1
        row = {
            "version": version, "operation": operation, "n_rows": keep[1] + staged.n, "folders": [*keep[0], *staged.folders],
            "schema": staged.schema.json(), "partition_by": list(staged.layout.partition_by), "bucket_by": list(staged.layout.bucket_by),
            "buckets": staged.layout.buckets, "batches": (head["batches"] if head else {}) | (dict([batch]) if batch else {}),
            "at": dt.datetime.now(dt.timezone.utc).isoformat(),
        }
        self._put(self._file(version), json.dumps(row), overwrite=False)
        self._put("_manifest/_head", str(version), overwrite=True)

    def replace(self, df: DataFrame, operation: str = "REPLACE", partition_by: tuple[str, ...] | None = None) -> None:
        """The table's layout stays, unless other partition columns are given."""
        self.commit(self.stage(df, None if partition_by is None else Layout(tuple(partition_by))), operation)

    def stage_append(self, df: DataFrame, partition_by: tuple[str, ...] = (), **figures: Column) -> Staged:
        """Stages rows in the table's layout: columns that either side lacks are nulls there, others take the table's types."""
        head = self.head()
        if head is None:
            return self.stage(df, Layout(tuple(partition_by)) if partition_by else self._new, **figures)
        have = StructType.fromJson(json.loads(head["schema"]))
        typed = df.select(*(F.col(f"`{c}`").cast(have[c].dataType).alias(c) if c in have.names else F.col(f"`{c}`") for c in df.columns))
        return self.stage(union_typed(self.spark.createDataFrame([], have), typed), None, **figures)

    def commit_append(self, staged: Staged, batch: tuple[str, int] | None = None) -> None:
        head = self.head()
        self.commit(staged, "APPEND", (head["folders"], head["n_rows"]) if head else ([], 0), batch)

    def append(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        """Adds rows; what is there is neither read nor written again."""
        self.commit_append(self.stage_append(df, partition_by))

    def overwrite(self, df: DataFrame) -> None:
        """Replaces the partitions that the rows belong to; others stay as they are."""
        head = self.head()
        if head is None:
            return self.commit(self.stage(df), "OVERWRITE")
        staged = self.stage(df)
        gone, rest = self._touched(df, list(self.layout().partition_by), head)
        lost = self._rows(gone, staged.schema).count() if gone else 0
        self.commit(staged, "OVERWRITE", (rest, head["n_rows"] - lost))

    def compact(self) -> None:
        """The same rows as one version's folders."""
        self.replace(self.read(), "COMPACT")

    def initial_load(self, df: DataFrame, schema: StructType, partition_by: tuple[str, ...] = ()) -> None:
        self.replace(conform(df, schema), "INITIAL_LOAD", partition_by)

    def ensure(self, schema: StructType, partition_by: tuple[str, ...] = ()) -> None:
        """An empty table of the declared schema, if there is none."""
        if not self.exists():
            self.commit(Staged([], schema, Layout(tuple(partition_by)) if partition_by else self._new), "CREATE")

    def _touched(self, source: DataFrame, keys: list[str], head: dict) -> tuple[list[str], list[str]]:
        """Folders that may hold rows of the source's keys, and the others, by the folders' names."""
        layout = self.layout()
        names = list(layout.partition_by) if set(layout.partition_by) <= set(keys) else []
        columns = [F.col(f"`{c}`").cast("string").alias(c) for c in names]
        if layout.buckets and set(layout.bucket_by) <= set(keys):
            names, columns = [*names, BUCKET], [*columns, layout.bucket().cast("string").alias(BUCKET)]
        if not names:
            return head["folders"], []
        values = {tuple(x or _NULL for x in r) for r in source.select(*columns).distinct().collect()}

        def place(folder: str) -> tuple:
            parts = dict(p.split("=", 1) for p in folder.removeprefix(f"{self.root}/data/").split("/"))
            return tuple(unquote(parts[c]) for c in names)

        hit = [place(f) in values for f in head["folders"]]
        return [f for f, h in zip(head["folders"], hit, strict=True) if h], [f for f, h in zip(head["folders"], hit, strict=True) if not h]

    def merge(self, source: DataFrame, keys: list[str], hash_col: str, preserve: tuple[str, ...] = (), batch: tuple[str, int] | None = None) -> dict:
        """Upsert; returns the exact counts and a status. Several source rows of one key are an error; a replayed batch changes nothing.
        Columns that the table lacks are added."""
        none = {"inserted": 0, "updated": 0, "unchanged": 0}
        if batch and self.applied(*batch):
            return none | {"status": "REPLAYED"}
        source = source.persist()
        try:
            size = source.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.max("n").alias("most")).first()
            if not size["keys"]:
                return none | {"status": "SKIPPED"}
            if size["most"] > 1:
                raise ValueError(f"the source has several rows of one key ({', '.join(keys)})")
            head = self.head()
            if head is None:
                self.commit(self.stage(source), "INITIAL_LOAD", batch=batch)
                return none | {"inserted": size["keys"], "status": "INITIAL_LOAD"}
            touched, rest = self._touched(source, keys, head)
            rows = merged(self._rows(touched, StructType.fromJson(json.loads(head["schema"]))), source, keys, hash_col, preserve)
            kinds = {k: F.count_if(F.col("__change") == k) for k in ("INSERT", "UPDATE", "SAME")}
            staged = self.stage(rows, None, "__change", **kinds)
            seen = staged.figures
            self.commit(staged, "MERGE", (rest, head["n_rows"] + seen["INSERT"] - staged.n), batch)
            return {"inserted": seen["INSERT"], "updated": seen["UPDATE"], "unchanged": seen["SAME"], "status": "SUCCESS"}
        finally:
            source.unpersist()


def append_rows(target: DataFrame, new: DataFrame) -> DataFrame:
    return union_typed(target, new)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns, order and types of the declared schema; bad values become null."""
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def _matched(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    t, s = target.select(F.struct("*").alias("t")), source.select(F.struct("*").alias("s"))
    on = None
    for k in keys:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        on = c if on is None else on & c
    return t.join(s, on, "full_outer")


def _change(hash_col: str):
    same = F.col(f"t.{hash_col}").eqNullSafe(F.col(f"s.{hash_col}"))
    return F.when(F.col("t").isNull(), "INSERT").when(F.col("s").isNull(), "TARGET_ONLY").when(same, "SAME").otherwise("UPDATE")


def merged(target: DataFrame, source: DataFrame, keys: list[str], hash_col: str, preserve: tuple[str, ...] = ()) -> DataFrame:
    """The upserted rows and __change: INSERT, UPDATE, SAME or TARGET_ONLY. Source keys must be unique. Source columns take the target's types; those that
    the target lacks are added and come from the source wherever it has the row."""
    changed = F.col("__change").isin("INSERT", "UPDATE")
    out = []
    for f in target.schema:
        kept = F.col(f"t.{f.name}")
        if f.name not in source.columns:
            out.append(kept.alias(f.name))
            continue
        new = F.col(f"s.{f.name}").cast(f.dataType)
        out.append(F.when(F.col("t").isNull() if f.name in preserve else changed, new).otherwise(kept).alias(f.name))
    out += [F.col(f"s.{c}").alias(c) for c in source.columns if c not in target.columns]
    return _matched(target, source, keys).withColumn("__change", _change(hash_col)).select(*out, "__change")


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], hash_col: str, preserve: tuple[str, ...] = ()) -> DataFrame:
    """Null-safe upsert: a matched row changes only if its hash does; preserved columns keep the target's value."""
    return merged(target, source, keys, hash_col, preserve).drop("__change")


def merge_changes(target: DataFrame, source: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """change (INSERT, UPDATE, SAME, TARGET_ONLY) and how many rows have it."""
    return _matched(target, source, keys).groupBy(_change(hash_col).alias("change")).agg(F.count("*").alias("n"))


def staging_status(df: DataFrame | None) -> str:
    return "MISSING" if df is None else ("SKIPPED" if df.isEmpty() else "READY")


def post_merge_check(results: DataFrame) -> DataFrame:
    """results: name, staging_rows, gold_rows."""
    return results.withColumn("check", F.when(F.col("staging_rows") > F.col("gold_rows"), "CHECK").otherwise("OK"))
