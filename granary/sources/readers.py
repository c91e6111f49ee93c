"""Scans with fixed schemas: CSV system tables, JDBC, audit files, job runs, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: All-string layouts of the system tables.
SYSTEM_TABLES = {
    "tables": "id name description ishidden modifiedtime structuremodifiedtime datacategory lineagetag",
    "columns": "id tableid explicitname inferredname explicitdatatype datatype datacategory description ishidden state isunique iskey "
    "isnullable sourcecolumn expression formatstring sortbycolumnid modifiedtime lineagetag",
    "measures": "id tableid name description datatype expression formatstring ishidden modifiedtime",
    "partitions": "id tableid name description querydefinition state type mode dataview modifiedtime refreshedtime",
    "storage": "dimension_name table_id column_id attribute_name datatype dictionary_size column_type dictionary_isresident "
    "dictionary_temperature dictionary_last_accessed isrowstoreindexed",
}
FACILITY = (
    "FacilityID long, FacilityName string, PrimaryCategory string, SubCategories string, Address string, City string, State "
    "string, ZipCode string, County string, Phone string, Email string, Website string, Hours string, WalkInAvailable string, "
    "AppointmentRequired string, AcceptsChildren string, EligibilityCriteria string, Languages string, Cost string, Capacity "
    "string, IntakeProcess string, Notes string, LastVerifiedDate date, VerifiedBy string"
)
NOMINATION = (
    "nominee_name string, nominee_dept string, nomination_period string, nominator_name string, impact_q1 string, impact_q2 "
    "string, consistency string, collaboration string, initiative string, `values` string, client_impact string, submission_time "
    "timestamp"
)
JOB_RUN = "run_id long, job_id string, step_id int, run_status int, run_date int, run_time int, run_duration int, message string"


def system_schema(name: str) -> str:
    return ", ".join(f"{c} string" for c in SYSTEM_TABLES[name].split())


def read_system_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def load_system_tables(spark: SparkSession, folder: str, model: str | None = None) -> dict[str, DataFrame]:
    """The system tables of one model; with its name as model_name where it is given."""
    out = {n: read_system_csv(spark, f"{folder}/{n}.csv", system_schema(n)) for n in SYSTEM_TABLES}
    out["storage"] = out["storage"].where("column_type = 'BASIC_DATA'")
    return {n: df.withColumn("model_name", F.lit(model)) for n, df in out.items()} if model is not None else out


def jdbc_full(
    spark: SparkSession, options: dict[str, str], source: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1
) -> DataFrame:
    """A table or a parenthesised query; with a numeric key it is read in parts."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", f"({source}) t" if " " in source else source)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def jdbc_incremental(spark: SparkSession, options: dict[str, str], source: str, watermark: str, cutoff, **split) -> DataFrame:
    """Rows past the cutoff (a value of the column's kind or its text). The column's own type makes the literal, and Spark pushes the
    comparison to the source."""
    rows = jdbc_full(spark, options, source, **split)
    name = watermark.strip('"')
    return rows.where(F.col(name) > F.lit(cutoff).cast(rows.schema[name].dataType))


def read_audit_blobs(spark: SparkSession, folder: str, record_type: int = 21, schema: str | None = None) -> DataFrame:
    """Files that each hold a JSON array of events; a broken file is an error, not an empty result."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(folder).where(F.col("RecordType") == record_type)


#: Audit events in files: texts, but for two codes.
AUDIT_EVENT = ", ".join(
    f"{c} string" for c in (
        "Id CreationTime Operation OrganizationId UserKey Workload UserId ClientIP UserAgent Activity ItemName WorkSpaceName DatasetName DatasetId ReportName "
        "ReportId ReportType WorkspaceId ObjectId IsSuccess RequestId ActivityId DistributionMethod ConsumptionMethod AppId CapacityId ArtifactKind"
    ).split()
) + ", RecordType int, UserType int"
BROKEN = "_corrupt_record"


def split_events(rows: DataFrame, record_type: int = 21) -> tuple[DataFrame, DataFrame]:
    """Events of a record type, and (file_name, reason, content, with_id) of files that are no JSON events; with_id: broken records that still have an id. rows: AUDIT_EVENT, _corrupt_record, file_name."""
    good = rows.where(F.col(BROKEN).isNull() & (F.col("RecordType") == record_type)).drop(BROKEN, "file_name")
    bad = rows.where(F.col(BROKEN).isNotNull()).groupBy("file_name").agg(
        F.min(F.substring(BROKEN, 1, 1000)).alias("content"), F.count("Id").alias("with_id")  # Spark wants a column beside the corrupt record's
    )
    return good, bad.select("file_name", F.lit("not a JSON array of events").alias("reason"), "content", "with_id")


def split_audit_blobs(spark: SparkSession, folder: str, record_type: int = 21) -> tuple[DataFrame, DataFrame]:
    """The events of a folder's files, and its broken files with their reason: a broken file keeps no other from being read."""
    reader = spark.read.schema(f"{AUDIT_EVENT}, {BROKEN} string").option("multiLine", True).option("mode", "PERMISSIVE")
    return split_events(reader.json(folder).withColumn("file_name", F.col("_metadata.file_path")), record_type)


def read_job_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(JOB_RUN).parquet(folder)


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=FACILITY, header=True, multiLine=True, escape='"')


def read_nominations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOMINATION).json(path)


def dev_sample(df: DataFrame, fraction: float, seed: int, private: tuple[str, ...] = (), salt: str = "") -> DataFrame:
    """A seeded sample with listed columns replaced by salted hashes."""
    return df.sample(fraction, seed).withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in private})
