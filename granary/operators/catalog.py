"""Semantic-model catalog, lakehouse catalog and lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.exprs import row_hash, union_typed

from .tables import Layout, Table


def _norm(c) -> Column:
    return F.upper(F.trim(c))


def flag(c: str) -> Column:
    """Text booleans of system tables, parsed once."""
    return F.when(F.lower(c) == "true", F.lit(True)).when(F.lower(c) == "false", F.lit(False))


def metadata_master(columns: DataFrame, tables: DataFrame, measures: DataFrame, storage: DataFrame) -> DataFrame:
    """Columns with table and storage figures, and measures with their table, in one frame."""
    t = tables.select(F.col("id").alias("tableid"), F.col("name").alias("table_name"))
    s = storage.where("column_type = 'BASIC_DATA'").groupBy(_norm("dimension_name").alias("st"), _norm("attribute_name").alias("sc")).agg(
        F.max(F.col("dictionary_size").try_cast("long")).alias("dictionary_size")
    )
    c = columns.join(t, "tableid", "left")
    c = c.join(s, (_norm("table_name") == F.col("st")) & (_norm("explicitname") == F.col("sc")), "left")
    cols = c.select(
        "table_name", F.col("explicitname").alias("object_name"), F.lit("COLUMN").alias("object_type"), "sourcecolumn", "datatype",
        flag("ishidden").alias("is_hidden"), flag("iskey").alias("is_key"), "dictionary_size"
    )
    meas = measures.join(t, "tableid", "left").select(
        "table_name", F.col("name").alias("object_name"), F.lit("MEASURE").alias("object_type"), "expression",
        flag("ishidden").alias("is_hidden")
    )
    return union_typed(cols, meas)


_TYPES = {"Int64": "bigint", "String": "string", "Double": "double", "DateTime": "timestamp", "Boolean": "boolean"}


def metadata_full(master: DataFrame, lineage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Model objects with their lakehouse column and how the two agree."""
    line = lineage.select(_norm("sem_table_name").alias("ln"), "lh_layer", "lh_table_name", "relationship")
    lake = catalog.select(
        "layer", _norm("table_name").alias("ct"), _norm("column_name").alias("cc"), F.col("data_type").alias("lh_data_type"),
        "table_row_count"
    )
    j = master.join(line, _norm("table_name") == F.col("ln"), "left")
    j = j.join(lake, (_norm("lh_table_name") == F.col("ct")) & (_norm("sourcecolumn") == F.col("cc")) & (F.col("lh_layer") == F.col("layer")), "left")
    want = F.create_map(*(F.lit(x) for kv in _TYPES.items() for x in kv))[F.col("datatype")]
    alignment = F.when(F.col("object_type") != "COLUMN", None).when(
        F.col("lh_data_type").isNull(), "NOT_IN_LAKEHOUSE"
    ).when(F.lower("lh_data_type") == want, "TYPE_MATCH").otherwise("TYPE_MISMATCH")
    out = j.withColumns(
        {"alignment": alignment, "has_lineage": F.col("ln").isNotNull(), "in_lakehouse": F.col("cc").isNotNull()}
    ).drop("ln", "ct", "cc", "layer")
    return out.withColumn("_row_hash", row_hash(["table_name", "object_name", "object_type", "lh_table_name", "alignment"], null="~"))


def lineage_master(
    columns: DataFrame, tables: DataFrame, measures: DataFrame, storage: DataFrame, lineage: DataFrame, catalog: DataFrame, model: str, at: Column
) -> DataFrame:
    """The master table of 31 columns: model objects (columns and measures) with their storage, lineage and lakehouse column, and how types agree.

    Storage is found by table and column; a type agrees by its lakehouse name; measures have no lakehouse column and no alignment of types."""
    t = tables.select(F.col("id").alias("tableid"), F.col("name").alias("sem_table_name"), F.col("description").alias("table_description"))
    s = storage.where("column_type = 'BASIC_DATA'").groupBy(_norm("dimension_name").alias("st"), _norm("attribute_name").alias("sc")).agg(
        F.max(F.col("dictionary_size").try_cast("long")).alias("sem_storage_bytes"), F.max(F.col("rows_count").try_cast("long")).alias("sem_storage_rows")
    )
    c = columns.join(t, "tableid", "left")
    c = c.join(s, (_norm("sem_table_name") == F.col("st")) & (_norm("explicitname") == F.col("sc")), "left")
    shared = lambda kind: (F.lit(model).alias("model_name"), F.lit("SemanticModel").alias("source_system"), F.lit(kind).alias("object_type"))
    cols = c.select(
        *shared("COLUMN"), "sem_table_name", F.col("explicitname").alias("sem_column_name"), F.col("datatype").alias("sem_data_type"),
        F.col("columntype").alias("sem_column_type"), F.col("encodingtype").alias("sem_encoding_type"), flag("ishidden").alias("sem_is_hidden"),
        flag("iskey").alias("sem_is_key"), flag("isavailableinmdx").alias("sem_is_mdx"), "table_description", "sem_storage_bytes", "sem_storage_rows",
        F.col("sourcecolumn").alias("__source")
    )
    meas = measures.join(t.drop("table_description"), "tableid", "left").select(
        *shared("MEASURE"), "sem_table_name", F.col("name").alias("sem_column_name"), F.lit("MEASURE_EXPRESSION").alias("sem_data_type"),
        F.lit("Calculated").alias("sem_column_type"), flag("ishidden").alias("sem_is_hidden")
    )
    line = lineage.select(_norm("sem_table_name").alias("__line"), "lh_layer", "lh_table_name", "relationship")
    lake = catalog.select(
        F.col("layer").alias("__layer"), _norm("table_name").alias("__table"), _norm("column_name").alias("__column"), "lakehouse_name",
        F.col("column_name").alias("lh_column_name"), F.col("data_type").alias("lh_data_type"), F.col("is_nullable").alias("lh_is_nullable"), "is_partition_col",
        F.col("table_row_count").alias("lh_table_row_count"), "last_modified", "last_operation", "last_modified_by"
    )
    j = union_typed(cols, meas).join(line, _norm("sem_table_name") == F.col("__line"), "left")
    j = j.join(
        lake, (_norm("lh_table_name") == F.col("__table")) & (_norm("__source") == F.col("__column")) & (F.col("lh_layer") == F.col("__layer")), "left"
    )
    want = F.create_map(*(F.lit(x) for kv in _TYPES.items() for x in kv))[F.col("sem_data_type")]
    alignment = F.when(F.col("object_type") != "COLUMN", None).when(F.col("lh_column_name").isNull(), "NOT_IN_LAKEHOUSE").when(
        F.lower("lh_data_type") == want, "TYPE_MATCH"
    ).otherwise("TYPE_MISMATCH")
    out = j.withColumns({
        "data_type_alignment": alignment, "has_lakehouse_mapping": F.col("lh_column_name").isNotNull(),
        "has_lineage_mapping": F.col("lh_table_name").isNotNull(), "_master_built_at": at,
        "_row_hash": row_hash(["model_name", "sem_table_name", "sem_column_name", "lh_table_name"], null="~"),
    })
    return out.drop("__source", "__line", "__layer", "__table", "__column")


def table_list(catalog: DataFrame) -> DataFrame:
    """Each table of the catalog once, with its columns counted."""
    return catalog.groupBy("layer", "table_name").agg(F.count("*").alias("columns"), F.max("table_row_count").alias("rows")).orderBy("layer", "table_name")


def profile_targets(full: DataFrame) -> DataFrame:
    """Mapped physical columns."""
    return full.where(
        "in_lakehouse AND object_type = 'COLUMN' AND lh_table_name IS NOT NULL AND sourcecolumn IS NOT NULL"
    ).select("lh_table_name", F.trim("sourcecolumn").alias("column_name")).distinct()


def objects_by_type(master: DataFrame) -> DataFrame:
    return master.groupBy("table_name", "object_type").agg(F.count("*").alias("objects"))


def measure_list(measures: DataFrame, tables: DataFrame) -> DataFrame:
    t = tables.select(F.col("id").alias("tableid"), F.col("name").alias("table_name"))
    return measures.join(t, "tableid", "left").select(
        "table_name", F.col("name").alias("measure_name"), "expression"
    ).orderBy("table_name", "measure_name")


def largest_columns(master: DataFrame, n: int = 20) -> DataFrame:
    return master.where("object_type = 'COLUMN'").orderBy(
        F.desc_nulls_last("dictionary_size"), "object_name"
    ).limit(n).select("table_name", "object_name", "dictionary_size")


def hidden_objects(master: DataFrame) -> DataFrame:
    return master.where("is_hidden").select("table_name", "object_name", "object_type")


def partition_list(partitions: DataFrame, tables: DataFrame) -> DataFrame:
    t = tables.select(F.col("id").alias("tableid"), F.col("name").alias("table_name"))
    return partitions.join(t, "tableid", "left").select("table_name", F.col("name").alias("partition_name"), "mode")


def catalog_summary(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("layer").agg(F.count_distinct("table_name").alias("tables"), F.count("*").alias("columns"))


def orphans(full: DataFrame) -> DataFrame:
    return full.where("object_type = 'COLUMN' AND NOT has_lineage").select("table_name", "object_name")


def type_mismatches(full: DataFrame) -> DataFrame:
    return full.where("alignment = 'TYPE_MISMATCH'").select("table_name", "object_name", "datatype", "lh_data_type")


def coverage(full: DataFrame) -> DataFrame:
    return full.groupBy("object_type", "lh_layer").agg(F.count("*").alias("objects"), F.count_if("in_lakehouse").alias("mapped"))


def largest_tables(master: DataFrame, n: int = 15) -> DataFrame:
    return master.groupBy("table_name").agg(F.sum("dictionary_size").alias("bytes")).orderBy(F.desc_nulls_last("bytes"), "table_name").limit(n)


def lakehouse_catalog(spark: SparkSession, layers: dict[str, str], counts: bool = True) -> DataFrame:
    """One row for each column of each table of the layers' databases; row counts come from one union-all job."""
    rows, sizes = [], None
    for layer, db in layers.items():
        for t in spark.catalog.listTables(db):
            ref = t.name if t.isTemporary else f"{db}.{t.name}"
            for c in spark.catalog.listColumns(ref):
                rows.append((layer, db, ref, t.name, t.tableType, c.name, c.dataType, c.nullable, c.description, c.isPartition, c.isBucket))
            if counts:
                one = spark.table(ref).agg(F.count("*").alias("table_row_count")).withColumn("full_table_ref", F.lit(ref))
                sizes = one if sizes is None else sizes.unionByName(one)
    out = spark.createDataFrame(
        rows,
        "layer string, lakehouse_name string, full_table_ref string, table_name string, table_type string, column_name string, "
        "data_type string, is_nullable boolean, column_description string, is_partition_col boolean, is_bucket_col boolean"
    )
    return out.join(sizes, "full_table_ref", "left") if sizes is not None else out.withColumn("table_row_count", F.lit(None).cast("long"))


def information_schema(named: dict[str, DataFrame]) -> DataFrame:
    """Column rows rebuilt from schemas: ordinal, nullability, precision and scale."""
    spark = next(iter(named.values())).sparkSession
    rows = []
    for t, df in sorted(named.items()):
        for i, f in enumerate(df.schema, 1):
            kind = f.dataType
            rows.append(
                (
                    t, f.name, i, kind.simpleString(), "YES" if f.nullable else "NO", getattr(kind, "precision", None),
                    getattr(kind, "scale", None)
                )
            )
    return spark.createDataFrame(
        rows,
        "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, numeric_precision int, "
        "numeric_scale int"
    ).orderBy("table_name", "ordinal_position")


def save_system_tables(named: dict[str, DataFrame], table_of: Callable[[str], Table], model: str) -> None:
    """Each system table with its model's name beside the other models' rows; a model that is saved again replaces its own folder only."""
    for name, df in named.items():
        rows, target = df.withColumn("model_name", F.lit(model)), table_of(f"system_{name}")
        Table(df.sparkSession, target.root, Layout(("model_name",))).overwrite(rows)
