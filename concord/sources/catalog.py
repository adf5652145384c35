"""Reading catalogs: columns, keys, foreign keys, views and row counts keyed by submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import names, vocab
from concord.session import local_table

# Spark's own type names in catalog spelling.
SPARK_TYPES = {"string": "varchar", "double": "float", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def prepare_columns(
    raw: DataFrame,
    compat: bool = False,
    plain: bool = False,
    aliases: dict[str, str] | None = None,
    stage_prefix_only: bool = False,
    table_aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Column catalog without system and stage tables, with cleaned table names and aliased columns."""
    table = F.col("original_name")
    cleaned = names.clean_table_plain(table) if plain else names.clean_table(table, compat)
    if table_aliases:
        cleaned = F.upper(names.alias(cleaned, table_aliases))
    column = names.alias("column_name", aliases) if aliases else F.col("column_name")
    return raw.filter(~names.is_system(table) & ~names.is_stage(table, stage_prefix_only)).select(
        "submission_id", "original_name", cleaned.alias("cleaned_name"), "ordinal",
        column.alias("column_name"), "data_type",
    )


def prepare_rows_early(raw: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """The earlier cleaning: numbered tables are dropped, tables and columns both aliased."""
    table = F.col("original_name")
    return raw.filter(~names.is_stage(table) & ~table.rlike(r"^\d+\.")).select(
        "submission_id", names.alias(table, aliases).alias("table_name"), "ordinal",
        names.alias("column_name", aliases).alias("column_name"), "data_type",
    )


def columns_of(tables: dict[str, DataFrame], submission_id: str) -> DataFrame:
    """Column catalog rows of tables at hand, from their schemas alone (no rows are read)."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (submission_id, table, n, f.name, SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()))
        for table, df in tables.items()
        for n, f in enumerate(df.schema.fields, 1)
    ]
    return local_table(
        spark, rows, "submission_id string, original_name string, ordinal int, column_name string, data_type string"
    )


def read_submission_folder(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet files under ``path`` with the submission id taken from each file's name."""
    reader = spark.read.option("recursiveFileLookup", "true")
    df = (reader.schema(schema) if schema else reader).parquet(path)
    return df.withColumn("submission_id", names.submission_id("_metadata.file_path"))


def jdbc_reader(spark: SparkSession, url: str, properties: dict[str, str]):
    """One reader for the catalog queries of a live database."""
    return lambda query: spark.read.jdbc(url, f"({query}) q", properties=properties)


def keys_from_constraints(constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Primary key columns in key order: constraints joined with their key usage."""
    return (
        constraints.filter(F.col("constraint_type") == "PRIMARY KEY")
        .join(key_usage, ["submission_id", "constraint_name"])
        .select(
            "submission_id", F.col("constraint_name").alias("pk_name"), F.col("table_name").alias("original_name"),
            "column_name", F.col("ordinal_position").alias("position"),
        )
    )


def fks_from_system_tables(fks: DataFrame, fk_columns: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign key columns by name from the system tables of a database.

    ``fks`` (submission_id, fk_name, fk_id, parent_id, ref_id), ``fk_columns`` (submission_id,
    fk_id, ordinal, parent_column_id, ref_column_id), ``tables`` (submission_id, table_id, name),
    ``columns`` (submission_id, table_id, column_id, name).
    """
    def table(side: str) -> DataFrame:
        return tables.filter(~names.is_system("name")).select("submission_id", F.col("table_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_table"))

    def column(side: str, out: str) -> DataFrame:
        return columns.select("submission_id", F.col("table_id").alias(f"{side}_id"), F.col("column_id").alias(f"{side}_column_id"), F.col("name").alias(out))

    return (
        fks.join(table("parent"), ["submission_id", "parent_id"]).join(table("ref"), ["submission_id", "ref_id"])
        .join(fk_columns, ["submission_id", "fk_id"])
        .join(column("parent", "fk_column"), ["submission_id", "parent_id", "parent_column_id"])
        .join(column("ref", "pk_column"), ["submission_id", "ref_id", "ref_column_id"])
        .select("submission_id", "fk_name", "parent_table", "fk_column", "ref_table", "pk_column", "ordinal")
    )


def relationships(fks: DataFrame) -> DataFrame:
    """Distinct (parent, referenced) tables per submission."""
    return fks.select("submission_id", "parent_table", "ref_table").distinct()


def only_base_tables(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of tables listed as base tables."""
    base = tables.filter(F.col("table_type") == "BASE TABLE").select("submission_id", "original_name")
    return columns.join(base, ["submission_id", "original_name"], "left_semi")


def drop_empty_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables that have at least one column."""
    return tables.join(columns, ["submission_id", "original_name"], "left_semi")


def ordered(position: str, value: str) -> Column:
    """Aggregate: the values of ``value`` in order of ``position``."""
    pairs = F.array_sort(F.collect_list(F.struct(position, value)))
    return F.transform(pairs, lambda p: p[value])


def fold_keys(keys: DataFrame, by: list[str]) -> DataFrame:
    """Key columns per table as one array in key order."""
    return keys.groupBy(*by).agg(ordered("position", "column_name").alias("pk"))


def fold_fks(flat: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Composite foreign keys as one row each, their columns in key order."""
    lead = ["submission_id"] if by is None else by
    return flat.groupBy(*lead, "fk_name", "parent_table", "ref_table").agg(
        ordered("ordinal", "fk_column").alias("parent_cols"), ordered("ordinal", "pk_column").alias("ref_cols")
    )


def fk_info(flat: DataFrame) -> DataFrame:
    """Foreign keys with their column lists as comma-joined text."""
    return fold_fks(flat).select(
        "submission_id", "fk_name", "parent_table", "ref_table",
        F.concat_ws(",", "parent_cols").alias("fk_columns"), F.concat_ws(",", "ref_cols").alias("pk_columns"),
    )


def read_fk_info(info: DataFrame) -> DataFrame:
    """Foreign keys back from text; rows with an empty field are skipped."""
    filled = [F.coalesce(F.length(c), F.lit(0)) > 0 for c in ("parent_table", "ref_table", "fk_columns", "pk_columns")]
    return info.filter(filled[0] & filled[1] & filled[2] & filled[3]).select(
        "submission_id", "fk_name", "parent_table", "ref_table",
        F.split("fk_columns", ",").alias("parent_cols"), F.split("pk_columns", ",").alias("ref_cols"),
    )


def clean_fk_names(flat: DataFrame) -> DataFrame:
    """Foreign keys without numbering in table, column and constraint names."""
    return flat.withColumns({
        "fk_name": names.clean_constraint("fk_name"),
        "parent_table": names.clean_fk_table("parent_table"),
        "ref_table": names.clean_fk_table("ref_table"),
        "fk_column": names.clean_fk_column("fk_column"),
        "pk_column": names.clean_fk_column("pk_column"),
    })


def view_shapes(queries: dict[str, DataFrame]) -> DataFrame:
    """Number of columns and rows of named queries."""
    out = None
    for name, df in queries.items():
        row = df.agg(F.count(F.lit(1)).alias("num_rows")).select(
            F.lit(name).alias("view_name"), F.lit(len(df.columns)).alias("num_columns"), "num_rows"
        )
        out = row if out is None else out.unionByName(row)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table: partial counts per scan partition, summed."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("original_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


def attach_by_name(schema: DataFrame, facts: DataFrame, name: str = "original_name") -> tuple[DataFrame, DataFrame]:
    """Facts joined to tables by exact name, else by trimmed upper-case name, and the facts left over.

    ``schema`` has one row per (submission_id, original_name); where several tables share the
    looser spelling the first by name takes the facts.
    """
    loose = F.upper(F.trim(F.col(name)))
    tables = schema.select("submission_id", F.col("original_name").alias("_exact")).distinct()
    by_loose = tables.groupBy("submission_id", F.upper(F.trim("_exact")).alias("_loose")).agg(F.min("_exact").alias("_near"))
    found = (
        facts.withColumn("_loose", loose)
        .join(tables.withColumn(name, F.col("_exact")), ["submission_id", name], "left")
        .join(by_loose, ["submission_id", "_loose"], "left")
        .withColumn("table_name", F.coalesce("_exact", "_near"))
        .drop("_loose", "_exact", "_near")
    )
    return found.filter("table_name is not null"), found.filter("table_name is null").drop("table_name")


def fold_schema(columns: DataFrame) -> DataFrame:
    """One row per (submission, cleaned table): first original name, ordered columns, name collisions."""
    entry = F.struct("original_name", "ordinal", F.col("column_name").alias("name"), F.col("data_type").alias("type"))
    return columns.groupBy("submission_id", "cleaned_name").agg(
        F.min("original_name").alias("original_name"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda c: F.struct(c["name"], c["type"])).alias("cols"),
        (F.min("original_name") != F.max("original_name")).alias("collision"),
    )


def statistics(columns: DataFrame, keys: DataFrame, fks: DataFrame) -> DataFrame:
    """Per submission: tables, columns, tables with a key, tables with foreign keys, relationships (a key of several columns is one)."""
    cols = columns.groupBy("submission_id").agg(
        F.count_distinct("cleaned_name").alias("tables"), F.count(F.lit(1)).alias("columns")
    )
    pk = keys.groupBy("submission_id").agg(F.count_distinct("original_name").alias("tables_with_pk"))
    fk = fks.groupBy("submission_id").agg(
        F.count_distinct("parent_table").alias("tables_with_fk"), F.count_distinct("fk_name", "parent_table", "ref_table").alias("relationships")
    )
    return (
        cols.join(pk, "submission_id", "left").join(fk, "submission_id", "left")
        .na.fill(0, ["tables_with_pk", "tables_with_fk", "relationships"])
    )


def grading_batch(df: DataFrame, answer_id: str = vocab.ANSWER_ID) -> DataFrame:
    """Distinct submissions without the answer itself."""
    return df.filter(F.col("submission_id") != answer_id).select("submission_id").distinct()


def domain_dictionary(df: DataFrame, key: str, value: str, normalised: bool) -> DataFrame:
    """Dictionary rows, trimmed and lower-cased, or fully normalised on both sides."""
    fix = names.normalize if normalised else (lambda c: F.lower(F.trim(F.col(c))))
    return df.select(fix(key).alias(key), fix(value).alias(value)).dropDuplicates([key])
