"""Writers: tables with their constraints checked, joined views, documents, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright import schemas
from gridwright.operators.groups import broadcast_if_small


def create_schema(spark: SparkSession, name: str, replace: bool = False) -> None:
    """A database with all tables, empty where they are new."""
    if replace:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    there = set(tables(spark, name))
    for table in schemas.TABLES:
        if table not in there:
            schemas.empty(spark, table).write.saveAsTable(f"{name}.{table}", format="parquet")


def tables(spark: SparkSession, name: str, pattern: str = ".*") -> list[str]:
    import re

    return sorted(t.name for t in spark.catalog.listTables(name) if re.fullmatch(pattern, t.name))


def columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, column_name, position of tables or views of the session's catalogue."""
    rows = [(n, c.name, i) for n in names for i, c in enumerate(spark.catalog.listColumns(n), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")


def row_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, table_rows of tables or views of the session's catalogue."""
    out = spark.createDataFrame([], "table_name string, table_rows long")
    for n in names:
        out = out.unionByName(spark.table(n).agg(F.count("*").alias("table_rows")).select(F.lit(n).alias("table_name"), "table_rows"))
    return out


def views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """Views of the session over ``frames`` by name, in place of older ones."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def drop_views(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.catalog.dropTempView(name)


def drop_orphans(spark: SparkSession, name: str, bases: list[str]) -> list[str]:
    """Drop the tables of a database that an interrupted run left: a base table's name with a number. Returns their names; base tables stay."""
    gone = tables(spark, name, "(" + "|".join(bases) + r")_[0-9]+(_vertices)?")
    for table in gone:
        spark.sql(f"DROP TABLE IF EXISTS {name}.{table}")
    return gone


def append(df: DataFrame, table: str, path: str, by: list[str] | None = None) -> None:
    """Rows under the table's schema, added to Parquet files, partitioned by ``by``."""
    w = schemas.conform(df, table.split(".")[-1]).write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def overwrite_partitions(df: DataFrame, table: str, path: str, by: list[str]) -> None:
    """Partitions that ``df`` holds are replaced, others stay: the write of a run again."""
    schemas.conform(df, table).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: what a unique constraint would refuse."""
    return df.groupBy(*key).count().where("count > 1")


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the parent lacks: what a foreign key would refuse."""
    return child.join(parent.select(*key), key, "left_anti")


def with_grid(rows: DataFrame, grids: DataFrame, equipment: DataFrame | None = None) -> DataFrame:
    """Rows with their grid's key, and the columns of its transformer's type where there is one."""
    out = rows.join(grids.select("grid_result_id", "version_id", "plz", "kcid", "bcid", *(["transformer_equipment_name"] if equipment is not None else [])), "grid_result_id")
    if equipment is None:
        return out
    e = equipment.withColumnRenamed("name", "transformer_equipment_name")
    return out.join(broadcast_if_small(e), ["version_id", "transformer_equipment_name"], "left")


def network_documents(tables_: dict[str, DataFrame], by: list[str], path: str) -> None:
    """One JSON document per grid, in Parquet."""
    from gridwright.operators.network import as_document

    as_document(tables_, by).write.mode("overwrite").parquet(path)


def to_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; points become WKT."""
    from gridwright.functions.geometry import wkt_line, wkt_point

    cols = [wkt_point(F.col(f.name)).alias(f.name) if f.dataType.simpleString().startswith("struct<x:") else wkt_line(F.col(f.name)).alias(f.name) if f.dataType.simpleString().startswith("array<struct<x:") else F.col(f.name) for f in df.schema]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)
