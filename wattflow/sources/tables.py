"""Scans of stored tables (A1-A4).

Column lists and predicates are handed to Spark as plain ``select`` /
``where`` so Catalyst prunes the parquet read and pushes filters into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Iterable[str] | None = None,
               where: Column | str | None = None) -> DataFrame:
    """Scan one table; optional column list (A2) and predicate (A3)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if where is not None:
        df = df.where(where)
    if columns is not None:
        df = df.select(*columns)
    return df


def read_catalog_table(spark: SparkSession, name: str,
                       columns: Iterable[str] | None = None,
                       where: Column | str | None = None) -> DataFrame:
    """Same as ``read_table`` for a catalog table or registered view (A4)."""
    df = spark.table(name)
    if where is not None:
        df = df.where(where)
    if columns is not None:
        df = df.select(*columns)
    return df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower_bound: int, upper_bound: int, num_partitions: int,
              properties: dict | None = None) -> DataFrame:
    """Warehouse read split into ``num_partitions`` range scans (A1).

    Never issues one unpartitioned query: the partition column and bounds are
    required so every executor pulls its own slice.
    """
    return spark.read.jdbc(url, table, column=partition_column,
                           lowerBound=lower_bound, upperBound=upper_bound,
                           numPartitions=num_partitions,
                           properties=properties or {})
