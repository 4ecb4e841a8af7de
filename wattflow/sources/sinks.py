"""Publishing a result table (A6): ordered files, or a catalog table bucketed by account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def publish_ordered(df: DataFrame, path: str, order_cols: list[str],
                    num_partitions: int | None = None, fmt: str = "parquet") -> None:
    """Write ``df`` globally ordered by ``order_cols`` (CTAS ... ORDER BY).

    A range repartition on the sort keys plus a per-partition sort gives files
    that are ordered inside and across each other, without funnelling the
    table through one task as a global ``orderBy().coalesce(1)`` would.
    """
    parts = [num_partitions] if num_partitions else []  # else as many as adaptive execution needs
    (df.repartitionByRange(*parts, *order_cols)
       .sortWithinPartitions(*order_cols)
       .write.mode("overwrite").format(fmt).save(path))


def publish_bucketed(df: DataFrame, table: str, bucket_col: str, order_cols: list[str], partition_col: str,
                     buckets: int, path: str | None = None) -> None:
    """Publish ``df`` as catalog table ``table``: a folder for each ``partition_col``, rows dealt to
    ``buckets`` by ``bucket_col`` and sorted in them.

    Windows and joins by ``bucket_col`` over the table need no exchange.  The
    rows are brought to their buckets first, so a bucket is one file a folder.
    """
    dealt = df.repartition(buckets, bucket_col)
    writer = (dealt.write.mode("overwrite").format("parquet").partitionBy(partition_col)
              .bucketBy(buckets, bucket_col).sortBy(*order_cols))
    (writer.option("path", path) if path else writer).saveAsTable(table)


def overwrite_partitions(spark: SparkSession, df: DataFrame, table: str) -> None:
    """Replace the partitions of ``table`` that ``df`` has rows of; other partitions' files stay as they are."""
    columns = spark.table(table).columns
    key, before = "spark.sql.sources.partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set(key, "dynamic")
    try:
        df.select(*columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(key, before)
