"""Deterministic shuffles, samples and splits.

Randomness is a hash of (seed, key): the same rows are chosen on every run,
on any number of partitions, and by the DuckDB oracle (md5 is in both).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_PER_MILLE = 666  # 66.6 % train, as the notebook's split


def hash_key(seed: int, *cols) -> Column:
    """md5 of 'seed:col1:col2...' (dates as yyyy-MM-dd text)."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(seed: int, cols, modulus: int = 1000) -> Column:
    """First 8 hex digits of the hash as a number, modulo ``modulus``."""
    return (F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("bigint") % modulus).cast("int")


def shuffle_rows(df: DataFrame, seed: int, key_cols: list[str]) -> DataFrame:
    """Rows in a seeded pseudo-random order."""
    return df.orderBy(hash_key(seed, *key_cols))


def hash_split(df: DataFrame, seed: int, key_cols: list[str],
               train_per_mille: int = TRAIN_PER_MILLE) -> DataFrame:
    """Label each row 'train' or 'test' by its hash bucket."""
    return df.withColumn("split", F.when(hash_bucket(seed, key_cols) < train_per_mille, F.lit("train"))
                         .otherwise(F.lit("test")))


def sample_ids(ids: DataFrame, n: int, seed: int, id_col: str = "account_id") -> DataFrame:
    """``n`` distinct ids in seeded hash order; error if fewer exist.

    The ordered limit runs as a per-partition top-n followed by a merge of
    at most ``n`` rows per partition.
    """
    distinct = ids.select(id_col).distinct()
    available = distinct.count()
    if n > available:
        raise ValueError(f"cannot sample {n} ids, only {available} available")
    return distinct.orderBy(hash_key(seed, id_col)).limit(n)


def merge_slices(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Union of two slices with rows of the same key kept once."""
    return a.unionByName(b).dropDuplicates(key)
