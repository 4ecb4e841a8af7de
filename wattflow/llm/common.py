"""Helpers shared by the operators of this subpackage: text columns, lineage cuts,
skew-safe attachment of per-key values and distributed connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattflow.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# A word of the licence and decontamination operators (after ASCII lower-casing).
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_WORD_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The most frequent keys of a join, and over how many parts the rows of each are dealt.
HOT_KEYS = 1024
SPREAD = 64


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (Spark's lower() also changes other letters)."""
    return F.translate(c, UPPER, LOWER)


def whole_text(c: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(c, F.lit(""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (as a URI) below the checkpoint folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, uri: str) -> None:
    """Have the folder removed when the application ends."""
    path, fs = _path(spark, uri)
    fs.deleteOnExit(path)


def remove_now(spark: SparkSession, uri: str) -> None:
    path, fs = _path(spark, uri)
    fs.delete(path, True)


def cut_to(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to a shared table and read it back: (table, its folder).

    Later stages then start from the files, whichever executors are lost, and
    the plan that made them runs exactly once.
    """
    spark = df.sparkSession
    uri = shared_folder(spark, f"wattflow-{name}")
    df.write.parquet(uri)
    remove_at_exit(spark, uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def cut(df: DataFrame, name: str) -> DataFrame:
    return cut_to(df, name)[0]


def attach(rows: DataFrame, table: DataFrame, key: str, count: str,
           spread_by: list[str]) -> DataFrame:
    """Left-join ``table`` (one row per key, how many ``rows`` have it in ``count``) onto ``rows``.

    The HOT_KEYS most frequent keys (the list of keys alone is broadcast, so its
    size is bounded; any key with over 1 / HOT_KEYS of the rows is among them)
    are dealt out over SPREAD parts by ``spread_by``, and their table row is
    repeated for each part.  No task receives a hot key whole.  A null key
    matches nothing.
    """
    values = [c for c in table.columns if c not in (key, count)]
    hot = F.broadcast(table.filter((F.col(count) > SPREAD) & F.col(key).isNotNull())
                      .orderBy(F.col(count).desc(), key).limit(HOT_KEYS)
                      .select(key, F.lit(True).alias("_hot")))
    dealt = rows.join(hot, key, "left").withColumn(
        "_part", F.when(F.col("_hot") | F.col(key).isNull(),
                        1 + F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("int"))
        .otherwise(F.lit(0)))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(1), F.lit(SPREAD))).otherwise(F.array(F.lit(0)))
    repeated = (table.filter(F.col(key).isNotNull()).join(hot, key, "left")
                .select(key, *values, F.explode(parts).alias("_part")))
    return dealt.join(repeated, [key, "_part"], "left").select(*rows.columns, *values)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)),
                    F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph: (node, component = smallest node).

    Alternates large-star and small-star steps (each hangs the neighbours of a
    node under its smallest one) until the edge set stops changing, which takes
    few rounds even on long chains.  Every round is joins and partial
    aggregates over the edges, is written to the shared folder, and hubs of any
    degree are spread (see ``attach``).  Nodes are those of the edges; self
    loops and null ends are ignored; repeated edges count once.  Ids may be of
    any type that has an order.
    """
    spark = edges.sparkSession
    e = (edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e, folder = cut_to(e, "cc")
    state = _fingerprint(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = (both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
               .select("u", F.least("u", "m").alias("m"), "n"))
        large = (attach(both, low, "u", "n", ["v"]).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large, large_folder = cut_to(large, "cc")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (attach(large, down, "u", "n", ["v"]).filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        new, new_folder = cut_to(small, "cc")
        new_state = _fingerprint(new)
        for old in (folder, large_folder):
            remove_now(spark, old)
        e, folder = new, new_folder
        if new_state == state:
            break
        state = new_state
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))
                         .distinct()))
