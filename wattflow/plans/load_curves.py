"""Path C: load curves, K-means and cluster labels on invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattflow.operators import clusters as cl
from wattflow.operators import quality as qa
from wattflow.plans import matched
from wattflow.sources.fixtures import Domain, load_points

SEED = 42


def supplier_shares(spark, sf_dir: str) -> DataFrame:
    """Complete twelve-month curves of the load-point entities, as shares."""
    pivot = cl.load_pivot(load_points(spark, sf_dir), "entity_id")
    return cl.load_shares(pivot, "entity_id")


def clustering_rows(d: Domain) -> DataFrame:
    """Feature-table rows that pass the clustering filters (B4-B6 on the preferred station)."""
    return qa.clean_rows(matched.matched_table_2(d), share_col="perc_missing_preferred", max_share=qa.HALF)


def account_shares(d: Domain, complete_only: bool = False) -> DataFrame:
    """Per-account monthly kWh curves as shares; months with no invoice stay null, or drop the account."""
    rows = clustering_rows(d).select("account_id", F.col("todt_month").alias("month"), F.col("kwh").alias("value"))
    return cl.load_shares(cl.load_pivot(rows, "account_id", complete_only=complete_only), "account_id")


def account_labels(spark, d: Domain, sf_dir: str, k: int = cl.KMEANS_K_FINAL, complete_only: bool = False) -> DataFrame:
    """Nearest of k seeded centroids for every account curve."""
    centroids = cl.seed_centroids(supplier_shares(spark, sf_dir), "entity_id", k, SEED)
    return cl.nearest_centroid(account_shares(d, complete_only), "account_id", centroids)


def labelled_rows(d: Domain, labels: DataFrame) -> DataFrame:
    """Every clustering row with its account's label, -1 for accounts without a complete curve."""
    rows = clustering_rows(d).select("account_id", "from_dt", "to_dt", "kwh", "gender", "rate_class", "county_fips")
    return cl.label_rows(rows, labels, "account_id")


def kmeans_chain(d: Domain, k: int = cl.KMEANS_K_FINAL, n_init: int = cl.KMEANS_N_INIT) -> DataFrame:
    """Centres fitted on the complete curves, nearest centre for each, label on every row."""
    return labelled_rows(d, cl.kmeans_labels(account_shares(d, complete_only=True), "account_id", k, n_init))
