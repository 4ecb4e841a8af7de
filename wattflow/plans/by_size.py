"""Accounts of any size.

A plain window puts an account in one task.  Accounts with more invoices than a
bound are therefore built by the chunked scans of ``operators.prefix``, all
others by plain windows, and the two parts are put together.  Both give the
same values.  One job over the narrow invoice keys asks whether there is any
large account; without one the plan is the plain one alone and stays lazy.
The list of large accounts has at most (all invoices / bound) rows; it and the
rows of large accounts, which several scans read, are written to the checkpoint
folder once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattflow.session import ensure_checkpoint_dir
from wattflow.sources.fixtures import Domain

DEFAULT_ROWS = 1_000_000
CONF_KEY = "wattflow.window.rowsPerAccount"


def row_bound(d: Domain) -> int:
    return int(d.invoices.sparkSession.conf.get(CONF_KEY, str(DEFAULT_ROWS)))


def large_accounts(d: Domain, bound: int) -> DataFrame:
    """account_id of accounts with more than ``bound`` invoices (counted map-side per key first)."""
    per_key = d.invoices.groupBy("account_key").agg(F.count(F.lit(1)).alias("n"))
    return (d.accounts.select("account_id", "account_key").join(per_key, "account_key")
            .groupBy("account_id").agg(F.sum("n").alias("n"))
            .where(F.col("n") > bound).select("account_id"))


def by_size(d: Domain, build: Callable[..., DataFrame], bound: int | None = None) -> DataFrame:
    """``build(domain, chunked)`` over the accounts within the bound and over the larger ones."""
    large = written(large_accounts(d, row_bound(d) if bound is None else bound), True)
    if large.isEmpty():
        return build(d, chunked=False)
    small_part = replace(d, accounts=d.accounts.join(large, "account_id", "left_anti"))
    large_part = replace(d, accounts=d.accounts.join(large, "account_id", "left_semi"))
    return build(small_part, chunked=False).unionByName(build(large_part, chunked=True))


def written(df: DataFrame, chunked: bool) -> DataFrame:
    """``df`` cut from its lineage where several scans will read it."""
    if not chunked:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
