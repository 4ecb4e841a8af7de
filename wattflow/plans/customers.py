"""Path B: customer series for forecasting, built for all accounts at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattflow.operators import accounts as acc
from wattflow.operators import readings
from wattflow.operators import sampling as smp
from wattflow.plans import matched
from wattflow.plans.by_size import by_size, written
from wattflow.sources.fixtures import Domain

# Fixed value: the fixture's stand-in for the reference cutoff (FIXTURES.md part 2).
FIXTURE_CUTOFF = dt.date(2001, 2, 25)


def customer_rows(d: Domain) -> DataFrame:
    """Invoices at the nearest station with the skip-mode interval sum."""
    return readings.interval_temp_sum(matched.invoices_nearest(d), d.weather)


def eligibility(d: Domain, cutoff: dt.date = FIXTURE_CUTOFF) -> DataFrame:
    return acc.eligibility(customer_rows(d), cutoff)


def features(d: Domain, cutoff: dt.date = FIXTURE_CUTOFF, scope: str = "train",
             bound: int | None = None) -> DataFrame:
    return from_features(d, None, cutoff, scope, bound)


def from_features(d: Domain, step: Callable[..., DataFrame] | None, cutoff: dt.date = FIXTURE_CUTOFF,
                  scope: str = "train", bound: int | None = None) -> DataFrame:
    """``step(features, chunked=...)`` for accounts of any size (``plans.by_size``)."""
    def build(part: Domain, chunked: bool) -> DataFrame:
        rows = written(customer_rows(part), chunked)
        f = written(acc.account_features(rows, cutoff, scope, chunked), chunked)
        return f if step is None else step(f, chunked=chunked)
    return by_size(d, build, bound)


def merged_samples(d: Domain, n: int, seeds: tuple[int, ...], columns: list[str], key: list[str],
                   cutoff: dt.date = FIXTURE_CUTOFF) -> DataFrame:
    """Feature rows of one sample of eligible accounts for each seed, merged by key.

    Eligibility is found once, over all accounts.  Features of an account come
    from its own invoices alone, so they are built for the sampled accounts only;
    the weather that both read is written once.
    """
    d = replace(d, weather=written(d.weather, True))
    ids = written(eligibility(d, cutoff).where("eligible").select("account_id"), True)
    samples = [written(smp.sample_ids(ids, n, seed), True) for seed in seeds]
    some = F.broadcast(reduce(DataFrame.unionByName, samples).distinct())  # at most n ids a seed
    # cut from the invoices too, before they meet the readings
    accounts = d.accounts.join(some, "account_id", "left_semi")
    invoices = d.invoices.join(F.broadcast(accounts.select("account_key")), "account_key", "left_semi")
    rows = written(features(replace(d, accounts=accounts, invoices=invoices), cutoff).select(*columns), True)
    return reduce(lambda a, b: smp.merge_slices(a, b, key), (rows.join(F.broadcast(s), "account_id", "left_semi") for s in samples))
