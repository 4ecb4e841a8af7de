"""Customer path: eligibility, features, hold-out, samples."""

import pytest
from pyspark.sql import functions as F

from helpers import D
from wattflow.operators import accounts as acc
from wattflow.operators import sampling as smp

SCHEMA = "account_id long, from_dt date, to_dt date, kwh int, station_id string, tavg_interval_sum double"
CUT = D(2020, 12, 31)


def _rows(account, n, start_month=1, station="1", year=2020, kwh0=100):
    out = []
    for i in range(n):
        m = (start_month - 1 + i) % 12 + 1
        y = year + (start_month - 1 + i) // 12
        out.append((account, D(y, m, 1), D(y, m, 28), kwh0 + i, station, 1000.0 + 10 * i))
    return out


def test_eligibility_reasons(spark):
    rows = (_rows(1, 4)                                  # too short
            + _rows(2, 5, start_month=10, year=2020)     # 3 of 5 after the cutoff
            + _rows(3, 6)[:3] + [(3, D(2020, 5, 1), D(2020, 5, 28), 9, "2", 5.0)] + _rows(3, 6)[4:]  # two stations
            + _rows(4, 8))                               # fine
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.account_id: r.reason for r in acc.eligibility(df, CUT).collect()}
    assert got == {1: acc.REASON_SHORT, 2: acc.REASON_NO_TEST, 3: acc.REASON_STATION, 4: None}


def test_features_cutoff_lags_holdout(spark):
    rows = _rows(4, 8) + [(4, D(2021, 3, 1), D(2021, 3, 28), 999, "1", 5.0)]  # late row
    df = spark.createDataFrame(rows, SCHEMA)
    f = acc.account_features(df, CUT).orderBy("row_idx").collect()
    assert len(f) == 6 and all(r.to_dt <= CUT for r in f)
    assert [r.is_eval for r in f] == [False] * 5 + [True]
    assert f[0].prev_pd_kwh == 101 and f[0].prev_prev_pd_kwh == 100
    assert f[0].days_passed == 60  # 2020-01-28 to 2020-03-28: from the first kept to_dt, before the lag drop
    train = [r.kwh for r in f if not r.is_eval]
    assert float(f[0].avg_kwh) == pytest.approx(sum(train) / len(train))


def test_new_month_in_holdout_falls_back(spark):
    rows = _rows(5, 7)  # months 1..7; after the lag drop months 3..7, month 7 only in the last row
    df = spark.createDataFrame(rows, SCHEMA)
    f = acc.account_features(df, CUT)
    last = f.where("is_eval").collect()[0]
    assert last.avg_kwh_for_cust_for_current_month == last.avg_kwh


def test_short_sample_raises(spark):
    ids = spark.createDataFrame([(1,), (2,)], "account_id long")
    with pytest.raises(ValueError):
        smp.sample_ids(ids, 3, 42)
    assert smp.sample_ids(ids, 2, 42).count() == 2


def test_hash_split_is_deterministic(spark):
    df = spark.range(2000).withColumnRenamed("id", "account_id")
    a = smp.hash_split(df, 42, ["account_id"]).where("split = 'train'").count()
    b = smp.hash_split(df.repartition(7), 42, ["account_id"]).where("split = 'train'").count()
    assert a == b and 1200 < a < 1450


def test_chunked_account_features_equal_plain(spark):
    rows = _rows(4, 30) + _rows(6, 9, start_month=3) + [(6, D(2020, 5, 1), D(2020, 5, 28), 7, "1", 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = D(2030, 1, 1)
    for scope, r in (("train", 2), ("train", 256), ("all", 5)):
        plain = acc.account_features(df, cut, scope)
        ch = acc.account_features(df, cut, scope, chunked=True, chunks=r)
        assert ch.columns == plain.columns
        assert plain.exceptAll(ch).count() == 0 and ch.exceptAll(plain).count() == 0


def test_folds_chunked_equal_plain(spark):
    rows = _rows(4, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    cut = D(2030, 1, 1)
    f = acc.account_features(df, cut)
    plain = acc.walk_forward_folds(f).collect()
    chunked = acc.walk_forward_folds(f, chunked=True, chunks=7).collect()
    assert sorted(plain) == sorted(chunked) and len(plain) == 6


def test_merged_samples_equal_features_of_the_sampled_accounts(spark):
    from conftest import SMALL
    from wattflow.plans import customers
    from wattflow.plans.registry import KEY, MERGE_COLS
    from wattflow.sources.fixtures import domain
    d = domain(spark, SMALL)
    feats = customers.features(d).select(*MERGE_COLS)
    ids = customers.eligibility(d).where("eligible")
    want = feats.join(smp.sample_ids(ids, 20, 1).union(smp.sample_ids(ids, 20, 2)).distinct(), "account_id", "left_semi").dropDuplicates(KEY)
    got = customers.merged_samples(d, 20, (1, 2), MERGE_COLS, KEY).collect()
    assert sorted(got) == sorted(want.collect()) and len({r.account_id for r in got}) > 20
