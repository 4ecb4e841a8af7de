"""Models with known answers: exact lines, well separated curves, brute-force solves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import D
from wattflow.operators import clusters as cl
from wattflow.operators import forecast as fc
from wattflow.operators import least_squares as ls
from wattflow.operators import ml_features as mf


def _features(spark, n_accounts=3, n=12):
    rows = []
    for a in range(n_accounts):
        for i in range(n):
            m = i % 12 + 1
            t = 1000.0 + 37 * ((i * 7 + a) % 11)
            kwh = int(2 * t + 5 * m + 3 * a)
            rows.append((a, D(2020 + i // 12, m, 1), D(2020 + i // 12, m, 28), kwh, t, i + 1, n, i == n - 1, m,
                         float(i * 30), 0.0, 0.0))
    schema = ("account_id long, from_dt date, to_dt date, kwh int, tavg_interval_sum double, row_idx int, "
              "n_rows int, is_eval boolean, month int, days_passed double, prev_pd_kwh double, prev_prev_pd_kwh double")
    return spark.createDataFrame(rows, schema)


def test_walk_forward_ols_matches_numpy(spark):
    df = _features(spark)
    spec = mf.FeatureSpec(numeric=["tavg_interval_sum", "days_passed"], categorical=["month"])
    got = {(r.account_id, r.to_dt): r.prediction for r in fc.walk_forward_ols(df, spec).collect()}
    pdf = df.toPandas().sort_values(["account_id", "to_dt"])
    checked = 0
    for a, g in pdf.groupby("account_id"):
        g = g.reset_index(drop=True)
        init = int(len(g) * 0.8)
        X = np.column_stack([g.tavg_interval_sum, g.days_passed] + [(g.month == m).astype(float) for m in range(1, 13)])
        y = g.kwh.to_numpy(float)
        for i in range(init, len(g)):
            Xt, yt = X[:i], y[:i]
            mu, ybar = Xt.mean(0), yt.mean()
            beta = np.linalg.lstsq(Xt - mu, yt - ybar, rcond=None)[0]
            want = ybar + (X[i] - mu) @ beta
            assert got[(a, g.to_dt[i])] == pytest.approx(want, rel=1e-6, abs=1e-6)
            checked += 1
    assert checked == len(got) > 0


def test_exact_line_has_zero_error(spark):
    rows = [(0, D(2020, 1, i + 1), D(2020, 1, i + 1), int(2 * x + 7), float(x), i + 1, 10, i == 9, 1, 0.0, 0.0, 0.0)
            for i, x in enumerate([3, 8, 1, 9, 4, 6, 2, 7, 5, 10])]
    schema = ("account_id long, from_dt date, to_dt date, kwh int, tavg_interval_sum double, row_idx int, "
              "n_rows int, is_eval boolean, month int, days_passed double, prev_pd_kwh double, prev_prev_pd_kwh double")
    df = spark.createDataFrame(rows, schema)
    out = fc.walk_forward_ols1(df).collect()
    assert out and all(r.abs_error == 0 for r in out)
    spec = mf.FeatureSpec(numeric=["tavg_interval_sum"])
    assert all(abs(r.prediction - r.kwh) < 1e-6 for r in fc.walk_forward_ols(df, spec).collect())


def test_pooled_ols_predicts_exact_line(spark):
    df = _features(spark, n_accounts=4, n=10).withColumn("kwh", (2 * F.col("tavg_interval_sum") + 9).cast("int"))
    spec = mf.FeatureSpec(numeric=["tavg_interval_sum"])
    preds = fc.pooled_forecast(df, spec, {"ols": fc.LeastSquares()}).collect()
    assert len(preds) == 4 and all(abs(r.prediction - r.kwh) < 1e-6 for r in preds)


def test_two_curve_shapes_recovered(spark):
    summer = [0.05] * 5 + [0.15, 0.2, 0.15] + [0.05] * 4
    winter = [0.15, 0.15] + [0.05] * 8 + [0.15, 0.25]
    rows = []
    for e in range(12):
        base = summer if e < 6 else winter
        rows.append((e, *[v + 0.001 * (e % 3) for v in base]))
    df = spark.createDataFrame(rows, ["entity_id"] + cl.SHARE_COLS)
    labels = {r.entity_id: r.cluster for r in cl.kmeans_labels(df, "entity_id", k=2, n_init=2).collect()}
    assert len({labels[e] for e in range(6)}) == 1 and len({labels[e] for e in range(6, 12)}) == 1
    assert labels[0] != labels[11]
    cents = [summer, winter]
    near = {r.entity_id: r.cluster for r in cl.nearest_centroid(df, "entity_id", cents).collect()}
    assert all(near[e] == (0 if e < 6 else 1) for e in range(12))


def test_feature_names_match_coefficients(spark):
    df = _features(spark, n_accounts=3, n=12)
    spec = mf.FeatureSpec(numeric=["tavg_interval_sum"], categorical=["month"],
                          interactions=[("month", "tavg_interval_sum"), ("month", "tavg_interval_sum")])
    names = [r.feature for r in fc.coefficient_table(df, spec).collect()]
    # all but the accounts' last month is met in training, and so is that by others: eleven levels
    assert names[:3] == ["intercept", "tavg_interval_sum", "month=1"] and len(names) == 1 + 1 + 11 + 11
    assert names[-1] == "month=9*tavg_interval_sum"


def test_walk_forward_ols_chunked_path_matches(spark):
    df = _features(spark)
    spec = mf.FeatureSpec(numeric=["tavg_interval_sum", "days_passed"], categorical=["month"])
    plain = {(r.account_id, r.to_dt): r.prediction for r in fc.walk_forward_ols(df, spec).collect()}
    chunked = {(r.account_id, r.to_dt): r.prediction for r in fc.walk_forward_ols(df, spec, chunked=True).collect()}
    assert plain == chunked  # the sums are exact, so not even the last bit differs


def test_walk_forward_ols1_chunked_path_matches(spark):
    df = _features(spark, n_accounts=3, n=15)
    plain = {(r.account_id, r.to_dt): r.prediction for r in fc.walk_forward_ols1(df).collect()}
    chunked = {(r.account_id, r.to_dt): r.prediction for r in fc.walk_forward_ols1(df, chunked=True).collect()}
    assert plain == chunked and len(plain) > 0 and None not in plain.values()


def test_near_constant_and_constant_regressors(spark):
    rows = []
    for a, step in enumerate([0.001, 0.0, 0.25]):
        rows += [(a, D(2020, 1, i + 1), D(2020, 1, i + 1), 100 + 7 * i % 13, 98765.432 + step * (i % 3), i + 1, 20)
                 for i in range(20)]
    df = spark.createDataFrame(rows, "account_id long, from_dt date, to_dt date, kwh int, tavg_interval_sum double, "
                                     "row_idx int, n_rows int")
    both = [{(r.account_id, r.to_dt): r.prediction for r in fc.walk_forward_ols1(df, chunked=c).collect()}
            for c in (False, True)]
    assert both[0] == both[1]
    assert all((p is None) == (a == 1) for (a, _), p in both[0].items())


def test_walk_forward_ols_equals_lstsq_on_the_fixture(spark):
    """Same rule as documented: scaled singular values cut at SINGULAR, smallest norm in original units."""
    from conftest import SMALL
    from wattflow.plans import customers
    from wattflow.sources.fixtures import domain
    f = customers.features(domain(spark, SMALL)).checkpoint()
    got = {(r.account_id, r.from_dt, r.to_dt, r.kwh): r.prediction for r in fc.walk_forward_ols(f).collect()}
    nums, checked = fc.WALK_SPEC.numeric, 0
    for _, g in f.toPandas().sort_values(["to_dt", "from_dt", "kwh"]).groupby("account_id"):
        g = g.reset_index(drop=True)
        x = np.column_stack([g[nums].to_numpy(float)] + [(g.month == m).to_numpy(float) for m in range(1, 13)])
        y = g.kwh.to_numpy(float)
        for i in range(int(len(g) * 0.8), len(g)):
            xc, yc = x[:i] - x[:i].mean(0), y[:i] - y[:i].mean()
            scale = np.linalg.norm(xc, axis=0)
            live = scale > 1e-9
            u, s, vt = np.linalg.svd(xc[:, live] / scale[live], full_matrices=False)
            keep = s > ls.SINGULAR * s[0] if len(s) else s > 0
            beta = (vt[keep].T @ ((u[:, keep].T @ yc) / s[keep])) / scale[live]
            if live.any():  # take out what lies in the null space of the kept directions
                null = np.linalg.svd(vt[keep] * scale[live])[2][keep.sum():].T
                beta = beta - null @ (null.T @ beta)
            want = y[:i].mean() + (x[i] - x[:i].mean(0))[live] @ beta
            assert got[tuple(g.loc[i, ["account_id", "from_dt", "to_dt", "kwh"]])] == pytest.approx(want, rel=1e-6, abs=1e-5)
            checked += 1
    assert checked == len(got) > 100


def test_walk_forward_forest_is_fitted_on_the_accounts_earlier_rows(spark):
    df = _features(spark, n_accounts=6, n=15)
    spec = mf.FeatureSpec(numeric=["tavg_interval_sum", "days_passed"])
    runs = [{(r.account_id, r.fold): r.prediction for r in fc.walk_forward_forest(d, spec, trees=5).collect()}
            for d in (df.repartition(2), df.repartition(8))]
    assert runs[0] == runs[1] and len(runs[0]) == 18  # no test row is left out
    # what comes later, or belongs to others, moves nothing
    later = df.withColumn("kwh", F.when((F.col("account_id") != 2) | (F.col("row_idx") > 13), F.col("kwh") + 5000).otherwise(F.col("kwh")))
    moved = {(r.account_id, r.fold): r.prediction for r in fc.walk_forward_forest(later, spec, trees=5).collect()}
    assert all(moved[2, f] == pytest.approx(runs[0][2, f]) for f in (0, 1)) and moved[2, 2] != runs[0][2, 2]
    # one tree without depth predicts the kwh of an equal earlier row of the only month
    same = _features(spark, n_accounts=1, n=5).withColumn("tavg_interval_sum", F.when(F.col("row_idx") == 5, 1259.0).otherwise(F.col("tavg_interval_sum")))
    assert len(fc.walk_forward_forest(same, mf.FeatureSpec(numeric=["tavg_interval_sum"], categorical=["month"]), trees=2).collect()) == 1


def test_forest_ablation_counts_rows_without_a_prediction(spark):
    from wattflow.plans import models
    df = _features(spark, n_accounts=2, n=12).unionByName(_features(spark, n_accounts=1, n=1).withColumn("account_id", F.lit(99)))
    got = {r.variant: r for r in models.temp_ablation_rf(df, trees=2).collect()}
    assert set(got) == {"with_temperature", "without_temperature"}
    assert all((r.n_accounts, r.n_unpredicted) == (2, 1) and r.ae is not None for r in got.values())


def test_ablation_from_one_scan_equals_two_fits(spark):
    df = _features(spark, n_accounts=4, n=14)
    both = fc.walk_forward_ols(df, fc.WALK_SPEC, variants={"all": [], "none": fc.TEMPERATURE_COLUMNS, "less": ["days_passed", "tavg_interval_sum"]})
    have = {(r.model, r.account_id, r.fold): r.prediction for r in both.collect()}
    for name, left_out in (("all", []), ("none", fc.TEMPERATURE_COLUMNS), ("less", ["days_passed", "tavg_interval_sum"])):
        alone = fc.walk_forward_ols(df, fc.WALK_SPEC.without(left_out)).collect()
        assert alone and all(have[name, r.account_id, r.fold] == pytest.approx(r.prediction, rel=1e-9) for r in alone)
    assert len(have) == 3 * len(alone)


def test_pooled_forest_and_registry(spark):
    df = _features(spark, n_accounts=8, n=12)
    spec = mf.FeatureSpec(numeric=["tavg_interval_sum"], categorical=["month"])
    runs = [{(r.model, r.account_id): r.prediction for r in fc.pooled_forecast(
        d, spec, {n: e for n, e in fc.algorithm_registry(trees=20).items() if n in ("ols", "rf")}).collect()}
        for d in (df.repartition(2), df.repartition(9))]
    assert runs[0] == pytest.approx(runs[1], rel=1e-12) and len(runs[0]) == 16
    last = {r.account_id: r.kwh for r in df.where("is_eval").collect()}
    assert all(abs(runs[0]["rf", a] - k) < 300 for a, k in last.items())


def _split_rows(spark, n=300):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        x = [float(v) for v in rng.integers(0, 30, 8)]
        rows.append((i, D(2020, 1 + i % 12, 1), D(2020, 1 + i % 12, 28), i, *x, round(float(2 * x[1] + x[4] + rng.normal()), 2), "train" if i % 3 else "test"))
    schema = "account_id long, from_dt date, to_dt date, kwh int, " + ", ".join(f"{c} double" for c in fc.NOTEBOOK_INPUTS)
    return spark.createDataFrame(rows, schema + f", {fc.NOTEBOOK_TARGET} double, split string")


def test_tree_counts_and_grid_search_share_their_trees(spark):
    rows = _split_rows(spark)
    both = {r.num_trees: r for r in fc.tree_count_compare(rows, [5, 20]).collect()}
    for n in (5, 20):
        alone = fc.tree_count_compare(rows, [n]).first()
        assert (both[n].mae, both[n].rmse) == pytest.approx((alone.mae, alone.rmse), rel=1e-9)
    assert both[20].mae < 6
    grid = {r.num_trees: r for r in fc.grid_search(rows, [5, 20], folds=3).collect()}
    assert sum(r.best for r in grid.values()) == 1 and all(0.7 < r.cv_r2 < 1 for r in grid.values())
    assert grid[20].best == (grid[20].cv_r2 > grid[5].cv_r2)


def test_cross_validated_line_equals_refits(spark):
    rows = _split_rows(spark)
    got = {r.fold: float(r.r2) for r in fc.cross_validated_line(rows, fc.NOTEBOOK_INPUTS[1], fc.NOTEBOOK_TARGET).collect()}
    g = rows.withColumn("fold", fc.fold_of(5, 30)).toPandas()
    assert sorted(got) == list(range(5))
    for f, r2 in got.items():
        rest, own = g[g.fold != f], g[g.fold == f]
        b, a = np.polyfit(rest[fc.NOTEBOOK_INPUTS[1]], rest[fc.NOTEBOOK_TARGET], 1)
        y = own[fc.NOTEBOOK_TARGET]
        assert r2 == pytest.approx(1 - ((y - a - b * own[fc.NOTEBOOK_INPUTS[1]]) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)


def test_kmeans_equals_plain_lloyd(spark):
    rng = np.random.default_rng(9)
    curves = rng.dirichlet(np.ones(12) * 3, 60)
    df = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(curves)], ["entity_id"] + cl.SHARE_COLS)
    points = cl.curve_points(df, "entity_id")
    sets, cost = cl.fit_sets(points, [1, 2, 3], n_init=4)
    p = np.floor(curves * cl.UNIT + 0.5).astype(np.int64)
    starts = cl.seed_sets(points, 3, 4, 42)
    assert len({tuple(map(tuple, c)) for c in starts.values()}) > 1  # starts differ
    for (k, s), centres in sets.items():
        c = np.array(starts[s][:k])
        for _ in range(300):
            label = ((p[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([[(2 * int(v) + n) // (2 * n) for v in p[label == i].sum(0)] if (n := int((label == i).sum())) else c[i]
                            for i in range(k)])
            moved, c = ((new - c) ** 2).sum(1).max(), new
            if moved <= 10 ** 8:
                break
        assert centres == c.tolist() and cost[k, s] == int(((p[:, None] - c) ** 2).sum(2).min(1).sum())
    again = cl.fit_sets(cl.curve_points(df.repartition(7), "entity_id"), [1, 2, 3], n_init=4)
    assert again == (sets, cost)


def test_kmeans_of_few_or_equal_curves(spark):
    one = [0.1] * 10 + [0.0, 0.0]
    df = spark.createDataFrame([(i, *one) for i in range(3)], ["entity_id"] + cl.SHARE_COLS)
    assert {r.cluster for r in cl.kmeans_labels(df, "entity_id", k=4, n_init=2).collect()} == {0}
    assert [float(r.cost) for r in cl.kmeans_sweep(spark, df, "entity_id", 3, 2).collect()] == [0, 0, 0]
    assert cl.kmeans_labels(df.limit(0), "entity_id").collect() == [] and cl.kmeans_sweep(spark, df.limit(0), "entity_id").collect() == []


def test_account_effects_equal_least_squares(spark):
    rng = np.random.default_rng(4)
    rows = []
    for a in range(4):
        for i in range(14):
            t = float(rng.integers(300, 900)) if a != 3 else 500.0
            p, q = float(rng.integers(0, 400)), float(rng.integers(0, 50))
            rows.append((a, D(2020, 1, i + 1), D(2020, 1, i + 1), int(a * 100 + (2 + a) * t + .5 * p - q + rng.integers(0, 60)),
                         t, p, q, i == 13))
    df = spark.createDataFrame(rows, "account_id long, from_dt date, to_dt date, kwh int, tavg_interval_sum double, "
                                     "p double, q double, is_eval boolean")
    got = {r.account_id: r.prediction for r in fc.account_effects(df, ["p", "q"]).collect()}
    x = np.array([[r[0] == a for a in range(4)] + [(r[0] == a) * r[4] for a in range(3)] + [r[5], r[6]] for r in rows], float)
    train = np.array([not r[7] for r in rows])
    beta = np.linalg.lstsq(x[train], np.array([r[3] for r in rows], float)[train], rcond=None)[0]
    want = {rows[i][0]: x[i] @ beta for i in np.flatnonzero(~train)}
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a], rel=1e-6) for a in want)


def test_pooled_ols_with_categories_and_interaction_equals_numpy(spark):
    df = _features(spark, n_accounts=5, n=24)
    spec = mf.FeatureSpec(numeric=["tavg_interval_sum"], categorical=["month"],
                          interactions=[("month", "tavg_interval_sum", mf.CATEGORICAL, mf.NUMERICAL)])
    got = {r.account_id: r.prediction for r in fc.pooled_forecast(df, spec, {"ols": fc.LeastSquares()}).collect()}
    g = df.toPandas()
    month = np.stack([(g.month == m).to_numpy(float) for m in range(1, 13)], axis=1)
    t = g.tavg_interval_sum.to_numpy(float)[:, None]
    x = np.hstack([np.ones_like(t), t, month, month * t])
    train = ~g.is_eval.to_numpy()
    beta = np.linalg.lstsq(x[train], g.kwh.to_numpy(float)[train], rcond=None)[0]
    for i in np.flatnonzero(~train):
        assert got[g.account_id[i]] == pytest.approx(x[i] @ beta, rel=1e-8)


def test_truncated_errors_and_shuffle(spark):
    from decimal import Decimal

    from wattflow.operators import evaluate as ev
    from wattflow.operators import sampling as smp
    df = spark.createDataFrame([(1, 10, Decimal("7.9000"))], "account_id long, kwh int, prediction decimal(18,4)")
    assert ev.error_frame(df, truncate=True).first().error == 3
    ids = spark.range(50).withColumnRenamed("id", "account_id")
    a, b = ([r.account_id for r in smp.shuffle_rows(d, 1, ["account_id"]).collect()] for d in (ids, ids.repartition(5)))
    assert a == b != sorted(a) and sorted(a) == list(range(50))


def test_many_small_solves_equal_single_ones_with_an_orthogonal_basis():
    import numpy as np
    from wattflow.operators import least_squares as ls
    r = np.random.default_rng(3)
    c, b = np.zeros((60, 7, 7)), np.zeros((60, 7))
    for i in range(60):
        n = 2 + i % 9
        x = np.c_[r.normal(size=(n, 3)) * [500, 3, 1], np.eye(4)[r.integers(0, 4, n)]]
        x, y = x - x.mean(0), r.integers(0, 90, n).astype(float)
        c[i], b[i] = x.T @ x, x.T @ (y - y.mean())
    single = np.array([ls.solve_centred(c[i], b[i]) for i in range(60)])
    svd, np.linalg.svd = np.linalg.svd, None  # a decomposition that the solves do not need
    try:
        many = ls.solve_many(c, b)
    finally:
        np.linalg.svd = svd
    np.testing.assert_allclose(many, single, rtol=1e-6, atol=1e-6)
