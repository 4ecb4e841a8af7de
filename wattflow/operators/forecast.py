"""Forecasts: pooled models and walk-forward per account.

* **Pooled**: one ``pyspark.ml`` pipeline is fitted on every account's
  training rows and predicts every account's held-out last row (I8).
* **Walk-forward, linear**: fold i of an account trains on its rows before the
  test row.  The normal equations of every prefix are window sums, exact as
  integers and decimals; each test row then needs one small solve, done in
  Arrow batches with numpy (minimum-norm least squares with intercept, as the
  reference's linear model gives for collinear dummies).
* **Walk-forward, one regressor**: the same exact sums and one division, so it
  has an exact SQL oracle.
* **Forests**: full trees with exact splits (``operators.trees``), pooled over
  all accounts or, walk-forward, one forest per account and fold.
* **Account effects**: an intercept and a temperature slope for every account
  are partialled out by grouped sums, so accounts are never indexed on the driver.

Rows that several ``pyspark.ml`` fits read are laid out by a hash of their key
into sorted partitions, as many as the rows ask for, and written to the
checkpoint folder, so a fit does not depend on the size of the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattflow.operators import least_squares as ls
from wattflow.operators.ml_features import FeatureSpec, feature_stages, with_numeric_inputs
from wattflow.functions.numeric import READING_TYPE
from wattflow.operators.prefix import ordered_scan
from wattflow.operators.sampling import hash_bucket
from wattflow.operators.trees import forest_predictions
from wattflow.session import ensure_checkpoint_dir, fit_partitions
from wattflow.operators.windows import ORDER

TEST_KEY = ["account_id", "from_dt", "to_dt", "kwh"]

# Fixed values from the reference: forest size and the grid it searched.
FOREST_TREES = 150
FOREST_GRID = [150, 200]
CV_FOLDS = 5


@dataclass(frozen=True)
class LeastSquares:
    """Ordinary least squares with intercept (I4), see ``operators.least_squares``."""
    singular: float = ls.SINGULAR


@dataclass(frozen=True)
class Forest:
    """Random forest on all features per split, bootstrap rows, full trees unless ``max_depth`` is set."""
    trees: int = FOREST_TREES
    max_depth: int | None = None
    seed: int = 42
    bootstrap: bool = True


def algorithm_registry(label: str = "kwh", trees: int = FOREST_TREES, max_depth: int | None = None) -> dict:
    """Name -> estimator."""
    return {"ols": LeastSquares(), "rf": Forest(trees, max_depth),
            "gbt": GBTRegressor(featuresCol="features", labelCol=label, seed=42),
            "tree": DecisionTreeRegressor(featuresCol="features", labelCol=label, seed=42)}


# The pooled experiment's inputs in the reference's driver script.
POOLED_SPEC = FeatureSpec(
    numeric=["tavg_interval_sum", "prev_pd_kwh", "prev_prev_pd_kwh", "days_passed", "account_id", "avg_kwh"],
    categorical=["month"],
    interactions=[("month", "tavg_interval_sum", "categorical", "numerical")])

# The per-customer experiment's inputs, with and without temperature.
WALK_SPEC = FeatureSpec(numeric=["tavg_interval_sum", "prev_pd_kwh", "prev_prev_pd_kwh", "days_passed"],
                        categorical=["month"])
TEMPERATURE_COLUMNS = ["tavg_interval_sum"]


def _written(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _laid_out(df: DataFrame) -> DataFrame:
    """Written rows by hash of their key in sorted partitions, as many as they ask for, cut from their lineage."""
    return _written(df.repartition(fit_partitions(df.count()), *TEST_KEY)
                    .sortWithinPartitions(*TEST_KEY, *sorted(set(df.columns) - set(TEST_KEY))))


def pooled_forecast(features: DataFrame, spec: FeatureSpec, estimators: dict) -> DataFrame:
    """Fit each estimator on all training rows, predict each account's last row (I8).

    Long result: key, model, prediction.
    """
    rows, laid = _written(features), None
    split = lambda data: (data.where(~F.col("is_eval")), data.where(F.col("is_eval")))
    out = None
    for name, est in estimators.items():
        if isinstance(est, LeastSquares):
            train, test = split(rows)
            p = test.withColumn("prediction", ls.fit(train, spec, est.singular).prediction())
        elif isinstance(est, Forest):
            p = _pooled_forest(*split(with_numeric_inputs(rows, spec)), spec, est)
        else:
            laid = laid or _laid_out(with_numeric_inputs(rows, spec))  # one layout for all of these
            train, test = split(laid)
            p = Pipeline(stages=feature_stages(spec) + [est]).fit(train).transform(test)
        p = p.select(*TEST_KEY, F.lit(name).alias("model"), "prediction")
        out = p if out is None else out.unionByName(p)
    return out


def _pooled_forest(train: DataFrame, test: DataFrame, spec: FeatureSpec, est: Forest) -> DataFrame:
    """One forest over the training rows, applied to the test rows."""
    encoder = Pipeline(stages=feature_stages(spec)).fit(train)
    inputs = lambda rows: encoder.transform(rows).select(
        F.lit(0).alias("grp"), F.xxhash64(*TEST_KEY).alias("rid"), vector_to_array("features").alias("fx"),
        F.col(spec.label).alias("y"), *TEST_KEY)
    return forest_predictions(inputs(train).drop(*(set(TEST_KEY) - {"y"})), inputs(test), TEST_KEY, est.trees, est.seed,
                              est.bootstrap, est.max_depth)


def coefficient_table(features: DataFrame, spec: FeatureSpec = POOLED_SPEC) -> DataFrame:
    """Pooled linear coefficients by name (I15): feature, coefficient."""
    model = ls.fit(features.where(~F.col("is_eval")), spec)
    rows = [("intercept", model.intercept), *[(s.name, float(v)) for s, v in zip(model.slots, model.coefficients)]]
    return features.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def _test_rows(features: DataFrame, share: float) -> F.Column:
    return F.col("row_idx") > F.floor(F.col("n_rows") * F.lit(share)).cast("int")


def _fold(share: float) -> F.Column:
    return (F.col("row_idx") - F.floor(F.col("n_rows") * F.lit(share)).cast("int") - 1).cast("int")


def _before(features: DataFrame, sums: dict, chunked: bool) -> DataFrame:
    return ordered_scan(features, ["account_id"], ORDER, sums=sums, chunked=chunked).drop("_n", "_rn")


def walk_forward_ols1(features: DataFrame, x: str = "tavg_interval_sum", y: str = "kwh",
                      share: float = 0.8, min_var: float = 1e-9, chunked: bool = False) -> DataFrame:
    """One-regressor walk-forward forecast from exact prefix sums of n, x, y, xx, xy.

    The regressor is taken as a decimal with 3 places (as readings are), so the
    determinant ``n * sxx - sx * sx`` has no cancellation and every size gives
    the same line.  A prefix whose regressor barely varies gives no prediction.
    """
    xd, yd = F.col(x).cast(READING_TYPE), F.col(y).cast("decimal(18,0)")
    ok = xd.isNotNull() & yd.isNotNull()
    wide = lambda e: F.when(ok, e.cast("decimal(28,6)"))
    sums = {"n": F.when(ok, F.lit(1).cast("decimal(12,0)")), "sx": wide(xd), "sy": wide(yd),
            "sxx": wide(xd * xd), "sxy": wide(xd * yd)}
    base = _before(features.select(*dict.fromkeys([*TEST_KEY, "row_idx", "n_rows", x, y])), sums, chunked)
    n, sx, sy, sxx, sxy = (F.col(f"_before_{k}").cast("decimal(19,3)" if k in ("sx", "sy", "n") else "decimal(25,6)")
                           for k in ("n", "sx", "sy", "sxx", "sxy"))
    exact = lambda a, b: (a * b).cast("decimal(38,6)")
    det = exact(n, sxx) - exact(sx, sx)
    slope = (exact(n, sxy) - exact(sx, sy)).cast("double") / F.when(det > 0, det.cast("double"))
    away = (exact(n, xd) - sx.cast("decimal(38,6)")).cast("double")  # n times the distance from the mean
    n_d = n.cast("double")
    pred = F.when((n > 0) & (det.cast("double") > min_var * n_d * n_d), (sy.cast("double") + slope * away) / n_d)
    out = (base.select(*TEST_KEY, "row_idx", "n_rows", pred.cast("decimal(18,3)").alias("prediction"))
           .where(_test_rows(base, share)))
    return out.select(*TEST_KEY, _fold(share).alias("fold"), "prediction",
                      F.abs(F.col("kwh").cast("decimal(18,3)") - F.col("prediction")).cast("decimal(18,3)").alias("abs_error"))


MONTHS = range(1, 13)


def walk_forward_ols(features: DataFrame, spec: FeatureSpec = WALK_SPEC, share: float = 0.8,
                     singular: float = ls.SINGULAR, chunked: bool = False,
                     variants: dict[str, list[str]] | None = None) -> DataFrame:
    """Multi-regressor walk-forward least squares via prefix sums and small solves.

    The numeric inputs are taken as decimals with 3 places and all sums are
    exact; month dummies need no products of their own (two different months
    never meet, a square is the dummy itself).  Rule for collinear inputs: see
    ``operators.least_squares``.  A fold with a null input before the test row
    gives no prediction.

    ``variants`` names models that leave out some numeric inputs (I16).  All are
    answered by the one scan: a variant's normal equations are rows and columns
    of the same sums.  Without it there is one model, "ols", of all inputs.
    """
    nums, months = list(spec.numeric), "month" in spec.categorical
    if set(spec.categorical) - {"month"}:
        raise ValueError("walk-forward dummies are built for the month category")
    num = [F.col(c).cast(READING_TYPE) for c in nums]
    y = F.col(spec.label).cast("decimal(18,0)")
    q, pairs = len(nums), [(i, j) for i in range(len(nums)) for j in range(i, len(nums))]
    of_month = [F.when(F.col("month") == m, F.lit(1)).otherwise(F.lit(0)) for m in MONTHS] if months else []
    long = lambda e: F.coalesce(e.cast("decimal(28,6)"), F.lit(0))
    sums = {"n": F.lit(1), "y": long(y)}
    sums |= {f"bad{i}": c.isNull().cast("int") for i, c in enumerate(num)}
    sums |= {f"x{i}": long(c) for i, c in enumerate(num)}
    sums |= {f"xy{i}": long(c * y) for i, c in enumerate(num)}
    sums |= {f"xx{i}_{j}": long(num[i] * num[j]) for i, j in pairs}
    for k, m in enumerate(of_month):
        sums |= {f"m{k}": m, f"my{k}": F.when(m == 1, long(y)).otherwise(F.lit(0))}
        sums |= {f"mx{k}_{i}": F.when(m == 1, long(c)).otherwise(F.lit(0)) for i, c in enumerate(num)}
    keep = list(dict.fromkeys([*TEST_KEY, "row_idx", "n_rows", *nums, *(["month"] if months else []), spec.label]))
    pre = _before(features.select(*keep), sums, chunked)
    # centred in the JVM, in decimals; n times every centred sum leaves as a double
    total = lambda k: F.col(f"_before_{k}").cast("decimal(27,6)")
    n = F.col("_before_n").cast("decimal(10,0)")
    p = q + len(of_month)
    first = [total(f"x{i}") for i in range(q)] + [total(f"m{k}") for k in range(len(of_month))]
    with_y = [total(f"xy{i}") for i in range(q)] + [total(f"my{k}") for k in range(len(of_month))]

    def product(i: int, j: int) -> F.Column:
        if j < q:
            return total(f"xx{i}_{j}")
        if i < q:
            return total(f"mx{j - q}_{i}")
        return total(f"m{i - q}") if i == j else F.lit(0).cast("decimal(27,6)")
    away = lambda both, a, b: ((n * both).cast("decimal(38,6)") - (a * b).cast("decimal(38,6)")).cast("double")
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    tests = pre.where(_test_rows(pre, share)).select(
        *TEST_KEY, "row_idx", "n_rows", n.cast("double").alias("_n"), total("y").cast("double").alias("_y"),
        F.array(*[F.col(f"_before_bad{i}").cast("double") for i in range(q)]).alias("_bad"),
        F.array(*[s.cast("double") for s in first]).alias("_first"),
        F.array(*[away(with_y[i], first[i], total("y")) for i in range(p)]).alias("_b"),
        F.array(*[away(product(i, j), first[i], first[j]) for i, j in upper]).alias("_c"),
        F.array(*[F.col(c).cast("double") for c in nums], *[m.cast("double") for m in of_month]).alias("_x"))
    chosen = {name: [i for i in range(p) if i >= q or nums[i] not in left_out]
              for name, left_out in (variants or {"ols": []}).items()}
    names = list(chosen)
    out_schema = T.StructType([*[features.schema[c] for c in [*TEST_KEY, "row_idx", "n_rows"]],
                               *[T.StructField(f"p{i}", T.DoubleType()) for i in range(len(names))]])

    def solve(batches):
        import numpy as np
        for pdf in batches:
            if not len(pdf):
                continue
            wide = lambda c: np.array(pdf[c].to_list(), float).reshape(len(pdf), -1)  # noqa: E731 (None becomes NaN)
            x, first_, b, bad = wide("_x"), wide("_first"), wide("_b"), wide("_bad")
            c = np.zeros((len(pdf), p, p))
            i, j = np.array(upper).T
            c[:, i, j] = c[:, j, i] = wide("_c")
            n_ = pdf["_n"].to_numpy(float)
            out = pdf[[*TEST_KEY, "row_idx", "n_rows"]].copy()
            for v, name in enumerate(names):
                some = np.array(chosen[name], int)
                numeric = [k for k in some if k < q]
                ok = (n_ > 0) & (bad[:, numeric] == 0).all(1) & np.isfinite(x[:, some]).all(1)
                pred = np.full(len(pdf), np.nan)
                if ok.any():
                    beta = ls.solve_many(c[ok][:, some][:, :, some], b[ok][:, some], singular)
                    apart = x[ok][:, some] - first_[ok][:, some] / n_[ok, None]
                    pred[ok] = pdf["_y"].to_numpy(float)[ok] / n_[ok] + (apart * beta).sum(1)
                out[f"p{v}"] = pred
            yield out

    solved = tests.mapInPandas(solve, out_schema)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"p{i}").alias("prediction"))
                               for i, name in enumerate(names)])).alias("v")
    return solved.select(*TEST_KEY, _fold(share).alias("fold"), each).select(
        *TEST_KEY, "fold", "v.model", F.when(~F.isnan("v.prediction"), F.col("v.prediction")).alias("prediction"))


def walk_forward_forest(features: DataFrame, spec: FeatureSpec = WALK_SPEC, share: float = 0.8,
                        trees: int = FOREST_TREES, max_depth: int | None = None, seed: int = 42,
                        bootstrap: bool = True) -> DataFrame:
    """Walk-forward forest: for every account and fold one forest on the account's rows before the test row.

    A test row that has none before it, or a null input, gets a null
    prediction, so no test row is left out.  As every fold is fitted anew, the
    work grows with the square of an account's rows; folds are dealt to tasks
    one by one, and those of very many rows are split further.
    """
    if set(spec.categorical) - {"month"} or spec.interactions:
        raise ValueError("walk-forward inputs are numbers and the month category")
    months = [(F.col("month") == m).cast("double") for m in MONTHS] if spec.categorical else []
    init = F.floor(F.col("n_rows") * F.lit(share)).cast("int")
    rows = _written(features.select(
        *TEST_KEY, F.array(*[F.col(c).cast("double") for c in spec.numeric], *months).alias("fx"),
        F.col(spec.label).alias("y"), F.col("row_idx").cast("int").alias("_at"), init.alias("_init"), F.col("n_rows").cast("int").alias("_n")))
    first = F.greatest(F.col("_at") - F.col("_init"), F.lit(0))
    later = F.when(first < F.col("_n") - F.col("_init"), F.sequence(first, F.col("_n") - F.col("_init") - 1))
    group = F.concat_ws(":", "account_id", "fold").alias("grp")
    train = rows.withColumn("fold", F.explode(later)).select(group, F.xxhash64(*TEST_KEY, "fold").alias("rid"), "fx", "y")
    tests = rows.filter(F.col("_at") > F.col("_init")).withColumn("fold", F.col("_at") - F.col("_init") - 1)
    keep = [*TEST_KEY, "fold"]
    got = forest_predictions(train, tests.select(group, "fx", *keep), keep, trees, seed, bootstrap, max_depth)
    return (tests.select(*keep).join(got.drop("n_trees"), keep, "left")
            .select(*TEST_KEY, "fold", F.lit("rf").alias("model"), "prediction"))


ACCOUNT_EFFECT_INPUTS = ["prev_pd_kwh", "prev_prev_pd_kwh", "days_passed", "tavg_interval_sum_sq",
                         "avg_kwh_for_cust_for_current_month"]


def account_effects(features: DataFrame, inputs: list[str] = ACCOUNT_EFFECT_INPUTS, t: str = "tavg_interval_sum",
                    label: str = "kwh", singular: float = 1e-7) -> DataFrame:
    """Least squares with every account as a category and account x temperature (the wider pooled setup).

    The per-account intercepts and slopes are partialled out: with grouped sums,
    each input and the target are replaced by their residuals on (1, t) of the
    account, whose pooled normal equations (one row of p * p numbers) give the
    common coefficients; each account's own two follow from its sums.  An
    account whose t never varies in training has only an intercept.  Accounts
    without training rows are not predicted.
    """
    import numpy as np

    cols = [*inputs, label]
    rows = _written(features.select(*TEST_KEY, "is_eval", F.col(t).cast("double").alias("_t"),
                                     *[F.col(c).cast("double").alias(f"_{c}") for c in cols]))
    train = rows.where(~F.col("is_eval")).na.drop()
    means = train.groupBy("account_id").agg(
        F.avg("_t").alias("_mt"), *[F.avg(f"_{c}").alias(f"_m_{c}") for c in cols])
    # deviations from the account's means first, so the sums do not cancel
    dev = train.join(means, "account_id").select(
        "account_id", (F.col("_t") - F.col("_mt")).alias("_dt"),
        *[(F.col(f"_{c}") - F.col(f"_m_{c}")).alias(f"_d_{c}") for c in cols])
    slopes = dev.groupBy("account_id").agg(
        F.sum(F.col("_dt") * F.col("_dt")).alias("_tt"),
        *[F.sum(F.col("_dt") * F.col(f"_d_{c}")).alias(f"_t_{c}") for c in cols])
    slopes = slopes.select("account_id", *[F.when(F.col("_tt") > 1e-9, F.col(f"_t_{c}") / F.col("_tt"))
                                           .otherwise(F.lit(0.0)).alias(f"_b_{c}") for c in cols])
    res = dev.join(slopes, "account_id").select(
        *[(F.col(f"_d_{c}") - F.col(f"_b_{c}") * F.col("_dt")).alias(c) for c in cols])
    p = len(inputs)
    got = res.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}")
                    for i in range(p + 1) for j in range(i, p + 1)]).first()
    g = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p + 1)] for i in range(p + 1)])
    scale = np.sqrt(np.where(np.diag(g)[:p] > 0, np.diag(g)[:p], 1.0))
    beta = np.linalg.pinv(g[:p, :p] / np.outer(scale, scale), rcond=singular, hermitian=True) @ (g[:p, p] / scale) / scale
    own = means.join(slopes, "account_id")
    common = lambda of: sum((F.col(of(c)) * F.lit(float(v)) for c, v in zip(inputs, beta)), F.lit(0.0))
    slope = F.col(f"_b_{label}") - common(lambda c: f"_b_{c}")
    at_mean = F.col(f"_m_{label}") - common(lambda c: f"_m_{c}")
    return (rows.where("is_eval").join(own, "account_id")
            .select(*TEST_KEY, F.lit("account_effects").alias("model"),
                    (at_mean + slope * (F.col("_t") - F.col("_mt")) + common(lambda c: f"_{c}")).alias("prediction")))


def pooled_ols1(features: DataFrame, x: str = "tavg_interval_sum", y: str = "kwh") -> DataFrame:
    """Intercept and slope of one pooled regressor over all training rows, one row."""
    train = features.where(~F.col("is_eval"))
    return train.agg(F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_slope(F.col(y), F.col(x)).alias("slope"))


def pooled_ols1_forecast(features: DataFrame, x: str = "tavg_interval_sum") -> DataFrame:
    """``pooled_ols1`` applied to every held-out row (the line is one row, so it is broadcast)."""
    line = F.broadcast(pooled_ols1(features, x))
    return (features.where("is_eval").join(line, F.lit(True))
            .select(*TEST_KEY, F.lit("ols1").alias("model"),
                    (F.col("intercept") + F.col("slope") * F.col(x)).cast("decimal(18,3)").alias("prediction")))


def walk_forward_errors(preds: DataFrame, name: str) -> DataFrame:
    """Walk-forward predictions -> long forecasts with the variant name."""
    return preds.select(*TEST_KEY, F.lit(name).alias("model"), F.col("prediction").cast("decimal(18,4)").alias("prediction"))


# ---------------------------------------------------------------- notebook regression (path D)

# The notebook's model inputs (renamed to this package's columns) and target.
NOTEBOOK_INPUTS = ["station_dist", "tavg_interval_avg", "todt_month", "daily_kwh_lag", "daily_kwh_updating_avg",
                   "month_avg_preceding_flag", "month_avg_preceding", "invoice_num"]
NOTEBOOK_TARGET = "avg_kwh_day_over_invoice"


CENTS = 100  # the notebook's target has two decimals


def _notebook_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*TEST_KEY, "split", F.array(*[F.col(c).cast("double") for c in NOTEBOOK_INPUTS]).alias("fx"),
                       (F.col(NOTEBOOK_TARGET) * CENTS).cast("long").alias("y"), F.xxhash64(*TEST_KEY).alias("rid"),
                       F.col(NOTEBOOK_TARGET).cast("double").alias("actual"))


def notebook_forests(split_rows: DataFrame, counts: list[int], max_depth: int | None = None, seed: int = 42) -> DataFrame:
    """Forests on the train split, predictions on the test split: key, actual, n_trees, prediction (I5, I14 input).

    One forest of the largest count is grown; a smaller one is its first trees.
    """
    rows = _written(_notebook_rows(split_rows)).withColumn("grp", F.lit(0))
    keep = [*TEST_KEY, "actual"]
    got = forest_predictions(rows.where("split = 'train'"), rows.where("split = 'test'"), keep, counts, seed, max_depth=max_depth)
    return got.withColumn("prediction", F.col("prediction") / CENTS)


def notebook_forest(split_rows: DataFrame, trees: int = FOREST_TREES, max_depth: int | None = None) -> DataFrame:
    return notebook_forests(split_rows, [trees], max_depth).drop("n_trees")


def tree_count_compare(split_rows: DataFrame, counts: list[int] = FOREST_GRID, max_depth: int | None = None) -> DataFrame:
    """Test MAE, MAE relative to mean use, and RMSE for each forest size."""
    err = F.col("actual") - F.col("prediction")
    return notebook_forests(split_rows, counts, max_depth).groupBy(F.col("n_trees").alias("num_trees")).agg(
        F.avg(F.abs(err)).alias("mae"), F.try_divide(F.avg(F.abs(err)), F.avg("actual")).alias("rel_mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"))


def fold_of(folds: int, seed: int) -> F.Column:
    """The fold of a row by the md5 of its key, the same in SQL."""
    return hash_bucket(seed, TEST_KEY, folds)


def grid_search(split_rows: DataFrame, counts: list[int] = FOREST_GRID, folds: int = CV_FOLDS, seed: int = 30,
                max_depth: int | None = None) -> DataFrame:
    """k-fold cross-validated R^2 for each forest size on the train split (I17): num_trees, cv_r2, best.

    One forest per fold, grown without the fold's rows, answers for all sizes.
    """
    rows = _written(_notebook_rows(split_rows.where("split = 'train'"))).withColumn("fold", fold_of(folds, seed))
    others = F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("fold"))
    train = rows.withColumn("grp", F.explode(others)).withColumn("rid", F.xxhash64("rid", "grp"))
    keep = [*TEST_KEY, "fold", "actual"]
    got = forest_predictions(train, rows.withColumn("grp", F.col("fold")), keep, counts, seed, max_depth=max_depth)
    return _cv_table(got.withColumns({"prediction": F.col("prediction") / CENTS, "num_trees": F.col("n_trees")}), "num_trees")


def _cv_table(predictions: DataFrame, variant: str) -> DataFrame:
    """Mean over folds of R^2 (1 - squared error / squared deviation from the fold's mean), and the best variant."""
    err = F.col("actual") - F.col("prediction")
    each = predictions.groupBy(variant, "fold").agg(
        (1 - F.try_divide(F.sum(err * err), F.var_pop("actual") * F.count(F.lit(1)))).alias("r2"))
    mean = each.groupBy(variant).agg(F.avg("r2").alias("cv_r2"))
    top = mean.agg(F.max_by(variant, F.struct("cv_r2", -F.col(variant))).alias("_top"))
    return mean.join(F.broadcast(top)).select(variant, "cv_r2", (F.col(variant) == F.col("_top")).alias("best"))


def cross_validated_line(rows: DataFrame, x: str, y: str, folds: int = CV_FOLDS, seed: int = 30) -> DataFrame:
    """(fold, r2) of a line fitted without the fold, from one scan.

    A fold's model needs the sums of all rows minus the fold's own, and its
    squared error is a polynomial of its own sums; nothing is fitted twice.
    A fold whose target, or the rest's regressor, does not vary has null.
    """
    xd, yd = F.col(x).cast("decimal(18,8)"), F.col(y).cast("decimal(18,8)")
    known = rows.select(fold_of(folds, seed).alias("fold"), xd.alias("x"), yd.alias("y")).na.drop()
    wide = lambda e: F.sum(e.cast("decimal(28,12)"))
    own = known.groupBy("fold").agg(F.count(F.lit(1)).cast("decimal(12,0)").alias("n"), wide(F.col("x")).alias("sx"),
                                    wide(F.col("y")).alias("sy"), wide(F.col("x") * F.col("x")).alias("sxx"),
                                    wide(F.col("x") * F.col("y")).alias("sxy"), wide(F.col("y") * F.col("y")).alias("syy"))
    names = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    total = own.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    d = lambda e: e.cast("double")
    rest = {c: d(F.col(f"t_{c}") - F.col(c)) for c in names}
    mx, my = rest["sx"] / rest["n"], rest["sy"] / rest["n"]
    slope = (rest["sxy"] - rest["sx"] * my) / F.nullif(rest["sxx"] - rest["sx"] * mx, F.lit(0.0))
    # sums of the fold around the rest's means, so that little cancels
    n, sx, sy, sxx, sxy, syy = (d(F.col(c)) for c in names)
    both = own.join(F.broadcast(total)).select("fold", n.alias("n"), slope.alias("b"), (sx - n * mx).alias("cx"), (sy - n * my).alias("cy"),
                                               (sxx - 2 * mx * sx + n * mx * mx).alias("cxx"), (syy - 2 * my * sy + n * my * my).alias("cyy"),
                                               (sxy - mx * sy - my * sx + n * mx * my).alias("cxy"), (syy - sy * sy / n).alias("sst"))
    sse = F.col("cyy") - 2 * F.col("b") * F.col("cxy") + F.col("b") * F.col("b") * F.col("cxx")
    return both.select("fold", (1 - sse / F.nullif("sst", F.lit(0.0))).cast("decimal(18,6)").alias("r2"))
