"""Forecast evaluation: naive baselines, error frames and error tables.

Forecasts are kept long -- one row per (test row, model) -- so any number of
models is one DataFrame; ``pivot_predictions`` widens them on request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattflow.functions.numeric import dec4, mean4
from wattflow.operators.prefix import chunked_scan, ordered_scan, with_chunks
from wattflow.operators.windows import ORDER

# Names of the naive forecasts.
PREVIOUS = "previous"
EXPANDING = "expanding_mean"
SAME_MONTH = "same_month_mean"

TEST_KEY = ["account_id", "from_dt", "to_dt", "kwh"]


def naive_forecasts(features: DataFrame, share: float = 0.8, chunked: bool = False) -> DataFrame:
    """Previous value, expanding mean and same-month mean on the walk-forward test rows.

    Every baseline uses only rows before the test row (prefix windows), so no
    target leaks.  Long format: key, model, prediction (decimal, 4 places).
    """
    n_kwh = F.col("kwh").isNotNull().cast("long")
    of_account = {"kwh": F.col("kwh"), "n": n_kwh}
    of_month = {"m_kwh": F.col("kwh"), "m_n": n_kwh}
    if chunked:
        base = with_chunks(features, ["account_id"], ORDER)
        x = chunked_scan(base, ["account_id"], ORDER, of_account).drop("_n", "_rn")
        x = chunked_scan(x, ["account_id", "month"], ORDER, of_month, base=base)
    else:
        x = ordered_scan(features, ["account_id"], ORDER, of_account).drop("_n", "_rn")
        x = ordered_scan(x, ["account_id", "month"], ORDER, of_month)

    def mean(total, count):
        return mean4(F.col(total), F.when(F.col(count) > 0, F.col(count)))

    exp = mean("_before_kwh", "_before_n")
    mon = mean("_before_m_kwh", "_before_m_n")
    init = F.floor(F.col("n_rows") * F.lit(share)).cast("int")
    wide = (x.select(*TEST_KEY, "row_idx", init.alias("_init"),
                            F.col("prev_pd_kwh").cast("decimal(18,4)").alias(PREVIOUS),
                            exp.alias(EXPANDING), F.coalesce(mon, exp).alias(SAME_MONTH))
            .where(F.col("row_idx") > F.col("_init")))
    return wide.select(*TEST_KEY, F.expr(
        f"stack(3, '{PREVIOUS}', {PREVIOUS}, '{EXPANDING}', {EXPANDING}, '{SAME_MONTH}', {SAME_MONTH})"
        " AS (model, prediction)"))


def error_frame(forecasts: DataFrame, actual: str = "kwh", truncate: bool = False) -> DataFrame:
    """actual, predicted, signed, absolute and squared error per row.

    ``truncate=True`` cuts predictions to int first, as the reference does (T17).
    """
    pred = F.col("prediction")
    if truncate:
        pred = pred.cast("int").cast("decimal(18,4)")
    err = (F.col(actual).cast("decimal(18,4)") - pred).cast("decimal(18,4)")
    return forecasts.select("*", err.alias("error"), F.abs(err).alias("abs_error"),
                            (err * err).cast("decimal(38,8)").alias("sq_error"))


def _error_aggs():
    return [F.count(F.lit(1)).alias("n"),
            F.sum("abs_error").cast("decimal(28,4)").alias("ae"),
            mean4(F.sum("abs_error"), F.count("abs_error"), 4).alias("mae"),
            F.sqrt(F.sum("sq_error").cast("double") / F.count("sq_error").cast("double")).alias("rmse")]


def errors_by_account(errors: DataFrame) -> DataFrame:
    """AE, MAE, RMSE per account and model."""
    return errors.groupBy("account_id", "model").agg(*_error_aggs())


def errors_grand(errors: DataFrame) -> DataFrame:
    """Sum of accounts' AE and mean of accounts' MAE per model."""
    per = errors_by_account(errors)
    return per.groupBy("model").agg(F.count(F.lit(1)).alias("n_accounts"),
                                    F.sum("ae").cast("decimal(28,4)").alias("ae"),
                                    mean4(F.sum("mae"), F.count("mae"), 4).alias("mae"))


def errors_pooled(errors: DataFrame, actual: str = "kwh") -> DataFrame:
    """Pooled AE, MAE, MAE relative to mean use, RMSE per model."""
    agg = errors.groupBy("model").agg(*_error_aggs(), F.sum(actual).alias("_sum_actual"))
    # MAE / mean(actual) = AE / sum(actual)
    rel = dec4(F.try_divide(F.col("ae").cast("decimal(24,4)"), F.col("_sum_actual").cast("decimal(20,0)")))
    return agg.select("model", "n", "ae", "mae", rel.alias("rel_mae"), "rmse")


def best_worst_model(errors: DataFrame) -> DataFrame:
    """Per account, the model with the smallest and the largest AE; ties by name."""
    per = errors_by_account(errors)
    return per.groupBy("account_id").agg(
        F.min_by("model", F.struct(F.col("ae"), F.col("model"))).alias("best_model"),
        F.min_by("model", F.struct(-F.col("ae"), F.col("model"))).alias("worst_model"))


def pivot_predictions(forecasts: DataFrame, models: list[str]) -> DataFrame:
    """One ``predicted_<model>`` column per model."""
    keys = [c for c in forecasts.columns if c not in ("model", "prediction")]
    p = forecasts.groupBy(*keys).pivot("model", models).agg(F.first("prediction"))
    return p.select(*keys, *[F.col(m).alias(f"predicted_{m}") for m in models])
