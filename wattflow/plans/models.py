"""Path B/D tails: encoders, pooled and walk-forward forecasts, notebook regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattflow.operators import evaluate as ev
from wattflow.operators import forecast as fc
from wattflow.operators import ml_features as mf
from wattflow.operators import quality as qa
from wattflow.operators import sampling as smp
from wattflow.plans import matched
from wattflow.sources.fixtures import Domain

KEY = ["account_id", "from_dt", "to_dt", "kwh"]
MONTH_SPEC = mf.FeatureSpec(numeric=[], categorical=["month"])
MONTH_TEMP_SPEC = mf.FeatureSpec(numeric=[], interactions=[("month", "tavg_interval_sum", "categorical", "numerical")])


def onehot_month(features: DataFrame) -> DataFrame:
    """Month dummies from an encoder fitted on training rows (I1), as plain columns."""
    model = mf.fit_encoder(features.where(~F.col("is_eval")), MONTH_SPEC)
    levels = mf.fitted_levels(model, "month")
    names = [f"month_{lv}" for lv in levels] + ["month_other"]
    return mf.expand_vector(model.transform(features), "month_vec", names, KEY + ["month"])


def interaction_month_temp(features: DataFrame) -> DataFrame:
    """Month x interval-temperature interaction (I2) as plain columns."""
    model = mf.fit_encoder(features.where(~F.col("is_eval")), MONTH_TEMP_SPEC)
    levels = mf.fitted_levels(model, "month")
    names = [f"month_{lv}_x_tavg" for lv in levels] + ["month_other_x_tavg"]
    return mf.expand_vector(model.transform(features), "month_x_tavg_interval_sum", names,
                            KEY + ["month", "tavg_interval_sum"])


def pooled(features: DataFrame, names: list[str], trees: int = fc.FOREST_TREES, max_depth: int | None = None) -> DataFrame:
    reg = fc.algorithm_registry(trees=trees, max_depth=max_depth)
    return fc.pooled_forecast(features, fc.POOLED_SPEC, {n: reg[n] for n in names})


def _ablation_errors(with_t: DataFrame, without: DataFrame) -> DataFrame:
    """Grand error table of two variants over the rows that both predict (I16).

    ``n_unpredicted`` are the variant's test rows without a prediction.
    """
    a = fc.walk_forward_errors(with_t, WITH)
    b = fc.walk_forward_errors(without, WITHOUT)
    tests = a.unionByName(b).groupBy("model").agg(F.count_if(F.col("prediction").isNull()).alias("n_unpredicted"))
    a, b = (x.where(F.col("prediction").isNotNull()) for x in (a, b))
    both = a.join(b.select(*KEY), KEY, "left_semi").unionByName(b.join(a.select(*KEY), KEY, "left_semi"))
    grand = ev.errors_grand(ev.error_frame(both))
    return (tests.join(grand, "model", "left")
            .select(F.col("model").alias("variant"), F.coalesce("n_accounts", F.lit(0).cast("long")).alias("n_accounts"),
                    "ae", "mae", "n_unpredicted"))


WITH, WITHOUT = "with_temperature", "without_temperature"


def temp_ablation(features: DataFrame) -> DataFrame:
    """Walk-forward linear forecasts with and without temperature, from one scan; grand error table (I16)."""
    both = fc.walk_forward_ols(features, fc.WALK_SPEC, variants={WITH: [], WITHOUT: fc.TEMPERATURE_COLUMNS})
    both = fc._written(both)
    return _ablation_errors(*[both.where(F.col("model") == m) for m in (WITH, WITHOUT)])


def temp_ablation_rf(features: DataFrame, trees: int = fc.FOREST_TREES, max_depth: int | None = None) -> DataFrame:
    """The same with the forest, as the reference compares it (I16)."""
    return _ablation_errors(*[fc.walk_forward_forest(features, spec, trees=trees, max_depth=max_depth)
                              for spec in (fc.WALK_SPEC, fc.WALK_SPEC.without(fc.TEMPERATURE_COLUMNS))])


def model_errors(preds: DataFrame) -> DataFrame:
    """Error frame of any model's long forecasts."""
    return ev.error_frame(preds.withColumn("prediction", F.col("prediction").cast("decimal(18,4)")))


def interaction_pairs(features: DataFrame) -> DataFrame:
    """Category x category and number x number interactions (I2): the one category pair of
    a row (null for a level unseen in training), its value, and the product."""
    paired = mf.pair_slots(features, features.where(~F.col("is_eval")), "month", "station_id")
    name = F.when(F.col("slot").isNotNull(), F.concat_ws(":", F.col("month").cast("string"), "station_id"))
    return paired.select(*KEY, name.alias("month_station"), F.col("slot_value").alias("pair_value"),
                         (F.col("tavg_interval_sum").cast("double") * F.col("days_passed")).alias("tavg_x_days"))


def notebook_split(d: Domain, seed: int = 42) -> DataFrame:
    """Clean one-station rows (R5 filters, fill 0) with a hashed 66.6/33.4 split."""
    rows = qa.clean_rows(matched.matched_table_1(d))
    rows = qa.select_present(rows, KEY + fc.NOTEBOOK_INPUTS + [fc.NOTEBOOK_TARGET]).na.fill(0)
    return smp.hash_split(rows, seed, KEY)


def notebook_errors(d: Domain, max_depth: int | None = None) -> DataFrame:
    """Error frame of the notebook's forest on the test split."""
    p = fc.notebook_forest(notebook_split(d), max_depth=max_depth)
    err = F.col("actual") - F.col("prediction")
    return p.select("*", err.alias("error"), F.abs(err).alias("abs_error"), (err * err).alias("sq_error"))
