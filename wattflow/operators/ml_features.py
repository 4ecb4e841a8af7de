"""Feature assembly for the forecasting models.

Categories are one-hot encoded with no level dropped and an extra slot for
levels unseen at fit time, so the encoder is fitted on training rows only and
still keeps test rows with a new month (T18).  Interactions use
``pyspark.ml.feature.Interaction`` for any mix of categorical and numeric
inputs (T19).  Everything stays sparse vectors; nothing is expanded to
columns unless asked for (``encoded_columns``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CATEGORICAL = "categorical"
NUMERICAL = "numerical"


@dataclass
class FeatureSpec:
    """Columns of a model: numeric inputs, categories, interactions, target.

    ``interactions`` hold ``(a, b)`` or ``(a, b, kind_a, kind_b)`` with kinds
    ``"categorical"`` / ``"numerical"``; duplicates are dropped (T21).
    """
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    interactions: list[tuple] = field(default_factory=list)
    label: str = "kwh"

    def kinds(self, entry: tuple) -> tuple[str, str, str, str]:
        a, b = entry[0], entry[1]
        if len(entry) >= 4:
            return a, b, entry[2], entry[3]
        kind = lambda c: CATEGORICAL if c in self.categorical else NUMERICAL
        return a, b, kind(a), kind(b)

    def unique_interactions(self) -> list[tuple[str, str, str, str]]:
        seen, out = set(), []
        for e in self.interactions:
            k = self.kinds(e)
            if k not in seen:
                seen.add(k)
                out.append(k)
        return out

    def encoded(self) -> list[str]:
        cats = list(self.categorical)
        for a, b, ka, kb in self.unique_interactions():
            for c, k in ((a, ka), (b, kb)):
                if k == CATEGORICAL and c not in cats:
                    cats.append(c)
        return cats

    def without(self, columns: list[str]) -> "FeatureSpec":
        """The same spec with some inputs removed (ablation, I16)."""
        drop = set(columns)
        return FeatureSpec([c for c in self.numeric if c not in drop],
                           [c for c in self.categorical if c not in drop],
                           [e for e in self.interactions if e[0] not in drop and e[1] not in drop],
                           self.label)


def vec(c: str) -> str:
    return f"{c}_vec"


def feature_stages(spec: FeatureSpec, output: str = "features") -> list:
    cats = spec.encoded()
    stages: list = []
    if cats:
        stages.append(StringIndexer(inputCols=cats, outputCols=[f"{c}_idx" for c in cats],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in cats], outputCols=[vec(c) for c in cats],
                                    dropLast=False, handleInvalid="keep"))
    inter_cols = []
    for a, b, ka, kb in spec.unique_interactions():
        out = f"{a}_x_{b}"
        stages.append(Interaction(inputCols=[vec(a) if ka == CATEGORICAL else a,
                                             vec(b) if kb == CATEGORICAL else b], outputCol=out))
        inter_cols.append(out)
    inputs = list(spec.numeric) + [vec(c) for c in spec.categorical] + inter_cols
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return stages


def with_numeric_inputs(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Decimal model inputs as doubles; integer and double columns are used as they are."""
    from pyspark.sql.types import DecimalType
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema.fields
                           if isinstance(f.dataType, DecimalType)})


def fit_encoder(train: DataFrame, spec: FeatureSpec) -> PipelineModel:
    """Fit indexers on training rows only."""
    return Pipeline(stages=feature_stages(spec)).fit(with_numeric_inputs(train, spec))


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    """Readable names of a vector column's slots from its ML attribute metadata."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    n = meta.get("num_attrs")
    names: dict[int, str] = {}
    for group in meta.get("attrs", {}).values():
        for a in group:
            names[a["idx"]] = a.get("name", f"f{a['idx']}")
    size = n if n is not None else (max(names) + 1 if names else 0)
    return [names.get(i, f"f{i}") for i in range(size)]


def fitted_levels(model: PipelineModel, column: str) -> list[str]:
    """Levels the fitted indexer knows for ``column``, in vector order."""
    for st in model.stages:
        if hasattr(st, "labelsArray") and column in st.getInputCols():
            return list(st.labelsArray[st.getInputCols().index(column)])
    raise ValueError(f"no fitted levels for {column}")


def expand_vector(df: DataFrame, vector_col: str, names: list[str], keep: list[str]) -> DataFrame:
    """Plain columns from a vector column (for inspection and SQL checks)."""
    arr = vector_to_array(F.col(vector_col))
    return df.select(*keep, *[arr[i].alias(n) for i, n in enumerate(names)])


def level_numbers(train: DataFrame, column: str, number: str) -> DataFrame:
    """(column, number): the levels met in training, numbered from 0 in their order; a row a level."""
    levels = train.select(column).where(F.col(column).isNotNull()).distinct()
    return levels.select(column, (F.row_number().over(Window.orderBy(F.col(column).cast("string"))) - 1).alias(number))


def pair_slots(rows: DataFrame, train: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with the one slot of a category x category interaction that is not 0 (I2): ``slot``,
    counted as levels of a times levels of b, and ``slot_value`` 1.

    A level not met in training has no slot (null).  Neither the plan nor a row
    grows with the number of levels.
    """
    at_a, at_b = level_numbers(train, a, "_a"), level_numbers(train, b, "_b")
    many = train.agg(F.count_distinct(b).alias("_many"))
    joined = rows.join(at_a, a, "left").join(at_b, b, "left").join(F.broadcast(many))
    return joined.withColumns({"slot": F.col("_a").cast("long") * F.col("_many") + F.col("_b"), "slot_value": F.lit(1.0)}).drop("_a", "_b", "_many")
