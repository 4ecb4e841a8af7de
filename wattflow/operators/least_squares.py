"""Pooled least squares from one scan.

The Gram matrix of a model is assembled from grouped sums: rows are grouped by
the levels of all categories, and a group's sums of products of the numbers give
every entry between numbers, dummies and interactions, as a dummy is 1 in its
groups and 0 elsewhere.  Neither a wide vector per row nor an iterative solver
is needed.  Numbers are decimals with 4 places, so the sums are exact; they are
centred as integers and become doubles only then.

Rule for collinear slots, as in the walk-forward fit: of the centred slots, each
scaled to length one, directions with singular values below ``singular`` times
the largest are cut; of the solutions left, that of smallest norm in the
original units is taken.  The intercept is not part of the norm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattflow.operators.ml_features import CATEGORICAL, FeatureSpec

SINGULAR = 1e-5  # directions with less than this share of the largest singular value count as collinear
PLACES = 4
CELLS = 100_000  # groups and slots that the driver takes for one model
SLOTS = 4_000

_NUMBER = "decimal(18,4)"


def solve_centred(c: np.ndarray, b: np.ndarray, singular: float = SINGULAR) -> np.ndarray:
    """Coefficients from centred sums of products, by the rule for collinear slots."""
    beta = np.zeros(len(b))
    scale = np.sqrt(np.diag(c))
    moves = scale > 0
    if not moves.any():
        return beta
    d = scale[moves]
    values, vectors = np.linalg.eigh(c[np.ix_(moves, moves)] / np.outer(d, d))
    real = values > singular ** 2 * values[-1]
    some = (vectors[:, real] @ ((vectors[:, real].T @ (b[moves] / d)) / values[real])) / d
    if (~real).any():  # smallest norm in the original units
        free, _ = np.linalg.qr(vectors[:, ~real] / d[:, None])
        some = some - free @ (free.T @ some)
    beta[moves] = some
    return beta


def solve_many(c: np.ndarray, b: np.ndarray, singular: float = SINGULAR) -> np.ndarray:
    """``solve_centred`` of a stack of systems at once."""
    scale = np.sqrt(np.diagonal(c, axis1=1, axis2=2))
    d = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(c / (d[:, :, None] * d[:, None, :]))
    real = values > np.maximum(singular ** 2 * values[:, -1:], 0)
    inner = np.where(real, np.einsum("nij,ni->nj", vectors, b / d) / np.where(real, values, 1.0), 0.0)
    beta = np.einsum("nij,nj->ni", vectors, inner) / d
    # smallest norm in the original units: take out what lies in the cut directions
    # (eigenvalues ascend, so these come first, and as many columns of q span them)
    free, _ = np.linalg.qr(vectors * ~real[:, None, :] / d[:, :, None])
    free = free * ~real[:, None, :]
    return beta - np.einsum("nij,nj->ni", free, np.einsum("nij,ni->nj", free, beta))


def centred(n: int, gram: list[list[int]], first: list[int], with_y: list[int], sy: int, unit: int):
    """n times the centred sums of integers in units of ``unit`` squared, rounded to doubles only here."""
    p = range(len(first))
    c = np.array([[(n * gram[i][j] - first[i] * first[j]) / unit ** 2 for j in p] for i in p])
    b = np.array([(n * with_y[i] - first[i] * sy) / unit ** 2 for i in p])
    return c.reshape(len(first), len(first)), b


@dataclass
class Slot:
    """One column of the model: a number or 1, where the categories have these levels."""
    name: str
    number: str | None
    levels: dict[str, str]


def _number(spec_number: str) -> Column:
    """A number of the model: a column, or a product of two ("a*b")."""
    a, _, b = spec_number.partition("*")
    x = F.col(a).cast(_NUMBER)
    return (x * F.col(b).cast(_NUMBER)).cast("decimal(28,4)") if b else x


def _slots(spec: FeatureSpec, levels: dict[str, list[str]]) -> list[Slot]:
    """Numbers, dummies of the levels met in training (none dropped), interactions; names as a reader would say them."""
    out = [Slot(c, c, {}) for c in spec.numeric]
    out += [Slot(f"{c}={v}", None, {c: v}) for c in spec.categorical for v in levels[c]]
    for a, b, ka, kb in spec.unique_interactions():
        if ka != CATEGORICAL and kb == CATEGORICAL:
            a, b, ka, kb = b, a, kb, ka
        if ka != CATEGORICAL:
            out.append(Slot(f"{a}*{b}", f"{a}*{b}", {}))
        elif kb != CATEGORICAL:
            out += [Slot(f"{a}={v}*{b}", b, {a: v}) for v in levels[a]]
        else:
            out += [Slot(f"{a}={v}*{b}={w}", None, {a: v, b: w}) for v in levels[a] for w in levels[b]]
    return out


@dataclass
class LinearModel:
    intercept: float
    slots: list[Slot]
    coefficients: np.ndarray

    def prediction(self) -> Column:
        """The model as an expression: per category and number one map from level to coefficient."""
        out = F.lit(float(self.intercept))
        grouped: dict[tuple, dict[str, float]] = {}
        for s, v in zip(self.slots, self.coefficients):
            grouped.setdefault((s.number, *s.levels), {})["\x00".join(s.levels.values())] = float(v)
        for (number, *categories), by_level in grouped.items():
            x = F.lit(1.0) if number is None else _number(number).cast("double")
            if categories:
                key = F.concat_ws("\x00", *[F.col(c).cast("string") for c in categories])
                table = F.create_map(*[F.lit(v) for kv in by_level.items() for v in kv])
                coefficient = F.coalesce(F.try_element_at(table, key), F.lit(0.0))  # a level not met in training
            else:
                [coefficient] = [F.lit(v) for v in by_level.values()]
            out = out + coefficient * x
        return out


def fit(train: DataFrame, spec: FeatureSpec, singular: float = SINGULAR) -> LinearModel:
    """Least squares with intercept over ``train`` in one scan.

    Rows with a null input or target are left out.  The driver takes one row of
    sums for every combination of category levels met (at most ``CELLS``).
    """
    categories = spec.encoded()
    numbers = list(dict.fromkeys(s.number for s in _slots(spec, {c: ["x"] for c in categories}) if s.number))
    values = [F.lit(1).cast("decimal(1,0)"), *[_number(c) for c in numbers], F.col(spec.label).cast(_NUMBER)]
    q = len(values)
    rows = train.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categories)],
                        *[v.alias(f"v{i}") for i, v in enumerate(values)]).na.drop()
    product = lambda i, j: F.sum((F.col(f"v{i}") * F.col(f"v{j}")).cast("decimal(38,8)")).alias(f"p{i}_{j}")
    cells = (rows.groupBy(*[f"c{i}" for i in range(len(categories))])
             .agg(*[product(i, j) for i in range(q) for j in range(i, q)]).limit(CELLS + 1).collect())
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} combinations of levels: use account_effects for categories of many levels")
    if not cells or not any(r["p0_0"] for r in cells):
        raise ValueError("no training rows")
    levels = {c: sorted({r[f"c{i}"] for r in cells}) for i, c in enumerate(categories)}
    slots = _slots(spec, levels)
    if len(slots) > SLOTS:
        raise ValueError(f"more than {SLOTS} slots: use account_effects for categories of many levels")
    unit = 10 ** PLACES
    p = len(slots)
    gram, first, with_y = [[0] * p for _ in range(p)], [0] * p, [0] * p
    n = sy = 0
    at = {None: 0, **{c: i + 1 for i, c in enumerate(numbers)}}
    for r in cells:
        met = {c: r[f"c{i}"] for i, c in enumerate(categories)}
        total = {(i, j): int((r[f"p{i}_{j}"] or 0) * unit ** 2) for i in range(q) for j in range(i, q)}
        of = lambda i, j: total[min(i, j), max(i, j)]
        active = [(k, at[s.number]) for k, s in enumerate(slots) if all(met[c] == v for c, v in s.levels.items())]
        n, sy = n + of(0, 0) // unit ** 2, sy + of(0, q - 1) // unit
        for k, i in active:
            first[k] += of(0, i) // unit
            with_y[k] += of(i, q - 1)
            for m, j in active:
                gram[k][m] += of(i, j)
    c, b = centred(n, gram, first, with_y, sy, unit)
    beta = solve_centred(c, b, singular)
    mean = np.array([v / unit / n for v in first])
    return LinearModel(sy / unit / n - float(mean @ beta), slots, beta)
