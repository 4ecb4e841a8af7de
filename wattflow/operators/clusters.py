"""Monthly load curves and their clustering.

A load curve is an entity's mean value per calendar month, normalised to
shares of the twelve-month total.  Pivots run as one aggregation with partial
(map-side) combining; assigning curves to known centroids is a projection with
the k centroids inlined as literals (k is a parameter, so the inlined constants
are bounded and no join is needed).

K-means fits all its sets of centres (every k, every start) together: one scan
of the curves is one iteration of every set that still moves.  Curves are
integers (units of 1e-8), sums and costs are exact and centres are rounded to
the unit, so a fit does not depend on partitions and SQL gives the same one.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattflow.functions.numeric import argmin_label, fixed_ratio, sum_cols
from wattflow.operators.sampling import hash_key
from wattflow.session import ensure_checkpoint_dir

MONTHS = list(range(1, 13))
MONTH_COLS = [f"m_{m}" for m in MONTHS]
SHARE_COLS = [f"m_{m}_pct" for m in MONTHS]

# Fixed values from the reference's K-means runs.
KMEANS_MAX_ITER = 300
KMEANS_TOL = 1e-4
KMEANS_N_INIT = 10
KMEANS_K_MAX = 5
KMEANS_K_FINAL = 4
UNIT = 10 ** 8  # of a curve's shares, in K-means
POINTS = 200_000  # curves of a task in K-means


def load_pivot(points: DataFrame, entity: str, month: str = "month", value: str = "value",
               complete_only: bool = True) -> DataFrame:
    """entity x month table of mean values (D17); optionally complete rows only."""
    p = (points.groupBy(entity).pivot(month, MONTHS).agg(F.avg(value))
         .select(entity, *[F.col(str(m)).alias(c) for m, c in zip(MONTHS, MONTH_COLS)]))
    return p.na.drop(how="any", subset=MONTH_COLS) if complete_only else p


def load_shares(pivot: DataFrame, entity: str) -> DataFrame:
    """Each month's share of the curve's total over the months present.

    An entity whose total is 0 has no curve and is dropped.
    """
    total = sum_cols([F.coalesce(F.col(c), F.lit(0.0)) for c in MONTH_COLS])
    return (pivot.withColumn("_total", total).where(F.col("_total") != 0)
            .select(entity, *[F.try_divide(F.col(c), F.col("_total")).alias(s) for c, s in zip(MONTH_COLS, SHARE_COLS)]))


def seed_centroids(shares: DataFrame, entity: str, k: int, seed: int) -> list[list[float]]:
    """k curves chosen by seeded hash order, as centroid coordinates (k rows to the driver)."""
    rows = shares.orderBy(hash_key(seed, entity)).limit(k).select(*SHARE_COLS).collect()
    if len(rows) < k:
        raise ValueError(f"need {k} curves to seed {k} centroids, found {len(rows)}")
    return [[float(r[c]) for c in SHARE_COLS] for r in rows]


def _distance(centre: list[float]) -> F.Column:
    """Euclidean distance, absent months contributing 0."""
    terms = []
    for c, v in zip(SHARE_COLS, centre):
        d = F.col(c) - F.lit(float(v))
        terms.append(F.coalesce(d * d, F.lit(0.0)))
    return F.sqrt(sum_cols(terms))


def nearest_centroid(shares: DataFrame, entity: str, centroids: list[list[float]]) -> DataFrame:
    """Cluster index of the closest centroid and the distance to it."""
    dists = [_distance(c) for c in centroids]
    best = argmin_label(dists, list(range(len(centroids))))
    x = shares.select(entity, F.array(*dists).alias("_d"), best.alias("cluster"))
    return x.select(entity, F.col("cluster").cast("int").alias("cluster"),
                    F.element_at("_d", F.col("cluster") + 1).alias("distance"))


def cluster_shares(labels: DataFrame) -> DataFrame:
    """Members per cluster and their share (D19, D20); the window spans k rows."""
    counts = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("cluster", "n", fixed_ratio(F.col("n"), total, 10, 4).alias("pct"))


def label_rows(rows: DataFrame, labels: DataFrame, key: str, label_col: str = "load_curve_cluster") -> DataFrame:
    """Every row with its entity's cluster; -1 / "-1" where absent."""
    lab = labels.select(key, F.col("cluster").alias(label_col))
    return rows.join(lab, key, "left").na.fill(-1).na.fill("-1")


def kmeans_one_cost(shares: DataFrame) -> DataFrame:
    """k=1 K-means cost: squared distance to the mean curve (Spark's KMeans refuses k=1)."""
    mu = shares.agg(*[F.avg(c).alias(c) for c in SHARE_COLS]).first()  # 12 numbers
    if mu[SHARE_COLS[0]] is None:
        return shares.agg(F.lit(0.0).alias("cost"))
    sq = sum_cols([(F.col(c) - F.lit(float(mu[c]))) * (F.col(c) - F.lit(float(mu[c]))) for c in SHARE_COLS])
    return shares.agg(F.coalesce(F.sum(sq), F.lit(0.0)).alias("cost"))


Sets = dict[tuple[int, int], list[list[int]]]  # centres of every (k, start)


def curve_points(shares: DataFrame, entity: str) -> DataFrame:
    """(entity, p) of the complete curves, in units, written once for all scans of a fit; as many
    partitions as the curves ask for, as each makes a row for every centre and scan."""
    ensure_checkpoint_dir(shares.sparkSession)
    points = (shares.na.drop(subset=SHARE_COLS)
              .select(F.col(entity).alias("entity"), F.array(*[F.round(F.col(c) * UNIT).cast("long") for c in SHARE_COLS]).alias("p"))
              .checkpoint(eager=True))
    return points.repartition(max(1, -(-points.count() // POINTS))).checkpoint(eager=True)


def _distances(points: np.ndarray, centres: list[list[int]]) -> np.ndarray:
    """Squared distances, curves x centres, exact in 64 bits."""
    return np.stack([((points - np.array(c, np.int64)) ** 2).sum(1) for c in centres], axis=1)


def _hashed(seed: int, start: int, step: int) -> F.Column:
    """32 bits of a curve's md5 for one draw."""
    return F.conv(F.substring(hash_key(seed, F.lit(start), F.lit(step), "entity"), 1, 8), 16, 10).cast("long")


def seed_sets(points: DataFrame, k: int, n_init: int, seed: int) -> dict[int, list[list[int]]]:
    """Per start the first k centres, drawn as k-means++ does by hashes of the curves.

    A curve is drawn with chances in proportion to its squared distance from
    the centres so far: the smallest -ln(u) / distance wins, u from the hash,
    ties by entity.  The first draw, and one when every curve is a centre
    already, takes the smallest hash.  One scan for a draw of all starts.
    """
    chosen: dict[int, list[list[int]]] = {s: [] for s in range(n_init)}
    entity = points.schema["entity"].dataType.simpleString()
    for step in range(k):
        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple] = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                p, h = np.stack(pdf["p"].to_list()), np.stack(pdf["h"].to_list())
                names = pdf["entity"].to_numpy()
                for s, centres in chosen.items():
                    race = np.full(len(p), np.inf)
                    if centres:
                        d = _distances(p, centres).min(1)
                        race[d > 0] = -np.log((h[d > 0, s] + 0.5) / 2 ** 32) / d[d > 0]
                    i = np.lexsort((names, h[:, s], race) if np.isinf(race).all() else (names, race))[0]
                    new = (race[i], int(h[i, s]) if np.isinf(race[i]) else 0, names[i], p[i])
                    if s not in best or new[:3] < best[s][:3]:
                        best[s] = new
            yield pd.DataFrame([(s, *b) for s, b in best.items()], columns=["start", "race", "h", "entity", "p"])
        hashes = F.array(*[_hashed(seed, s, step) for s in range(n_init)]).alias("h")
        best = (points.select("entity", "p", hashes)
                .mapInPandas(draw, f"start int, race double, h long, entity {entity}, p array<long>").repartition(1)
                .groupBy("start").agg(F.min_by("p", F.struct("race", "h", "entity")).alias("p")))
        for r in best.collect():  # one row a start
            chosen[r.start].append(list(r.p))
    return chosen


def _scan(points: DataFrame, sets: Sets, cost: bool) -> list:
    """One scan for all sets: per (k, start, cluster) the number of curves and their sums, or their cost.

    A task gives one row for every centre, so few that one task can add them up.
    """
    names = list(sets)
    sums = [f"s{m}" for m in MONTHS]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {(i, c): [0, 0, 0, np.zeros(12, np.int64)] for i, name in enumerate(names) for c in range(len(sets[name]))}
        for pdf in batches:
            p = np.stack(pdf["p"].to_list()) if len(pdf) else np.zeros((0, 12), np.int64)
            for i, name in enumerate(names):
                d = _distances(p, sets[name])
                label = d.argmin(1)  # ties to the smaller cluster
                for c in np.unique(label):
                    mine, total = label == c, totals[i, int(c)]
                    least = d[mine, c] if cost else np.zeros(1, np.int64)
                    total[0] += int(mine.sum())
                    # in two parts, as the sum may pass 64 bits
                    total[1] += int((least >> 32).sum())
                    total[2] += int((least & 0xFFFFFFFF).sum())
                    total[3] += p[mine].sum(0)
        out = [(*key, n, high, low, *total.tolist()) for key, (n, high, low, total) in totals.items() if n]
        yield pd.DataFrame(out, columns=["set", "cluster", "n", "high", "low", *sums])
    fields = ", ".join(f"{c} long" for c in ["n", "high", "low", *sums])
    rows = points.select("p").mapInPandas(partial, f"set int, cluster int, {fields}").repartition(1).groupBy("set", "cluster").agg(
        *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ["n", "high", "low", *sums]]).collect()
    return [(names[r["set"]], r["cluster"], int(r["n"]), [int(r[c]) for c in sums], (int(r["high"]) << 32) + int(r["low"]))
            for r in rows]


def fit_sets(points: DataFrame, ks: list[int], n_init: int = KMEANS_N_INIT, seed: int = 42,
             max_iter: int = KMEANS_MAX_ITER, tol: float = KMEANS_TOL) -> tuple[Sets, dict[tuple[int, int], int]]:
    """Centres and cost (squared units) of every (k, start).

    A set stops on its own when none of its centres moves by more than ``tol``
    or after ``max_iter`` iterations.  A centre without curves stays where it is.
    The driver holds the centres alone.
    """
    starts = seed_sets(points, max(ks), n_init, seed)
    if not starts[0]:
        return {}, {}
    sets: Sets = {(k, s): [list(c) for c in centres[:k]] for k in ks for s, centres in starts.items()}
    moving = set(sets)
    for _ in range(max_iter):
        if not moving:
            break
        shift = dict.fromkeys(moving, 0)
        for name, c, n, total, _ in _scan(points, {s: sets[s] for s in moving}, cost=False):
            centre = [(2 * v + n) // (2 * n) for v in total]
            shift[name] = max(shift[name], sum((a - b) ** 2 for a, b in zip(centre, sets[name][c])))
            sets[name][c] = centre
        moving = {name for name in moving if shift[name] > round(tol * UNIT) ** 2}
    cost = dict.fromkeys(sets, 0)
    for name, _, _, _, part in _scan(points, sets, cost=True):
        cost[name] += part
    return sets, cost


def _best_start(cost: dict[tuple[int, int], int], k: int) -> tuple[int, int]:
    return min((name for name in cost if name[0] == k), key=lambda name: (cost[name], name[1]))


def kmeans_sweep(spark: SparkSession, shares: DataFrame, entity: str, k_max: int = KMEANS_K_MAX,
                 n_init: int = KMEANS_N_INIT, seed: int = 42) -> DataFrame:
    """Cost and score (minus cost) of the best start for k = 1..k_max (I19); no rows without curves."""
    _, cost = fit_sets(curve_points(shares, entity), list(range(1, k_max + 1)), n_init, seed)
    rows = [(k, (Decimal(cost[_best_start(cost, k)]) / UNIT ** 2).quantize(Decimal("1e-10"), ROUND_HALF_UP))
            for k in range(1, k_max + 1) if cost]
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("cost", T.DecimalType(20, 10))])
    return spark.createDataFrame(rows, schema).withColumn("score", (-F.col("cost")).cast("decimal(20,10)"))


def best_centres(points: DataFrame, k: int = KMEANS_K_FINAL, n_init: int = KMEANS_N_INIT, seed: int = 42) -> list[list[int]]:
    """The k centres of the best start, in units; none without curves."""
    sets, cost = fit_sets(points, [k], n_init, seed)
    return sets[_best_start(cost, k)] if cost else []


def label_points(points: DataFrame, entity: str, centres: list[list[int]]) -> DataFrame:
    """(entity, cluster): the nearest centre of every curve, ties to the smaller number."""
    if not centres:
        return points.limit(0).select(F.col("entity").alias(entity), F.lit(0).alias("cluster"))
    square = lambda a, b: (a - b) * (a - b)
    far = [sum_cols([square(F.col("p")[i], F.lit(v)) for i, v in enumerate(c)]) for c in centres]
    return points.select(F.col("entity").alias(entity), argmin_label(far, list(range(len(centres)))).cast("int").alias("cluster"))


def kmeans_labels(shares: DataFrame, entity: str, k: int = KMEANS_K_FINAL,
                  n_init: int = KMEANS_N_INIT, seed: int = 42) -> DataFrame:
    """Final K-means labels per curve."""
    points = curve_points(shares, entity)
    return label_points(points, entity, best_centres(points, k, n_init, seed))


def kmeans_centroids(spark: SparkSession, shares: DataFrame, entity: str, k: int = KMEANS_K_FINAL,
                     n_init: int = KMEANS_N_INIT, seed: int = 42) -> DataFrame:
    """Centroids of the final fit as shares, one row per cluster."""
    rows = [(i, *[v / UNIT for v in c]) for i, c in enumerate(best_centres(curve_points(shares, entity), k, n_init, seed))]
    schema = T.StructType([T.StructField("cluster", T.IntegerType())]
                          + [T.StructField(c, T.DoubleType()) for c in SHARE_COLS])
    return spark.createDataFrame(rows, schema)
