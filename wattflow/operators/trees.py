"""Forests of full trees with exact splits, for one pooled table or many small groups.

A tree is grown level by level until every leaf is pure (or its rows have the
same inputs).  A split is the best of all thresholds between neighbouring
values of all features: the one of largest

    SL * SL / NL + SR * SR / NR

(sums of the target and of the weights left and right).  Targets are integers,
so the sums are exact and a split does not depend on the order of the rows;
equal scores go to the feature that comes first, then to the smallest
threshold, which lies midway between the two values.  A part of a tree that no
test row comes to is not grown, as nothing is asked of it.

Rows carry (group, tree, node).  Where these go depends on the rows of a group:

* up to SMALL_ROWS: many groups and all their trees are grown in one task, a
  level of all of them at a time (of PATH_ROWS rows and one test row, only the
  nodes that this row passes: ``follow``);
* up to WHOLE_ROWS: a task grows some trees of one group;
* beyond: rows are written once; nodes are split from sums per bin and then per
  value of the few bins that can hold the best split, until they hold at most
  WHOLE_ROWS rows; the rest of the trees is grown some trees a round.  The loops
  over (row, tree) pairs run in the JVMs (``kernel``), by the same rule.

A group's bootstrap draws a Poisson(1) weight for every row and tree from a
hash of the row's id, so it is the same on every path and on every cluster.  A
tree whose weights are all 0 takes every row once.  Test rows travel with the
rows of their group and leave with the sums of their leaves' means: no model is
collected; the driver keeps only the splits of nodes beyond WHOLE_ROWS rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattflow.operators import kernel
from wattflow.session import ensure_checkpoint_dir, fit_partitions

SMALL_ROWS = 2_000
WHOLE_ROWS = 500_000
TREES_PER_TASK = 5
# (row, tree) pairs that a task is given of small groups, and grows at a time.
BUNDLE = 2_000_000
STRIP = 400_000
# Rows that a task is given of small groups at most, whatever the number of trees.
BUNDLE_ROWS = 100_000
# Units of at most so many rows and one test row follow that row alone; numbers of a block of them.
PATH_ROWS = 32
PATH_CELLS = 1_000_000
# A feature with fewer values than this share that are not 0 is scanned by those alone.
SPARSE = 0.3
MOST_TASKS = 20_000


def _mixed(z: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def bag_weights(rid: np.ndarray, tree: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weight of each (row id, tree)."""
    with np.errstate(over="ignore"):
        z = rid.astype(np.int64).view(np.uint64) + (tree.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = _mixed(z ^ _mixed(np.full(1, seed, np.uint64)))
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0 ** -53, side="right").astype(float)


def _entries(x: np.ndarray, o: np.ndarray, sparse: bool, row, node, w, wy, sw, sy):
    """(node, value, weight, weighted target) of a feature's instances, by node and value in it.

    Of a sparse feature ``o`` has the instances that are not 0; those that are
    stand in each node as one entry, which has what the others leave of its sums
    (a node of zeros alone has no entry, as the feature cannot split it).
    """
    v, s, ew, ey = x[row[o]], node[o], w[o], wy[o]
    if sparse and len(s):
        begin = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1]
        there = s[begin]
        zero_w, zero_y = sw[there] - np.add.reduceat(ew, begin), sy[there] - np.add.reduceat(ey, begin)
        at = begin + np.add.reduceat((v < 0).astype(np.int64), begin)
        some = zero_w > 0
        at, there = at[some], there[some]
        v, s = np.insert(v, at, 0.0), np.insert(s, at, there)
        ew, ey = np.insert(ew, at, zero_w[some]), np.insert(ey, at, zero_y[some])
    return s, v, ew, ey


def grow(x: np.ndarray, y: np.ndarray, row: np.ndarray, node: np.ndarray, w: np.ndarray,
         tx: np.ndarray, trow: np.ndarray, tnode: np.ndarray, max_depth: int | None = None) -> np.ndarray:
    """The leaf mean of every test instance, after growing all trees a level at a time.

    ``row``, ``node`` and ``w`` are the training instances (row of ``x`` and
    ``y``, root, weight above 0), ``trow`` and ``tnode`` the test instances
    (row of ``tx``, root).  A test instance of a root without training gets NaN.
    """
    out = np.full(len(trow), np.nan)
    asked = np.isin(node, tnode)
    row, node, w = row[asked], node[asked], w[asked]
    names, node = np.unique(node, return_inverse=True)
    at = np.searchsorted(names, tnode).clip(max=max(len(names) - 1, 0))
    test = np.flatnonzero(names[at] == tnode) if len(names) else np.zeros(0, np.int64)
    tnode, node = at, node.astype(np.int32)
    target, wy = y[row], w * y[row]
    live = [j for j in range(x.shape[1]) if len(x) and x[:, j].min() < x[:, j].max()]
    column = {j: np.ascontiguousarray(x[:, j]) for j in live}
    sparse = {j for j in live if np.count_nonzero(column[j]) < SPARSE * len(x)}
    # the instances by node, and by value in each node, for every feature that varies
    orders = {}
    for j in live:
        o = np.flatnonzero(column[j][row]) if j in sparse else np.arange(len(row))
        # values by their rank, so that node and value are one number; trees of one unit share its ranks
        rank = np.unique(column[j], return_inverse=True)[1]
        orders[j] = o[np.argsort(node[o].astype(np.int64) * len(x) + rank[row[o]])].astype(np.int32)
    some = np.argsort(node, kind="stable").astype(np.int32)
    row = row.astype(np.int32)
    stays = np.zeros(len(row), bool)
    k, depth = len(names), 0
    while k and len(test):
        counts = np.bincount(node[some], minlength=k)
        starts = np.cumsum(counts) - counts
        sw, sy = np.add.reduceat(w[some], starts), np.add.reduceat(wy[some], starts)
        own = target[some]
        impure = np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)
        if max_depth is not None and depth >= max_depth:
            impure[:] = False
        best, feature, cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k)
        for j in live if impure.any() else ():
            seg, v, ew, ey = _entries(column[j], orders[j], j in sparse, row, node, w, wy, sw, sy)
            if not len(seg):
                continue
            same = seg[1:] == seg[:-1]
            i = np.flatnonzero(same & (v[:-1] < v[1:]) & impure[seg[:-1]])
            if not len(i):
                continue
            cw, cy = np.cumsum(ew), np.cumsum(ey)
            begin = np.r_[0, np.flatnonzero(~same) + 1]
            before_w, before_y = np.zeros(k), np.zeros(k)
            before_w[seg[begin]], before_y[seg[begin]] = cw[begin] - ew[begin], cy[begin] - ey[begin]
            s = seg[i]
            lw, ly = cw[i] - before_w[s], cy[i] - before_y[s]
            rw, ry = sw[s] - lw, sy[s] - ly
            score = ly * ly / lw + ry * ry / rw
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            top = np.maximum.reduceat(score, first)
            place = np.where(score == np.repeat(top, np.diff(np.r_[first, len(s)])), np.arange(len(s)), len(s))
            place = i[np.minimum.reduceat(place, first)]
            to = s[first]
            better = top > best[to]
            to, place = to[better], place[better]
            best[to], feature[to], cut[to] = top[better], j, (v[place] + v[place + 1]) / 2
        splits = feature >= 0
        there = tnode[test]
        done = ~splits[there]
        out[test[done]] = (sy / sw)[there[done]]
        test, there = test[~done], there[~done]
        number = (np.cumsum(splits) - 1).astype(np.int32)
        tnode[test] = 2 * number[there] + (tx[trow[test], feature[there]] > cut[there])
        # every feature's instances in the parts of split nodes that test rows have come to (no other part is
        # ever asked), by part and in the same order as before
        stays[some] = False
        some = some[splits[node[some]]]
        old = node[some]
        node[some] = 2 * number[old] + (x[row[some], feature[old]] > cut[old])
        k, depth = 2 * int(splits.sum()), depth + 1
        if k:
            asked = np.bincount(tnode[test], minlength=k) > 0
            some = some[asked[node[some]]]
            stays[some] = True
            some = _parted(some, node, k)
            orders = {j: _parted(o[stays[o]], node, k) for j, o in orders.items()}
            number = (np.cumsum(asked) - 1).astype(np.int32)
            node[some], tnode[test] = number[node[some]], number[tnode[test]]
            k = int(asked.sum())
    return out


def _parted(o: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """Instances in the order of split nodes, now by part (2n or 2n + 1) of each, otherwise in the same order."""
    n = node[o]
    size = np.bincount(n, minlength=k)
    begin, both = np.cumsum(size) - size, size[::2] + size[1::2]
    right = (n & 1).astype(bool)
    rights = np.cumsum(right)
    before = np.repeat(np.r_[0, rights][begin[::2]], both)
    since = np.arange(len(o)) - np.repeat(begin[::2], both)
    moved = np.empty_like(o)
    moved[begin[n] + np.where(right, rights - 1 - before, since - (rights - before))] = o
    return moved


def follow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tx: np.ndarray, max_depth: int | None = None) -> np.ndarray:
    """The leaf mean (unit, tree) of one test row a unit, for units of few and equally many rows.

    Of a tree only the nodes that the test row passes are made.  ``x`` is (unit,
    row, feature), ``w`` the weights (unit, tree, row).  The splits of a unit are the
    same for all its trees: one product of their weights with the rows that each
    split has left gives the sums of all.  A split that parts a node's rows like an earlier one of its
    feature scores the same, so the first of the best is the one that ``grow`` takes.
    """
    units, n, features = x.shape
    out = np.full(w.shape[:2], np.nan)
    v = np.sort(x, axis=1)
    apart = (v[:, :-1] < v[:, 1:]).transpose(0, 2, 1).reshape(units, -1)
    first = np.argsort(~apart, axis=1, kind="stable")[:, :max(1, int(apart.sum(1).max(initial=0)))]
    if n < 2:
        apart, first = np.zeros((units, 1), bool), np.zeros((units, 1), np.int64)
    feature = first // max(n - 1, 1)
    cut = np.take_along_axis(v.transpose(0, 2, 1).reshape(units, -1), feature * n + first % max(n - 1, 1), 1)
    left = np.take_along_axis(x, feature[:, None], 2) <= cut[:, None]
    left = (left & np.take_along_axis(apart, first, 1)[:, None]).astype(float)
    tree, depth = np.broadcast_to(np.arange(w.shape[1]), w.shape[:2]), 0
    own = np.arange(units)  # the units still under way
    while len(own):
        wy = w * y[own][:, None]
        sw, sy = w.sum(2), wy.sum(2)
        there = w > 0
        target = np.broadcast_to(y[own][:, None], w.shape)
        live = np.where(there, target, np.inf).min(2) < np.where(there, target, -np.inf).max(2)
        if max_depth is not None and depth >= max_depth:
            live[:] = False
        lw, ly = w @ left[own], wy @ left[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            rw, ry = sw[:, :, None] - lw, sy[:, :, None] - ly
            score = ly * ly / lw + ry * ry / rw
            score[(lw == 0) | (rw == 0)] = -np.inf
            best = score.argmax(2)
            live &= np.take_along_axis(score, best[:, :, None], 2)[:, :, 0] > -np.inf
            i, t = np.nonzero(~live & (sw > 0))
            out[own[i], tree[i, t]] = sy[i, t] / sw[i, t]
        # the trees under way, at the front of each unit
        most = live.sum(1)
        go = np.flatnonzero(most)
        if not len(go):
            break
        front = np.argsort(~live[go], axis=1, kind="stable")[:, :most.max()]
        pick = lambda a: np.take_along_axis(a[go], front.reshape(*front.shape, *[1] * (a.ndim - 2)), 1)
        w, best, tree, live = pick(w) * pick(live)[:, :, None], pick(best), pick(tree), pick(live)
        own = own[go]
        j = np.take_along_axis(feature[own], best, 1)
        values = np.take_along_axis(x[own].transpose(0, 2, 1), j[:, :, None], 1)
        low = values <= np.take_along_axis(cut[own], best, 1)[:, :, None]
        there = w > 0  # both sides have some, but for trees that have ended
        with np.errstate(invalid="ignore"):
            middle = (np.where(low & there, values, -np.inf).max(2) + np.where(~low & there, values, np.inf).min(2)) / 2
        asks_low = np.take_along_axis(tx[own], j, 1) <= middle
        w = w * (low == asks_low[:, :, None])
        depth += 1
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - start, size)


def _bundles(rows: int, trees: int) -> int:
    """Bundles that the rows of small groups are dealt to: bounded in (row, tree) pairs, and in rows, which a task holds."""
    return max(1, math.ceil(rows * trees / BUNDLE), math.ceil(rows / BUNDLE_ROWS))


def _matrix(lists: pd.Series, step: int = 10_000) -> np.ndarray:
    """Rows of numbers as one matrix that is contiguous by column, so that columns need no copies."""
    x = np.empty((len(lists), len(lists.iloc[0])), order="F")
    for i in range(0, len(lists), step):
        x[i:i + step] = lists.iloc[i:i + step].to_list()
    return x


def _finish(marks: list[int], seed: int, bootstrap: bool, max_depth: int | None, keep: list[str]):
    """Grow the rest of all trees of a bundle of units and predict their test rows."""
    edges = np.array([0, *marks])

    def run(train: pd.DataFrame, tests: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(train) and len(tests):
            train, tests = train.sort_values("unit", kind="stable"), tests.sort_values("unit", kind="stable")
            units, begin, size = np.unique(train["unit"].to_numpy(), return_index=True, return_counts=True)
            tunits, tbegin, tsize = np.unique(tests["unit"].to_numpy(), return_index=True, return_counts=True)
            both, a, b = np.intersect1d(units, tunits, return_indices=True)
            x, y = _matrix(train.pop("fx")), train["y"].to_numpy(np.float64)
            tx, rid = _matrix(tests["fx"]), train["rid"].to_numpy()
            first, trees = train["first"].to_numpy()[begin[a]], train["trees"].to_numpy()[begin[a]]
            total = np.zeros((len(tests), len(marks)))
            lone = (size[a] <= PATH_ROWS) & (tsize[b] == 1) & (first == 0) & (trees == marks[-1])
            for n in np.unique(size[a][lone]):
                alike = np.flatnonzero(lone & (size[a] == n))
                each = max(1, PATH_CELLS // (marks[-1] * int(n) * x.shape[1]))
                for some in (alike[i:i + each] for i in range(0, len(alike), each)):
                    rows, asks = begin[a][some][:, None] + np.arange(n), tbegin[b][some]
                    w = np.ones((len(some), marks[-1], n))
                    if bootstrap:
                        w = bag_weights(rid[rows][:, None], np.arange(marks[-1])[None, :, None], seed)
                        w[w.sum(2) == 0] = 1
                    mean = follow(x[rows], y[rows], w, tx[asks], max_depth)
                    for i, (low, high) in enumerate(zip(edges, marks)):
                        total[asks, i] = np.cumsum(mean[:, low:high], axis=1)[:, -1]  # in the order of the trees
            # roots: the trees of every other unit
            u = np.repeat(np.flatnonzero(~lone), trees[~lone])
            tree = _ranges(first[~lone], trees[~lone])
            load = np.cumsum(size[a][u])
            for strip in np.split(np.arange(len(u)), np.flatnonzero(np.diff(load // STRIP)) + 1) if len(u) else ():
                su, st = u[strip], tree[strip]
                n = size[a][su]
                row, node = _ranges(begin[a][su], n), np.repeat(np.arange(len(strip)), n)
                w = bag_weights(rid[row], st[node], seed) if bootstrap else np.ones(len(row))
                none = np.bincount(node, w, len(strip)) == 0
                w[none[node]] = 1
                row, node, w = row[w > 0], node[w > 0], w[w > 0]
                m = tsize[b][su]
                trow, tnode = _ranges(tbegin[b][su], m), np.repeat(np.arange(len(strip)), m)
                mean = grow(x, y, row, node, w, tx, trow, tnode, max_depth)
                np.add.at(total, (trow, np.searchsorted(edges, st[tnode], side="right") - 1), mean)
            here = np.zeros(len(tests), bool)
            here[_ranges(tbegin[b], tsize[b])] = True
            t0 = np.zeros(len(tests), np.int64)
            t0[_ranges(tbegin[b], tsize[b])] = np.repeat(first, tsize[b])
            for i, edge in enumerate(edges[:-1]):
                mine = here & (t0 < edges[i + 1])
                part = tests.loc[mine, keep].copy()
                part["first"], part["total"] = np.maximum(t0[mine], edge).astype(np.int32), total[mine, i]
                parts.append(part)
        if not parts:
            parts = [tests[keep].iloc[:0].assign(first=np.zeros(0, np.int32), total=np.zeros(0))]
        return pd.concat(parts)
    return run


def _written(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forest_predictions(train: DataFrame, tests: DataFrame, keep: list[str], trees: int | list[int] = 150,
                       seed: int = 42, bootstrap: bool = True, max_depth: int | None = None,
                       small_rows: int = SMALL_ROWS, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """(keep..., n_trees, prediction): the forest of each test row's group applied to it.

    ``train`` has (grp, rid, fx, y): group, row id for the bootstrap, inputs
    as array<double>, target as an integer.  ``tests`` has (grp, fx) and the
    columns of ``keep``, which name a test row.  Several tree counts are
    answered by one forest of the largest, whose first trees are the smaller
    one.  Training rows with a null input or target are left out, and test rows
    with a null input or without training rows in their group are not
    predicted.  ``max_depth`` bounds the depth (none: full trees).
    """
    marks = sorted(set([trees] if isinstance(trees, int) else trees))
    total = marks[-1]
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v))
    train = train.filter(whole("fx") & F.col("y").isNotNull()).select("grp", "rid", "fx", F.col("y").cast("double").alias("y"))
    tests = tests.filter(whole("fx")).select("grp", "fx", *keep)
    sizes = train.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sizes = _written(sizes)
    # groups beyond the small bound are at most all rows / bound
    large = sizes.filter(F.col("n") > small_rows)
    marked = lambda rows: rows.join(F.broadcast(large), "grp", "left")
    bundles = _bundles(sizes.filter(F.col("n") <= small_rows).agg(F.sum("n")).first()[0] or 0, total)
    step = math.gcd(*marks, TREES_PER_TASK)
    # tasks: four times the units, so that few of the long ones share a task, and never fewer for being small in bytes
    units = bundles + large.filter(F.col("n") <= whole_rows).count() * (total // step)
    tasks = int(min(MOST_TASKS, max(8, 4 * units)))
    batches = F.sequence(F.lit(0), F.lit(total - 1), F.lit(step))
    columns = ["bundle", "unit", "first", "trees"]
    text = lambda *cols: F.concat_ws(":", *[F.col(c).cast("string") for c in cols])

    def dealt(rows: DataFrame, *cols) -> DataFrame:
        rows = marked(rows)
        one = rows.filter(F.col("n").isNull()).select(
            F.pmod(F.xxhash64("grp"), F.lit(bundles)).alias("bundle"), text("grp").alias("unit"), F.lit(0).alias("first"),
            F.lit(total).alias("trees"), *cols)
        some = (rows.filter(F.col("n") <= whole_rows).withColumn("first", F.explode(batches))
                .select(F.xxhash64("grp", "first").alias("bundle"), text("grp", "first").alias("unit"), "first",
                        F.lit(step).alias("trees"), *cols))
        return one.unionByName(some)

    a, b = dealt(train, "rid", "fx", "y"), dealt(tests, "fx", *keep)
    huge = large.filter(F.col("n") > whole_rows)
    closed = None
    if not huge.isEmpty():
        if max_depth is not None:
            raise ValueError("a depth bound needs groups within whole_rows")
        only = lambda rows: rows.join(F.broadcast(huge.select("grp")), "grp", "left_semi")
        closed = _large_predictions(only(train), only(tests), {r.grp: r.n for r in huge.collect()}, marks, seed, bootstrap, keep, whole_rows)
    out = T.StructType([*[f for f in tests.select(*keep).schema.fields], T.StructField("first", T.IntegerType()),
                        T.StructField("total", T.DoubleType())])
    # names of their own, as both sides may come from one table
    a, b = (side.select(*[F.col(c).alias(c) for c in [*columns, *cs]]).repartition(tasks, "bundle") for side, cs in ((a, ["rid", "fx", "y"]), (b, ["fx", *keep])))
    parts = (a.groupBy("bundle").cogroup(b.groupBy("bundle"))
             .applyInPandas(_finish(marks, seed, bootstrap, max_depth, keep), out))
    if closed is not None:
        parts = parts.unionByName(closed)
    sums = parts.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct("first", "total"))).alias("parts"))
    each = F.explode(F.array(*[F.lit(m) for m in marks])).alias("n_trees")
    upto = F.filter("parts", lambda p: p["first"] < F.col("n_trees"))
    mean = F.aggregate(upto, F.lit(0.0), lambda s, p: s + p["total"]) / F.col("n_trees")
    return sums.select(*keep, "parts", each).select(*keep, "n_trees", mean.alias("prediction"))


# ---------------------------------------------------------------- groups beyond WHOLE_ROWS

# Edges of a feature's bins, rows that they are taken from, and bytes of sums that a task holds of the nodes of a pass.
EDGES = 127
EDGE_ROWS = 20_000
SUM_BYTES = 64_000_000
# Rows of a block, and inputs of them; (row, tree) pairs that a task looks at before rows or values of them leave it.
BLOCK = 300_000
BLOCK_CELLS = 50_000_000
PAIRS = 1_000_000
# Inputs that are not 0, of (row, tree) pairs of the last round, that are on disk at a time.
ROUND_CELLS = 1_000_000_000
SAFE = 1e-9


@dataclass
class _Upper:
    """The nodes of one tree that Spark has split so far, numbered from 0 in the order of their making."""
    splits: list[tuple[int, int, float, int]] = field(default_factory=list)  # node, feature, cut, left child (right: next)
    leaves: dict[int, float] = field(default_factory=dict)
    open: list[int] = field(default_factory=lambda: [0])
    closed: list[int] = field(default_factory=list)  # within the bound
    made: int = 1

    def node(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        for at, feature, cut, left in self.splits:
            here = np.flatnonzero(out == at)
            out[here] = left + (x[here, feature] > cut)
        return out

    def table(self, number: int, places: dict[int, int]) -> tuple:
        """The tree as ``kernel.routed`` takes it; ``places`` are those of the nodes where rows end."""
        left, feature, place, cut = np.full(self.made, -1), np.zeros(self.made, int), np.full(self.made, -1), np.zeros(self.made)
        for at, j, c, child in self.splits:
            left[at], feature[at], cut[at] = child, j, c
        for at, i in places.items():
            place[at] = i
        return number, left, feature, place, cut


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with their inputs as bytes of those that are not 0."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("fx").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                begin, entries = kernel.packed(x)
                at = pa.py_buffer((begin * entries.itemsize).astype(np.int32))
                fx = pa.Array.from_buffers(pa.binary(), len(x), [None, at, pa.py_buffer(entries)])
                yield batch.set_column(batch.schema.get_field_index("fx"), "fx", fx)
    return rows.mapInArrow(run, T.StructType([T.StructField("fx", T.BinaryType()) if f.name == "fx" else f for f in rows.schema.fields]))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """(group, its rows, where the inputs of each begin, the inputs) of packed rows, some ``most`` rows at a time."""
    def each(held):
        rows = pa.Table.from_batches(held)
        groups = pc.unique(rows["grp"])
        for grp in groups:
            part = rows if len(groups) == 1 else rows.filter(pc.equal(rows["grp"], grp))
            fx = pa.concat_arrays([c.cast(pa.large_binary()) for c in part["fx"].chunks])
            _, at, data = fx.buffers()
            at = np.frombuffer(at, np.int64)[fx.offset:fx.offset + len(fx) + 1]
            data = np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]].view(kernel.ENTRY)
            yield grp.as_py(), part, (at - at[0]) // kernel.ENTRY.itemsize, data

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield from each(held)
            held, n = [], 0
    if n:
        yield from each(held)


def _gathered(rows: DataFrame, features: int) -> DataFrame:
    """(grp, n, block): packed rows as the blocks that ``kernel`` reads, written, as all scans read them."""
    ids = "rid" if "rid" in rows.columns else "_tid"

    def run(batches):
        for grp, part, begin, entries in _blocks(batches, max(1, min(BLOCK, BLOCK_CELLS // features))):
            y = part["y"].to_numpy() if ids == "rid" else None
            block = kernel.block(features, part[ids].to_numpy(), y, begin, entries)
            yield pa.RecordBatch.from_arrays([part["grp"].chunk(0)[:1], pa.array([part.num_rows], pa.int32()), pa.array([block], pa.binary())],
                                             ["grp", "n", "block"])
    return _written(rows.mapInArrow(run, T.StructType([rows.schema["grp"], T.StructField("n", T.IntegerType()), T.StructField("block", T.BinaryType())])))


def _through(op: str, blocks: DataFrame, states: dict, most: int) -> DataFrame:
    """What a function of ``kernel`` makes of the blocks, ``most`` rows at a time, and of their group's state."""
    each = T.StructType([blocks.schema["grp"], T.StructField("trees", T.BinaryType())])
    trees = blocks.sparkSession.createDataFrame([(grp, bytearray(state)) for grp, state in states.items()], each)
    parts = blocks.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(most)))).join(F.broadcast(trees), "grp")
    got = F.call_function(f"wattflow_{op}", F.lit(op), "block", "trees", F.col("from"), F.col("from") + F.lit(most))
    return parts.select(F.explode(got).alias("r")).select("r.*")


def _of_groups(packets: DataFrame, by: str, op: str, more: F.Column) -> DataFrame:
    """What a function of ``kernel`` makes of the packets of each group."""
    got = F.call_function(f"wattflow_{op}", F.lit(op), "p", more, F.lit(0), F.lit(0))
    return packets.groupBy(by).agg(F.collect_list("packet").alias("p")).select(F.explode(got).alias("r")).select("r.*")


def _bin(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """2k + 1 for a value that is edge k, 2k for one between the edges k - 1 and k."""
    return np.searchsorted(edges, v) + np.searchsorted(edges, v, side="right")


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bins of all inputs, each feature's from 0."""
    return np.column_stack([_bin(x[:, j], e) for j, e in enumerate(edges)])


def _wanted(sums: np.ndarray, sizes: np.ndarray, zero: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    """The bins of a node in which its best split may lie: (feature, bin, lw, ly, next), sums before and the next bin with rows.

    A split between two bins is scored from their sums.  Inside a bin of weight
    d and squared deviation q, a prefix of weight t has t times the bin's mean and at
    most sqrt(d * q) / 2 more or less; the score is convex, so its largest
    value there is at a corner, and a bin stays if that reaches the best score between bins.
    """
    begin = np.cumsum(sizes) - sizes
    sums = sums.copy()
    sums[begin + zero] += total - np.add.reduceat(sums, begin)
    feature = np.repeat(np.arange(len(sizes)), sizes)
    some = np.flatnonzero(sums[:, 0] > 0)
    feature, at, d = feature[some], (some - begin[feature[some]]), sums[some]
    run = np.cumsum(d, axis=0) - (np.cumsum(d, axis=0) - d)[np.searchsorted(feature, feature)]
    lw, ly = run[:, 0] - d[:, 0], run[:, 1] - d[:, 1]
    sw, sy = total[0], total[1]

    def score(w, s):
        with np.errstate(divide="ignore", invalid="ignore"):
            left, right = s * s / w, (sy - s) ** 2 / (sw - w)
        return np.where(w > 0, left, np.where(s == 0, 0, np.inf)) + np.where(w < sw, right, np.where(s == sy, 0, np.inf))
    last = np.r_[feature[1:] != feature[:-1], True]
    between = np.where(last, -np.inf, score(run[:, 0], run[:, 1]))
    best = between.max()
    most = np.sqrt(np.maximum(d[:, 0] * d[:, 2] - d[:, 1] ** 2, 0) + SAFE * d[:, 0] * d[:, 2]) / 2
    corner = np.max([score(w, s + e) for w, s in ((lw, ly), (run[:, 0], run[:, 1])) for e in (-most, most)], axis=0)
    inside = (at % 2 == 0) & ((corner >= best * (1 - SAFE)) | (best == -np.inf))
    edge = ~last & (between >= best * (1 - SAFE))
    keep = inside | edge | np.r_[False, edge[:-1]]
    following = np.where(last, -1, np.r_[at[1:], -1])
    return pd.DataFrame({"feature": feature, "bin": at, "lw": lw, "ly": ly, "next": following})[keep]


def _best_split(cells: pd.DataFrame, wanted: pd.DataFrame, sw: float, sy: float) -> tuple[int, float] | None:
    """(feature, cut) of a node's best split, from sums per value in the wanted bins."""
    cells = cells.groupby(["feature", "bin", "v"], as_index=False)[["w", "wy"]].sum()
    cells = cells.merge(wanted, on=["feature", "bin"]).sort_values(["feature", "bin", "v"])
    if len(cells) < 2:
        return None
    own = cells.groupby(["feature", "bin"])[["w", "wy"]].cumsum()
    lw, ly = (cells["lw"] + own["w"]).to_numpy(), (cells["ly"] + own["wy"]).to_numpy()
    f, b, v, following = (cells[c].to_numpy() for c in ("feature", "bin", "v", "next"))
    ok = np.flatnonzero((f[1:] == f[:-1]) & ((b[1:] == b[:-1]) | (b[1:] == following[:-1])))
    if not len(ok):
        return None
    lw, ly = lw[ok], ly[ok]
    rw, ry = sw - lw, sy - ly
    at = ok[np.argmax(ly * ly / lw + ry * ry / rw)]  # the first of equal ones: first feature, smallest threshold
    return int(f[at]), float((v[at] + v[at + 1]) / 2)


def _edges(rows: DataFrame, features: int) -> list[np.ndarray]:
    """Edges of each feature's bins, 0 among them, from a bounded number of rows: they change the cost of a search, not its result."""
    some = rows.select("fx", F.xxhash64("rid").alias("h")).orderBy("h").limit(EDGE_ROWS).toPandas()["fx"]
    begin = np.r_[0, np.cumsum(some.map(len))] // kernel.ENTRY.itemsize
    x = kernel.unpacked(begin, np.frombuffer(b"".join(some), kernel.ENTRY), features)
    q = np.linspace(0, 1, EDGES)
    return [np.unique(np.r_[0.0, np.quantile(x[:, j], q, method="nearest")]) for j in range(features)]


def _states(trees: dict[tuple, _Upper], places: dict[tuple, dict[int, int]], many: int, seed: int, bootstrap: bool, more: bytes) -> dict:
    """For each group its trees that have places, as ``kernel`` takes them, and what an operation needs ``more``."""
    out = {}
    for grp in {name[0] for name in places}:
        some = [trees[name].table(name[1], at) for name, at in places.items() if name[0] == grp and at]
        out[grp] = kernel.routed(some, many, _POISSON if bootstrap else None, seed) + more
    return out


def _split_large(rows: DataFrame, blocks: DataFrame, features: int, names: list[tuple], seed: int, bootstrap: bool, whole_rows: int) -> dict[tuple, _Upper]:
    """The upper part of each named tree (group, number): nodes of more than ``whole_rows`` rows are split, a level a round.

    Rows stay where they are written: a tree's draw is hashed anew and its rows
    are led through the splits made so far.  A round takes sums per node and
    bin, which leave few bins for its best split, and then sums per value in
    those.  A tree has at most (rows / bound) nodes a level; they are kept on the driver.
    """
    edges = _edges(rows, features)
    sizes = np.array([2 * len(e) + 1 for e in edges])
    begin, wide = np.cumsum(sizes) - sizes, int(sizes.sum())
    zero = np.array([2 * np.searchsorted(e, 0.0) + 1 for e in edges])
    trees = {name: _Upper() for name in names}
    binned = b"".join([np.array([len(e) for e in edges], "<i4").tobytes(), *[e.astype("<f8").tobytes() for e in edges]])

    def summed(places: dict, many: int) -> DataFrame:
        def find(pdf):
            own = np.sum([np.frombuffer(b) for b in pdf["own"]], axis=0)
            lo, hi = pdf["lo"].min(), pdf["hi"].max()
            bins = pd.DataFrame()
            if own[3] > whole_rows and lo < hi:
                bins = _wanted(np.sum([np.frombuffer(b).reshape(wide, 3) for b in pdf["sums"]], axis=0), sizes, zero, own[:3])
            lists = {c: [bins[c].to_list() if len(bins) else []] for c in ("feature", "bin", "lw", "ly", "next")}
            mark = np.zeros(wide, bool)
            if len(bins):
                mark[begin[bins["feature"]] + bins["bin"]] = True
            return pd.DataFrame({"nid": pdf["nid"].iloc[:1], "n": int(own[3]), "sw": own[0], "sy": own[1],
                                 "mark": [np.packbits(mark).tobytes() if len(bins) else None]}).assign(**lists)
        parts = _through("sums", blocks, _states(trees, places, many, seed, bootstrap, binned), 2 * BLOCK)
        return _written(parts.groupBy("nid").applyInPandas(
            find, "nid int, n long, sw double, sy double, mark binary, "
                  "feature array<int>, bin array<int>, lw array<double>, ly array<double>, next array<int>"))

    def refined(places: dict, many: int, found: DataFrame, nodes: dict) -> dict:
        marks = np.zeros((many, wide), np.uint8)
        for i, r in nodes.items():
            if r.mark:
                marks[i] = np.unpackbits(np.frombuffer(r.mark, np.uint8), count=wide)
        some = {name: {at: i for at, i in own.items() if marks[i].any()} for name, own in places.items()}
        drawn = sum(bool(own) for own in some.values())
        if not drawn:
            return {}

        def best(cells, bins):
            got = None
            if len(cells):
                code, v, w, wy = np.concatenate([np.frombuffer(b).reshape(4, -1) for b in cells["cells"]], axis=1)
                feature = np.searchsorted(begin, code, side="right") - 1
                r = bins.iloc[0]
                got = _best_split(pd.DataFrame({"feature": feature, "bin": code.astype(int) - begin[feature], "v": v, "w": w, "wy": wy}),
                                  pd.DataFrame({c: r[c] for c in ("feature", "bin", "lw", "ly", "next")}), r["sw"], r["sy"])
            return pd.DataFrame([(bins["nid"].iloc[0], *got)] if got else [], columns=["nid", "feature", "cut"])
        cells = _through("cells", blocks, _states(trees, some, many, seed, bootstrap, binned + marks.tobytes()), max(1, PAIRS // drawn))
        cuts = cells.groupBy("nid").cogroup(found.groupBy("nid")).applyInPandas(best, "nid int, feature int, cut double")
        return {r.nid: r for r in cuts.collect()}

    while live := [name for name in names if trees[name].open]:
        cost = np.cumsum([len(trees[n].open) * wide * 24 for n in live]) // SUM_BYTES
        for part in np.split(np.arange(len(live)), np.flatnonzero(np.diff(cost)) + 1):
            places, many = {}, 0
            for name in (live[i] for i in part):
                places[name] = {at: many + i for i, at in enumerate(trees[name].open)}
                many += len(places[name])
            found = summed(places, many)
            nodes = {r.nid: r for r in found.select("nid", "n", "sw", "sy", "mark").collect()}
            cuts = refined(places, many, found, nodes)
            for name, own in places.items():
                tree = trees[name]
                tree.open = []
                for at, i in own.items():
                    r = nodes.get(i)
                    if r is None or r.n <= whole_rows:
                        tree.closed.append(at)
                    elif (cut := cuts.get(i)) is None:
                        tree.leaves[at] = r.sy / r.sw
                    else:
                        tree.splits.append((at, cut.feature, cut.cut, tree.made))
                        tree.open += [tree.made, tree.made + 1]
                        tree.made += 2
    return trees


@contextmanager
def _shuffles_freed(spark):
    """A query's shuffle files are removed when it ends (its result is written by then), so rounds do not add up on disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _rounds(names: list[tuple], marks: list[int], cells: int) -> Iterator[list[tuple]]:
    """The named trees in rounds of at most ROUND_CELLS cells, a tree having ``cells``; a round lies between two marks."""
    most = max(1, ROUND_CELLS // max(1, cells))
    for low, high in zip([0, *marks], marks):
        for first in range(low, high, most):
            yield [name for name in names if first <= name[1] < min(first + most, high)]


def _large_predictions(train: DataFrame, tests: DataFrame, sizes: dict, marks: list[int], seed: int, bootstrap: bool,
                       keep: list[str], whole_rows: int) -> DataFrame:
    """(keep..., first, total) of groups beyond ``whole_rows``.

    Inputs are written once (as rows, and from these as blocks), not once a tree.  The lower parts of the trees are grown in
    rounds of some trees, so what is on disk of the drawn rows is bounded for any number of them.
    """
    spark = train.sparkSession
    kernel.registered(spark)
    features = train.select(F.size("fx")).first()[0]
    rows = _written(_packed(train.repartition(fit_partitions(sum(sizes.values())), "rid")))
    # an id of the test row, of its own even if keys repeat
    tests = _written(_packed(tests.withColumn("_tid", F.monotonically_increasing_id())))
    asked = tests.select("grp", "fx", "_tid")
    blocks, test_blocks = _gathered(rows, features), _gathered(asked, features)
    names = [(grp, tree) for tree in range(marks[-1]) for grp in sizes]
    with _shuffles_freed(spark):
        trees = _split_large(rows, blocks, features, names, seed, bootstrap, whole_rows)
    inputs = rows.select(F.sum(F.length("fx"))).first()[0] // kernel.ENTRY.itemsize
    out = None
    for some in _rounds(names, marks, inputs * 2 // 3):
        units, many = {}, 0
        for name in some:
            units[name] = {at: many + i for i, at in enumerate(trees[name].closed)}
            many += len(units[name])
        leaves = {name: trees[name].leaves for name in some if trees[name].leaves}

        def closed(batches):
            for grp, part, begin, entries in _blocks(batches, BLOCK):
                x, tid = kernel.unpacked(begin, entries, features), part["_tid"].to_numpy()
                for name in leaves:
                    if name[0] == grp:
                        mean = pd.Series(trees[name].node(x)).map(leaves[name])
                        here = mean.notna().to_numpy()
                        parts, packets = kernel.means(name[1], tid[here], mean.to_numpy(float)[here])
                        yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int64()), "packet": pa.array(packets, pa.binary())})
        with _shuffles_freed(spark):
            most = max(1, PAIRS // len(some))
            kind = lambda test: np.array([test], "<i4").tobytes()
            a = _through("rows", blocks, _states(trees, units, many, seed, bootstrap, kind(0)), most)
            b = _through("rows", test_blocks, _states(trees, units, many, seed, False, kind(1)), most)
            means = _of_groups(a.unionByName(b).repartition(max(8, 2 * many), "unit"), "unit", "finish", F.lit(SPARSE))
            if leaves:
                means = means.unionByName(asked.mapInArrow(closed, "part long, packet binary"))
            # a round's sum of each test row, in the order of its trees
            sums = _of_groups(means, "part", "total", F.col("part"))
            done = _written(sums)
        out = done if out is None else out.unionByName(done)
    return out.join(tests.select("_tid", *keep), "_tid").select(*keep, "first", "total")
