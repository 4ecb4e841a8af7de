"""Exact forests against plain recursion, on every path that a group can take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattflow.operators import trees


def plain_tree(x, y, w, q, depth=None):
    """Leaf mean of the point q by the stated rule: largest score, then first feature, then smallest threshold."""
    if y.min() < y.max() and depth != 0:
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for a, b in zip(values[:-1], values[1:]):
                left = x[:, j] <= a
                l, r = (w[left] * y[left]).sum(), (w[~left] * y[~left]).sum()
                score = l * l / w[left].sum() + r * r / w[~left].sum()
                if best is None or score > best[0]:
                    best = (score, j, (a + b) / 2)
        if best:
            _, j, cut = best
            side = (x[:, j] > cut) == (q[j] > cut)
            return plain_tree(x[side], y[side], w[side], q, None if depth is None else depth - 1)
    return (w * y).sum() / w.sum()


def table(rng, groups, n, f=4, tests=3):
    train, test = [], []
    for g in range(groups):
        x = rng.integers(0, 9, (n, f)).astype(float)
        x[:, 0] = rng.normal(size=n).round(3)
        x[:, 2] = np.where(x[:, 2] < 7, 0, x[:, 2] - 8)  # mostly 0, else below it or 0
        x[:, 3] = np.where(x[:, 3] < 6, 0, x[:, 3])
        y = rng.integers(0, 40, n)
        train += [(g, int(rng.integers(1 << 62)), x[i].tolist(), int(y[i])) for i in range(n)]
        test += [(g, i, rng.integers(0, 9, f).astype(float).tolist()) for i in range(tests)]
    return train, test


def frames(spark, train, test):
    return (spark.createDataFrame(train, "grp long, rid long, fx array<double>, y long"),
            spark.createDataFrame(test, "grp long, tid int, fx array<double>"))


def wanted(train, test, n_trees, bootstrap, depth=None, seed=42):
    out = {}
    for g in {r[0] for r in test}:
        rows = [r for r in train if r[0] == g]
        x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
        rid = np.array([r[1] for r in rows], np.int64)
        for _, tid, q in (t for t in test if t[0] == g):
            total = 0.0
            for t in range(n_trees):
                w = trees.bag_weights(rid, np.full(len(rid), t), seed) if bootstrap else np.ones(len(rid))
                w = w if w.any() else np.ones(len(rid))
                total += plain_tree(x[w > 0], y[w > 0], w[w > 0], np.array(q), depth)
            out[g, tid] = total / n_trees
    return out


def got(df):
    rows = df.collect()
    out = {(r.grp, r.tid): r.prediction for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("small,whole", [(2_000, 500_000), (5, 500_000), (5, 12)])
def test_one_full_tree_equals_plain_recursion(spark, small, whole):
    train, test = table(np.random.default_rng(1), groups=5, n=40)
    a, b = frames(spark, train, test)
    # the third path splits nodes with Spark until they hold 12 rows
    have = got(trees.forest_predictions(a, b.withColumn("g", F.col("grp")).drop("g"), ["grp", "tid"], 1, bootstrap=False,
                                        small_rows=small, whole_rows=whole))
    assert have == pytest.approx(wanted(train, test, 1, False), abs=1e-12)


@pytest.mark.parametrize("small,whole", [(2_000, 500_000), (5, 500_000), (5, 12)])
def test_bootstrap_forest_is_the_same_on_every_path(spark, small, whole):
    train, test = table(np.random.default_rng(2), groups=3, n=30)
    a, b = frames(spark, train, test)
    want = wanted(train, test, 10, True)
    for parts in (1, 7):
        have = got(trees.forest_predictions(a.repartition(parts), b, ["grp", "tid"], 10, small_rows=small, whole_rows=whole))
        assert have == pytest.approx(want, abs=1e-9)


def test_first_trees_are_the_smaller_forest_and_depth_is_bounded(spark):
    train, test = table(np.random.default_rng(3), groups=2, n=25)
    a, b = frames(spark, train, test)
    for small in (2_000, 5):
        both = trees.forest_predictions(a, b, ["grp", "tid"], [6, 20], small_rows=small)
        for n in (6, 20):
            assert got(both.filter(F.col("n_trees") == n)) == pytest.approx(wanted(train, test, n, True), abs=1e-9)
        shallow = trees.forest_predictions(a, b, ["grp", "tid"], 3, max_depth=2, small_rows=small)
        assert got(shallow) == pytest.approx(wanted(train, test, 3, True, depth=2), abs=1e-9)


def test_full_depth_of_a_long_chain(spark):
    """Each split of y = 3 ** x takes off the largest value, so 30 values need 29 levels."""
    train = [(0, i, [float(i)], 3 ** i) for i in range(30)]
    test = [(0, i, [float(i)]) for i in range(30)]
    have = got(trees.forest_predictions(*frames(spark, train, test), ["grp", "tid"], 1, bootstrap=False))
    assert have == {(0, i): float(3 ** i) for i in range(30)}


def test_odd_groups(spark):
    train = [(0, 1, [1.0, 2.0], 5), (0, 2, [1.0, 2.0], 9), (1, 3, [1.0, None], 7), (2, 4, [3.0, 3.0], 4), (3, 5, [1.0, 1.0], None),
             (2, 6, [float("nan"), 1.0], 8)]
    test = [(0, 1, [0.0, 0.0]), (1, 1, [0.0, 0.0]), (2, 1, [9.0, 9.0]), (2, 2, [9.0, None]), (3, 1, [1.0, 1.0]), (9, 1, [1.0, 1.0])]
    a, b = frames(spark, train, test)
    have = got(trees.forest_predictions(a, b, ["grp", "tid"], 4, bootstrap=False))
    assert have == {(0, 1): 7.0, (2, 1): 4.0}  # equal inputs share a leaf; nothing to learn from: no prediction
    assert got(trees.forest_predictions(a.limit(0), b, ["grp", "tid"], 4)) == {}
    assert got(trees.forest_predictions(a, b.limit(0), ["grp", "tid"], 4)) == {}


def test_large_groups_of_equal_rows(spark):
    """Nodes beyond the bound that cannot be split are leaves at once."""
    train = [(0, i, [float(i % 2)], 3 + 4 * (i % 2)) for i in range(60)] + [(1, i, [1.0], i % 3) for i in range(60)]
    test = [(0, 0, [0.0]), (0, 1, [1.0]), (1, 0, [5.0])]
    have = got(trees.forest_predictions(*frames(spark, train, test), ["grp", "tid"], 2, bootstrap=False, small_rows=5, whole_rows=10))
    assert have == {(0, 0): 3.0, (0, 1): 7.0, (1, 0): 1.0}


def test_poisson_weights():
    w = trees.bag_weights(np.arange(200_000), np.zeros(200_000, int), 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    other = trees.bag_weights(np.arange(200_000), np.ones(200_000, int), 1)
    assert abs(np.corrcoef(w, other)[0, 1]) < 0.01


def test_a_task_of_small_groups_is_bounded_in_rows(spark):
    assert trees._bundles(10_000_000, 1) == 10_000_000 // trees.BUNDLE_ROWS
    assert trees._bundles(10_000_000, 150) == 10_000_000 * 150 // trees.BUNDLE
    assert trees._bundles(0, 1) == 1
    import pandas as pd
    rows = np.arange(15.0).reshape(5, 3)
    x = trees._matrix(pd.Series(list(rows)), step=2)
    assert (x == rows).all() and x.flags.f_contiguous


def test_bundles_of_few_rows_give_the_same_forest(spark, monkeypatch):
    train, test = table(np.random.default_rng(8), groups=6, n=20)
    a, b = frames(spark, train, test)
    one = got(trees.forest_predictions(a, b, ["grp", "tid"], 3))
    monkeypatch.setattr(trees, "BUNDLE_ROWS", 7)
    assert got(trees.forest_predictions(a, b, ["grp", "tid"], 3)) == one


def test_inputs_of_large_groups_are_written_once_for_any_number_of_trees(spark, monkeypatch):
    train, test = table(np.random.default_rng(9), groups=1, n=40)
    a, b = frames(spark, train, test)
    written, rows = trees._written, []

    def counted(df):
        out = written(df)
        if "fx" in out.columns:
            rows.append(out.count())
        return out
    monkeypatch.setattr(trees, "_written", counted)
    monkeypatch.setattr(trees, "ROUND_CELLS", 100)  # several rounds
    have = trees.forest_predictions(a, b, ["grp", "tid"], [2, 4], small_rows=5, whole_rows=12)
    assert got(have.filter("n_trees = 4")) == pytest.approx(wanted(train, test, 4, True), abs=1e-9)
    assert got(have.filter("n_trees = 2")) == pytest.approx(wanted(train, test, 2, True), abs=1e-9)
    assert sum(rows) == len(train) + len(test)


def test_a_large_node_keeps_few_bins_and_the_best_split_among_them():
    rng = np.random.default_rng(10)
    v, noise = rng.normal(size=20_000).round(4), rng.normal(size=20_000).round(4)
    y = ((v > 0.3) * 40 + rng.integers(0, 30, len(v))).astype(float)
    edges = [np.unique(np.r_[0.0, np.quantile(c, np.linspace(0, 1, 127))]) for c in (noise, v)]
    sizes, x = np.array([2 * len(e) + 1 for e in edges]), np.column_stack([noise, v])
    bins = trees._bins(x, edges)
    sums = np.concatenate([np.column_stack([np.bincount(bins[:, j], u, sizes[j]) for u in (np.ones(len(y)), y, y * y)])
                           for j in range(2)])
    zero = np.array([2 * np.searchsorted(e, 0.0) + 1 for e in edges])
    begin = np.cumsum(sizes) - sizes
    sums[begin + zero] = 0  # entries that are 0 are not sent
    keep = trees._wanted(sums, sizes, zero, np.array([len(y), y.sum(), (y * y).sum()]))
    assert len(keep) < sizes.sum() / 10
    cells = [(1, b, val, 1.0, t) for b, val, t in zip(bins[:, 1], v, y) if ((keep.feature == 1) & (keep.bin == b)).any()]
    import pandas as pd
    f, cut = trees._best_split(pd.DataFrame(cells, columns=["feature", "bin", "v", "w", "wy"]), keep[keep.feature == 1], len(y), y.sum())
    order = np.argsort(v)
    s, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    score = (s * s / n)[:-1] + (s[-1] - s[:-1]) ** 2 / (len(y) - n[:-1])
    score[v[order][:-1] == v[order][1:]] = -1
    i = int(np.argmax(score))
    assert (f, cut) == (1, (v[order][i] + v[order][i + 1]) / 2)


@pytest.mark.parametrize("depth", [None, 2])
def test_following_one_test_row_gives_what_whole_trees_give(spark, depth):
    """Groups of 1 to 40 rows, on both sides of the bound, with ties, zeros and negative values."""
    rng, train, test = np.random.default_rng(11), [], []
    for g, n in enumerate([1, 2, 2, 3, 5, 5, 5, 9, 17, 32, 33, 40]):
        a, b = table(rng, groups=1, n=n, tests=1)
        train += [(g, *r[1:]) for r in a]
        test += [(g, *r[1:]) for r in b]
    both = trees.forest_predictions(*frames(spark, train, test), ["grp", "tid"], [3, 7], max_depth=depth)
    for n in (3, 7):
        assert got(both.filter(F.col("n_trees") == n)) == pytest.approx(wanted(train, test, n, True, depth), abs=1e-9)


def test_parts_of_trees_without_test_rows_are_not_grown(monkeypatch):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(3_000, 2)), rng.integers(0, 1_000, 3_000).astype(float)
    seen, entries = [], trees._entries
    monkeypatch.setattr(trees, "_entries", lambda c, o, *a: seen.append(len(o)) or entries(c, o, *a))
    row, tx = np.arange(len(x)), rng.normal(size=(1, 2))
    mean = trees.grow(x, y, row, np.zeros(len(x), int), np.ones(len(x)), tx, np.zeros(1, int), np.zeros(1, int))
    assert mean[0] == pytest.approx(plain_tree(x, y, np.ones(len(x)), tx[0]))
    assert sum(n < len(x) for n in seen) > 4 and min(seen) < 100
    with_all = trees.grow(x, y, row, np.zeros(len(x), int), np.ones(len(x)), x, row, np.zeros(len(x), int))
    assert (with_all == y).all()


def test_large_groups_need_no_python_growth_and_equal_it(spark, monkeypatch):
    """Beyond the bound rows go through the compiled functions alone: 0 and negative values, floats and doubles, several rounds."""
    rng = np.random.default_rng(13)
    train, test = table(rng, groups=2, n=120, tests=5)
    train = [(g, i, [v if j != 1 else v / 3 for j, v in enumerate(x)], y) for g, i, x, y in train]
    a, b = frames(spark, train, test)
    whole = got(trees.forest_predictions(a, b, ["grp", "tid"], 6, small_rows=5))
    monkeypatch.setattr(trees, "ROUND_CELLS", 1_000)
    monkeypatch.setattr(trees, "PAIRS", 100)  # blocks are read some rows at a time
    ran = []
    monkeypatch.setattr(trees, "_of_groups", lambda *args, f=trees._of_groups: ran.append(args[2]) or f(*args))
    monkeypatch.setattr(trees, "grow", None)
    assert got(trees.forest_predictions(a, b, ["grp", "tid"], 6, small_rows=5, whole_rows=40)) == pytest.approx(whole, abs=1e-9)
    assert {"finish", "total"} <= set(ran)


def test_inputs_as_bytes_come_back():
    from wattflow.operators import kernel
    x = np.random.default_rng(14).integers(-1, 2, (50, 7)) / 3
    x[3] = 0
    begin, entries = kernel.packed(x)
    assert (kernel.unpacked(begin, entries, 7) == x).all() and len(entries) == np.count_nonzero(x)
