"""Quantiles, ranks, metrics and the small numeric helpers against brute force."""

import random
from decimal import Decimal
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.functions import isolation, treeshap
from tallyscope.functions.columns import middle, trend_over_mean
from tallyscope.operators import metrics
from tallyscope.operators.quantile import exact_quantile
from tallyscope.operators.ranking import running_totals


@pytest.mark.parametrize("q, width", [(0.5, 10_000), (0.5, 0.5), (0.3, 7)])
def test_exact_quantile(spark, q, width):
    rng = random.Random(1)
    data = {k: [Decimal(rng.randint(1, 4_000_000)) / 100 for _ in range(n)]
            for k, n in [("a", 1), ("b", 2), ("c", 7), ("d", 400)]}
    data["e"] = [Decimal("5.00")] * 300 + [Decimal("9.00")] * 299
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs],
                               "k string, v decimal(18,2)")
    rows = exact_quantile(df, ["k"], "v", q, width, "m").collect()
    got = {r["k"]: float(r["m"]) for r in rows}
    want = {k: float(np.quantile(np.array(vs, dtype=float), q)) for k, vs in data.items()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_weighted_quantile_counts_copies(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 1), ("a", 3.0, 4)],
                               "k string, v double, n bigint")
    got = exact_quantile(df, ["k"], "v", 0.3, 1.0, "m", weight="n").first()["m"]
    assert got == np.quantile([1.0] * 5 + [2.0] + [3.0] * 4, 0.3)


def test_trend_matches_least_squares(spark):
    series = [0.0, 5.0, 0.0, 7.0, 9.0, 0.0, 4.0]
    first = 24_000
    n, total = len(series), Decimal(str(sum(series)))
    moment = Decimal(str(sum((first + i) * y for i, y in enumerate(series))))
    row = spark.createDataFrame([(n, first, total, moment)],
                                "n int, f int, t decimal(38,2), m decimal(38,2)")
    got = row.select(trend_over_mean(*[F.col(c) for c in "nftm"])).first()[0]
    want = np.polyfit(range(n), series, 1)[0] / np.mean(series)
    assert got == pytest.approx(want, rel=1e-12)


def test_middle_interpolates(spark):
    row = spark.range(1).select(middle(F.array(*[F.lit(x) for x in (9.0, 1.0, 4.0, 2.0)])))
    assert row.first()[0] == 3.0


def test_running_totals_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 5), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, score int, w int")
    order = [F.col("score").desc(), F.col("id")]
    got = {r["id"]: r["before"] for r in
           running_totals(df, order, {"before": "w"}, partitions=7).collect()}
    total, want = 0, {}
    for i, _, w in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[i] = total
        total += w
    assert got == want


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg)) if pos and neg else 0.0


@pytest.mark.parametrize("classes", [[0, 1], [1]])
def test_auc_with_ties(spark, classes):
    rng = random.Random(2)
    pairs = [(rng.choice(classes), rng.randint(0, 9) / 10) for _ in range(200)]
    df = spark.createDataFrame(pairs, "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(brute_auc(pairs), abs=5e-5)


@pytest.mark.parametrize("n", [3, 10, 57])
def test_precision_at_top(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 4) / 4) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, y int, s double")
    k = max(1, int(n * 0.2))
    top = sorted(rows, key=lambda r: (-r[2], r[0]))[:k]
    got = metrics.precision_at_top(df, "y", "s", "id").first()
    assert (got["precision_top"], got["k"]) == (
        pytest.approx(sum(r[1] for r in top) / k, abs=5e-5), k)


def test_error_and_coverage(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0, 3.0), (5.0, 2.0, 0.0, 3.0)],
                               "y double, p double, lo double, hi double")
    assert metrics.mean_absolute_error(df, "y", "p").first()["mae"] == 2.0
    assert metrics.interval_coverage(df, "y", "lo", "hi").first()["coverage"] == 0.5


def test_isolation_forest_finds_the_outlier():
    rng = np.random.default_rng(0)
    points = np.c_[rng.normal(10, 1, 400), rng.normal(100, 5, 400)]
    points[7] = [30, 500]
    scores = isolation.score(isolation.grow(points, 42), points)
    assert scores.argmin() == 7 and scores.min() >= -1 and scores.max() <= 0
    again = isolation.score(isolation.grow(points, 42), points)
    assert (scores == again).all()


def test_isolation_forest_of_equal_points():
    points = np.ones((6, 2))
    scores = isolation.score(isolation.grow(points, 42), points)
    assert len(set(scores)) == 1


def node(i, count, prediction=0.0, left=-1, right=-1, feature=-1, threshold=None):
    return dict(id=i, count=count, prediction=prediction, left=left, right=right,
                feature=feature, threshold=threshold)


# A depth-3 tree that uses feature 0 twice on one path.
TREE = {n["id"]: n for n in [
    node(0, 100, left=1, right=2, feature=0, threshold=5.0),
    node(1, 60, left=3, right=4, feature=1, threshold=2.0),
    node(2, 40, prediction=7.0),
    node(3, 20, left=5, right=6, feature=0, threshold=1.0),
    node(4, 40, prediction=-2.0),
    node(5, 5, prediction=1.0),
    node(6, 15, prediction=3.0),
]}


def conditional(x, known, at=0):
    """Tree expectation when only the features in ``known`` are given."""
    n = TREE[at]
    if n["left"] < 0:
        return n["prediction"]
    if n["feature"] in known:
        return conditional(x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
    return sum(TREE[c]["count"] / n["count"] * conditional(x, known, c)
               for c in (n["left"], n["right"]))


@pytest.mark.parametrize("x", [[0.5, 1.0, 9.0], [3.0, 1.0, 0.0], [4.0, 8.0, 0.0], [6.0, 1.0, 1.0]])
def test_shapley_values_match_all_orderings(x):
    want = np.zeros(3)
    orders = list(permutations(range(3)))
    for order in orders:
        for i, f in enumerate(order):
            want[f] += conditional(x, order[:i + 1]) - conditional(x, order[:i])
    leaves = treeshap.tree_leaves(TREE, 1.0)
    got = treeshap.shap_values(leaves, np.array([x]))[0]
    assert got == pytest.approx(want / len(orders), abs=1e-12)
    assert got.sum() + treeshap.expected_value(leaves) == pytest.approx(conditional(x, (0, 1, 2)))
