"""Links and components against all pairs."""

import numpy as np
import pytest

from tallyscope.llm import embedding_dedup as dedup


def vectors():
    rng = np.random.default_rng(1)
    out = []
    for size, noise in [(9, 0.27)] * 15 + [(60, 0.1)] + [(1, 0.0)] * 150:
        centre, label = rng.standard_normal(48), int(rng.integers(0, 3))
        out += [(centre + noise * rng.standard_normal(48), label) for _ in range(size)]
    out += [out[int(rng.integers(0, len(out)))] for _ in range(20)]
    rows = [(list(map(float, np.float32(v))), label) for v, label in out]
    rows += [(None, 0), ([0.0] * 48, 0), ([1.0] * 47 + [float("nan")], 0), ([1.0] * 48, None),
             ([], 0), ([1.0] * 32, 1), ([1.0] * 31 + [None], 1), ([float("inf")] * 48, 1)]
    return [(int(i), *r) for i, r in zip(rng.permutation(len(rows)), rows, strict=True)]


def brute(rows):
    alive = [(i, np.float64(np.float32(v)), k) for i, v, k in rows
             if v and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x, k) in enumerate(alive):
        for j, y, m in alive[:a]:
            if k == m and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i in links}


@pytest.mark.parametrize("block", [2048, 25])
def test_links_equal_all_pairs(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = dedup.linked_vectors(df.selectExpr("*", "1 as rep", "2 as links"), block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_repeated_rows_rows_without_id_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (2, [1.0, 2.0], 1),
                                (None, [1.0, 2.0], 1)], schema)
    found = sorted(map(tuple, dedup.linked_vectors(df).collect()), key=str)
    assert found == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (None, 0, None, False)]
    assert dedup.linked_vectors(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose((dedup.hadamard(x) ** 2).sum(1), 16 * (x * x).sum(1))
