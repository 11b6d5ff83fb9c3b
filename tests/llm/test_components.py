import random

from tallyscope.llm.components import components, groups_within


def test_paths_stars_and_loops(spark):
    rng = random.Random(5)
    nodes = rng.sample(range(10**6), 120)
    path = list(zip(nodes[:40], nodes[1:40], strict=False))
    star = [(nodes[50], n) for n in nodes[51:90]]
    loops = [(nodes[100], nodes[100]), (nodes[101], nodes[102]), (nodes[102], nodes[101]), (None, 1)]
    links = spark.createDataFrame(path + star + loops, "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    want = {n: min(nodes[:40]) for n in nodes[:40]} | {n: min(nodes[50:90]) for n in nodes[50:90]}
    assert found == want | {n: min(nodes[101:103]) for n in nodes[101:103]}
    assert components(links.limit(0)).count() == 0


def test_groups_within_some_hops_are_parts_of_components(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    links = spark.createDataFrame(rows, "a long, b long")
    whole = {r.id: r.component for r in components(links).collect()}
    near = {r.id: r.component for r in groups_within(links, hops=3).collect()}
    assert near.keys() == whole.keys()
    assert all(whole[label] == whole[i] for i, label in near.items())
    far = {r.id: r.component for r in groups_within(links, hops=30).collect()}
    assert far == whole
