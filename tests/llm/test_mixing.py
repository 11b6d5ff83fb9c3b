"""Budgets, order and the mix itself."""

from collections import Counter, defaultdict

import pytest

from tallyscope.llm import mixing


def targets_of(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight, caps, and the excess shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left, whole = total - sum(fixed.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def rows_of():
    counts = {"a": 40, "b": 3, "c": 2, None: 9, "": 5, "d": 1}
    rows = []
    for source, n in counts.items():
        for k in range(n):
            rows.append((len(rows), "w " * (1 + (7 * k) % 11), None, source))
    return rows + [(1000, None, None, "a"), (1001, "", None, "e"), (1002, " \n", None, "b")]


def test_budgets_are_exact(documents_of):
    rows = rows_of()
    found = mixing.mixed_sizes(documents_of(rows)).collect()
    source = {r[0]: r[3] for r in rows}
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    want, taken = targets_of(size), Counter()
    for r in found:
        assert r.size == len((rows_by_id(rows)[r.doc_id] or "").split())
        assert r.source_size == size[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(found) == len(rows)
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.5
    again = mixing.mixed_sizes(documents_of(rows[::-1])).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def rows_by_id(rows):
    return {r[0]: r[1] for r in rows}


def test_the_mix_holds_the_words_it_counts(documents_of):
    df = documents_of([*rows_of(), (3, "w w w", None, "a")])
    counted = mixing.mixed_sizes(df).groupBy().sum("taken").first()[0]
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == counted
    assert all(r.n_chars == len(r.text) for r in mixed.collect())


def test_repeated_ids_leave_each_source_its_budget(documents_of):
    """One id in all sources, with sizes that meet too."""
    rows = [(k % 5, f"{s} " * (1 + k % 4), None, s) for s, n in (("a", 30), ("b", 70), (None, 20))
            for k in range(n)]
    df = documents_of(rows)
    mixed = Counter()
    for r in mixing.mixed_documents(df).collect():
        mixed[r.source] += len(r.text.split())
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    for source, target in targets_of(size).items():
        assert abs(mixed[source] - target) <= 0.5
        assert mixed[source] <= 3 * size[source]


def test_odd_rows_and_empty(odd_documents):
    assert mixing.mixed_sizes(odd_documents).count() == odd_documents.count()
    assert mixing.mixed_documents(odd_documents).columns == odd_documents.columns
    mixing.mixed_documents(odd_documents).collect()
    assert mixing.mixed_sizes(odd_documents.limit(0)).count() == 0
