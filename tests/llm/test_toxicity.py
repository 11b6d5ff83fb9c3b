"""Gradients against differences, windows, and held-out accuracy."""

import numpy as np
import pytest

from tallyscope.llm import toxicity


def test_gradients_equal_differences():
    p = {k: v.astype(float) for k, v in toxicity.new_parameters().items()}
    rng = np.random.default_rng(0)
    ids, mask = rng.integers(0, 5, (3, 6)), np.arange(6) < np.array([6, 4, 0])[:, None]
    gates, weights = rng.standard_normal((5, 6 * toxicity.HIDDEN)), rng.standard_normal(3)

    def loss():
        return float((toxicity.forward(p, gates, ids, mask) * weights).sum())

    _, kept = toxicity.forward(p, gates, ids, mask, keep=True)
    found, d_gates = toxicity.backward(p, gates, ids, mask, kept, weights)
    for table, slope in [*((p[n], found[n]) for n in ("wo", "bo", "va", "wa", "u")), (gates, d_gates)]:
        at = tuple(int(rng.integers(0, n)) for n in table.shape)
        before = table[at]
        table[at] = before + 1e-6
        up = loss()
        table[at] = before - 1e-6
        down = loss()
        table[at] = before
        assert slope[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-8)


def test_windows_cover_every_word():
    lengths = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 500])
    position, mask, text = toxicity.window_index(lengths)
    assert set(text) == set(range(5))
    starts = np.cumsum(lengths) - lengths
    for i, n in enumerate(lengths):
        inside = position[text == i][mask[text == i]]
        assert set(inside) == set(range(starts[i], starts[i] + n))


def test_word_rows_depend_on_the_word_alone():
    alone = [toxicity.word_rows([w]) for w in ("abc", "é", "longer")]
    own, cells, starts = toxicity.word_rows(["abc", "é", "longer"])
    ends = [*starts[1:], len(cells)]
    for i, (o, c, _) in enumerate(alone):
        assert own[i] == o[0] and list(cells[starts[i] : ends[i]]) == list(c)


def test_learns_and_holds_out(spark, documents_of, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 8)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(500):
        text = list(rng.choice(words, int(rng.integers(5, 120))))
        if toxic := int(i % 3 == 0):
            text[int(rng.integers(0, len(text)))] = str(rng.choice(["vile", "awful"]))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    df = documents_of(rows)
    table = spark.createDataFrame([*labels, labels[0], (None, 1), (7, None)], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(df, table).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 500 and len(held) > 50
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows_and_too_few_labels(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(odd_documents, labels).collect()
    assert len(found) == odd_documents.count() and len({r.score for r in found}) == 1
    none = toxicity.toxicity_scores(odd_documents, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    scorer = toxicity.Scorer(toxicity.new_parameters())
    odd = [r.text for r in odd_documents.collect()]
    assert np.isfinite(scorer.scores(odd)).all()
    assert toxicity.toxicity_scores(odd_documents.limit(0), labels).count() == 0
