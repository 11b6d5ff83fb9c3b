"""Mixtures, learning rows and held-out accuracy."""

import numpy as np
import pytest

from tallyscope.llm import langid

WORDS = {"aa": ["kalo", "mira", "teno", "salu", "porami"], "bb": ["xquz", "zwik", "vrex", "ghyz", "qwert"],
         "cc": ["oué", "éaux", "çais", "être", "naïf"]}


def corpus(n=300):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang], 20)), lang))
    return rows


def model_of(rows):
    counts = np.zeros((3, langid.CELLS))
    for _, text, lang in rows:
        cells, _ = langid.trigram_cells([text])
        counts[list(WORDS).index(lang)] += np.bincount(cells, minlength=langid.CELLS)
    return langid.LanguageModel(list(WORDS), counts)


def test_held_out_accuracy(documents_of):
    rows = corpus()
    found = langid.identified_languages(documents_of(rows)).collect()
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in found if r.held_out]
    assert len(found) == len(rows) and held
    assert all(r.lang_pred == lang[r.doc_id] and 0 <= r.score <= 1 for r in held)


def test_mixtures_have_their_proportions():
    rows = corpus()
    model = model_of(rows)
    mixed = rows[0][1] + " " + rows[1][1] + " " + rows[3][1]
    shares, _ = model.mixtures([rows[0][1], mixed, "", None])
    assert shares[0] == pytest.approx([1, 0, 0])
    assert shares[1][0] == pytest.approx(2 / 3, abs=0.08) and shares[1][2] == 0
    assert not shares[2:].any()
    alone, _ = model.mixtures([mixed])
    assert alone[0] == pytest.approx(shares[1])


def test_held_out_rows_teach_nothing(documents_of):
    rows = corpus(40)
    df = documents_of([*rows, (None, "text", None)])
    held = {r.doc_id for r in df.select("doc_id", langid.held_out("doc_id").alias("h")).collect() if r.h}
    left = documents_of([r for r in rows if r[0] not in held])
    assert sorted(map(tuple, langid.learn_counts(df).collect())) == sorted(
        map(tuple, langid.learn_counts(left).collect()))


def test_odd_rows_and_nothing_learned(odd_documents, documents_of):
    found = langid.identified_languages(odd_documents).collect()
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    assert len(found) == odd_documents.count()
    for r in found:
        lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not lettered)
    nothing = langid.identified_languages(documents_of([(1, "a text"), (2, None)])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.identified_languages(odd_documents.limit(0)).count() == 0


def test_stage_keeps_clean_documents_and_columns(documents_of):
    rows = corpus(60)
    df = documents_of([*rows, (100, "7f3a9c 0b1d 42 ???"), (101, None), (102, "...")])
    kept = langid.in_a_language(df.withColumnRenamed("source", "_score"))
    assert kept.columns == [*df.columns[:3], "_score", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == set(range(60))
