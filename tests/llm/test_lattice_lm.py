"""The subword lattice model against plain loops over all segmentations."""

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from tallyscope.llm import lattice_lm as lm
from tallyscope.llm.common import table
from tallyscope.llm.queries import PIECES

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.fixture(scope="module")
def vocabulary():
    return lm.Vocabulary.load(PIECES)


def segmentations(word, pieces):
    """All ways to cut a marked word into pieces."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            yield from ([word[:n], *rest] for rest in segmentations(word[n:], pieces))


def lower(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def rest_of(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def expected(rows, vocabulary, rounds):
    """The whole model by enumeration: weights per piece after the rounds, then every row."""
    pieces, prior = vocabulary.pieces, dict(zip(vocabulary.pieces, vocabulary.prior))

    @lru_cache(maxsize=None)
    def cuts(word):
        return [tuple(s) for s in segmentations(b" " + word, prior)]

    training = [lower(t or "") for i, t in rows if i is not None and rest_of(i, 7) != 2]
    counts, ends = Counter(w for words in training for w in words), len(training)
    tokens = sum(counts.values())
    used, whole = {p: prior[p] * tokens for p in pieces}, float(tokens)
    for again in range(rounds + 1 if tokens else 1):
        total = (sum(used.values()) + lm.PRIOR + ends + lm.PRIOR / len(pieces) + whole)
        q = {p: (used.get(p, 0.0) + lm.PRIOR * prior[p]) / total for p in pieces}
        q_whole, q_end = whole / total, (ends + lm.PRIOR / len(pieces)) / total
        if again == rounds or not tokens:
            break
        used, whole = {}, 0.0
        for word, c in counts.items():
            ways = [(cut, math.prod(q[p] for p in cut)) for cut in cuts(word)]
            spelled = sum(x for _, x in ways)
            as_word = q_whole * (c - 1) / max(tokens - 1, 1)
            whole += c * as_word / (as_word + spelled)
            for cut, x in ways:
                for p in cut:
                    used[p] = used.get(p, 0.0) + c * x / (as_word + spelled)
    n, v = tokens + ends, len(counts) + (ends > 0)
    out = []
    for key, text in rows:
        words = lower(text or "")
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        score = sum(math.log10(q_whole * counts[w] / max(tokens, 1)
                               + sum(math.prod(q[p] for p in cut) for cut in cuts(w))) for w in words)
        out.append((key, rest_of(key, 7) == 2, len(words) + 1,
                    sum(counts[w] > 0 for w in words) + (ends > 0), n,
                    base + math.log10((ends + 1) / (n + v + 1)), score + math.log10(q_end)))
    return out


def close(got, want):
    def order(rows):
        return sorted(rows, key=lambda r: (str(r[0]), r[2], round(r[6], 6)))

    assert len(got) == len(want)
    for g, w in zip(order(got), order(want)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9), (g, w)


def check(df, vocabulary, **options):
    got = lm.likelihoods(df, PIECES, **options)
    assert got.columns == COLUMNS
    rows = [tuple(r) for r in got.collect()]
    close(rows, expected([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()],
                         vocabulary, options.get("rounds", lm.ROUNDS)))
    return rows


TEXTS = ["the cat sat on The mat", "a cat ate the rat", "ÉTÉ été", "xq zx", "the the the", "tea\x0beat\ttea",
         "mat rat sat", "", None, "  ", "日本 ok", "aba aba abab"]


@pytest.mark.parametrize("options", [{}, {"frequent": 0, "rounds": 1}, {"frequent": 3, "rounds": 0}])
def test_equals_enumeration(documents_of, vocabulary, options):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(30)] + [(None, "the cat"), (3, TEXTS[3]), (3, "x")]
    check(documents_of(rows), vocabulary, **options)


def test_nothing_to_learn_from(documents_of, vocabulary):
    unlearned = [i for i in range(99) if rest_of(i, 7) == 2]
    rows = check(documents_of([(i, "the cat") for i in unlearned] + [(None, "rat")]), vocabulary)
    assert {r[3] for r in rows} == {0} and {r[4] for r in rows} == {0}
    assert lm.likelihoods(documents_of([(1, "a")]).limit(0), PIECES).collect() == []


def test_clashing_columns(documents_of, vocabulary):
    df = documents_of([(i, "the rat sat") for i in range(9)])
    for name in ("key", "row", "word", "count", "words", "times", "score", "held_out", "training", "x"):
        df = df.withColumn(name, df.text)
    check(df, vocabulary)


def test_odd_texts(odd_documents):
    rows = lm.likelihoods(odd_documents, PIECES, rounds=1).collect()
    assert len(rows) == odd_documents.count()
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.base_score) for r in rows)


def test_a_long_word_does_not_underflow(vocabulary):
    weights = np.log(vocabulary.prior)
    single = lm.Lattice([b"x" * 50_000], vocabulary)
    total, shares = single.expected(weights)
    assert math.isfinite(total[0]) and total[0] < -10_000
    # every spelling covers each byte once
    sizes = np.array([len(p) for p in vocabulary.pieces])
    assert shares @ sizes[single.piece] == pytest.approx(50_001)
    alone = [lm.Lattice([w], vocabulary).spellings(weights)[0] for w in (b"x", b"the", b"x" * 999)]
    together = lm.Lattice([b"x", b"the", b"x" * 999], vocabulary).spellings(weights)
    assert together.tolist() == pytest.approx(alone)


def test_fitting_makes_held_out_texts_likelier(spark):
    """Base scores give every unseen word the same share and so aren't probabilities of texts."""
    documents = table(spark, "/root/testdata/sf0.01", "documents")

    def per_token(rounds):
        return lm.likelihoods(documents, PIECES, rounds=rounds).where("held_out").selectExpr(
            "sum(score) / sum(n_tokens)").first()[0]

    assert per_token(lm.ROUNDS) > per_token(0) + 0.5
