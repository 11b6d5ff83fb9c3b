"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a hashed word vector and the mean of its hashed byte 3- and 5-gram vectors.
Texts are cut into overlapping windows of words that cover all of them; each window is read in
both directions, pooled by attention and scored, and a text's score is its largest window score.
The network is trained in numpy from labels of texts only: the loss is on the smooth maximum of a
text's window scores first and on its largest one later.

Training takes at most ``PER_CLASS`` labelled texts of each class (``CLEAN_PER_TOXIC`` times as
many clean ones) of at most ``LONGEST_TAUGHT`` characters, in hash order of their ids, and never
rows of the held-out fifth. Scoring covers every row and every word.

Null and empty texts, and texts without a word, are one empty window. Without labelled texts of
both classes all scores are the share of toxic ones seen (0 if none). Rows with equal text have
equal scores; repeated labels count once, toxic if any says so; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import held_out, in_small_batches, pieces

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 24
WORD_ROWS, CHAR_BITS, WIDTH, HIDDEN = 8192, 14, 12, 8
PER_CLASS, CLEAN_PER_TOXIC, LONGEST_TAUGHT = 1200, 2, 20_000
EPOCHS, SMOOTH_EPOCHS, BATCH_TEXTS, RATE = 6, 3, 32, 0.01
#: Windows scored at once, and words whose input gates a task remembers; both bound memory only.
STEP_WINDOWS, REMEMBERED = 512, 200_000

WORDS = re.compile(r"[^\W_]+")

Parameters = dict[str, np.ndarray]


def new_parameters(seed: int = 7, dtype=np.float32) -> Parameters:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(dtype)

    return {
        "word": normal(WORD_ROWS, WIDTH, scale=0.1), "char": normal(1 << CHAR_BITS, WIDTH, scale=0.1),
        "wx": normal(WIDTH, 6 * HIDDEN, scale=0.4), "bx": np.zeros(6 * HIDDEN, dtype),
        "u": normal(2, HIDDEN, 3 * HIDDEN, scale=0.3),
        "wa": normal(2 * HIDDEN, HIDDEN, scale=0.3), "va": normal(HIDDEN, scale=0.3),
        "wo": normal(2 * HIDDEN, scale=0.3), "bo": np.full(1, -1.0, dtype),
    }


def word_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word row of each word; the char rows of all words and where each word's begin.

    Each byte of a word gives two char rows: of the three bytes around it and of the five bytes
    from its left neighbour on, both with a border before and after the word (near its end the
    three bytes stand in for the five).
    """
    raw = [w.encode() for w in words]
    own = np.fromiter((crc32(w) % WORD_ROWS for w in raw), np.int64, len(raw))
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"<".join([b"", *raw, b"<<<"]), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths + 1) - lengths - 1  # of the border before each word
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    left = np.repeat(starts + lengths + 1, lengths) - at
    three = data[at] | data[at + 1] << np.uint64(8) | data[at + 2] << np.uint64(16)
    five = three | data[at + 3] << np.uint64(24) | data[at + 4] << np.uint64(32)
    grams = np.stack((three, np.where(left >= 4, five, three)), 1).ravel()
    cells = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHAR_BITS)
    return own, cells.astype(np.int64), 2 * (np.cumsum(lengths) - lengths)


def word_vectors(p: Parameters, rows) -> np.ndarray:
    own, cells, starts = rows
    counts = np.diff(np.r_[starts, len(cells)])[:, None].astype(p["char"].dtype)
    return p["word"][own] + np.add.reduceat(p["char"][cells], starts) / counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def window_index(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in the joined words, mask, text of each window); each text has a window."""
    more = np.maximum(0, -(-(lengths - WINDOW) // STRIDE)) + 1
    text = np.repeat(np.arange(len(lengths)), more)
    step = np.arange(len(text)) - np.repeat(np.cumsum(more) - more, more)
    inside = step[:, None] * STRIDE + np.arange(WINDOW)
    mask = inside < lengths[text][:, None]
    begin = np.cumsum(lengths) - lengths
    return np.where(mask, begin[text][:, None] + inside, 0), mask, text


def forward(p: Parameters, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray,
            keep: bool = False):
    """Logit of each window; ``gates`` has the input gates of each word, ids index it."""
    n, t = ids.shape
    h = np.zeros((2, n, HIDDEN), gates.dtype)
    both = np.empty((n, t, 2 * HIDDEN), gates.dtype)
    steps = []
    for i in range(t):
        j = t - 1 - i
        g = np.stack((gates[ids[:, i], : 3 * HIDDEN], gates[ids[:, j], 3 * HIDDEN :]))
        m = np.stack((mask[:, i], mask[:, j]))[..., None]
        gh = h @ p["u"]
        zr = sigmoid(g[..., : 2 * HIDDEN] + gh[..., : 2 * HIDDEN])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        hn = gh[..., 2 * HIDDEN :]
        c = np.tanh(g[..., 2 * HIDDEN :] + r * hn)
        new = np.where(m, c + z * (h - c), h)
        if keep:
            steps.append((h, z, r, c, hn, m))
        h = new
        both[:, i, :HIDDEN] = h[0]
        both[:, j, HIDDEN:] = h[1]
    tan = np.tanh(both @ p["wa"])
    e = np.where(mask, tan @ p["va"], -1e9)
    a = np.exp(e - e.max(1, keepdims=True)) * mask
    a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
    pooled = (a[:, None, :] @ both)[:, 0]
    logits = pooled @ p["wo"] + p["bo"][0]
    return (logits, (steps, both, tan, a, pooled)) if keep else logits


def summed_rows(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the sum of the values that name it."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(rows, kind="stable")
    named = rows[order]
    first = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
    out[named[first]] = np.add.reduceat(values[order], first)
    return out


def backward(p: Parameters, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, kept,
             d_logits: np.ndarray) -> tuple[Parameters, np.ndarray]:
    """Gradients of all but the input tables, and of the gates."""
    steps, both, tan, a, pooled = kept
    d = {"wo": pooled.T @ d_logits, "bo": d_logits.sum(keepdims=True)}
    d_pooled = d_logits[:, None] * p["wo"]
    d_both = a[..., None] * d_pooled[:, None]
    d_a = (both @ d_pooled[..., None])[..., 0]
    d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
    d["va"] = np.einsum("nt,ntk->k", d_e, tan)
    d_tan = d_e[..., None] * p["va"] * (1 - tan * tan)
    d["wa"] = np.einsum("nth,ntk->hk", both, d_tan)
    d_both += d_tan @ p["wa"].T
    d["u"] = np.zeros_like(p["u"])
    n, t = ids.shape
    d_in = np.empty((n, t, 6 * HIDDEN), gates.dtype)
    d_h = np.zeros((2, n, HIDDEN), gates.dtype)
    for i in reversed(range(t)):
        j = t - 1 - i
        h, z, r, c, hn, m = steps[i]
        d_h = d_h + np.stack((d_both[:, i, :HIDDEN], d_both[:, j, HIDDEN:]))
        d_new = d_h * m
        d_c = d_new * (1 - z) * (1 - c * c)
        d_z = d_new * (h - c) * z * (1 - z)
        d_r = d_c * hn * r * (1 - r)
        d_gh = np.concatenate((d_z, d_r, d_c * r), -1)
        d_g = np.concatenate((d_z, d_r, d_c), -1)
        d["u"] += h.transpose(0, 2, 1) @ d_gh
        d_h = d_h * ~m + d_new * z + d_gh @ p["u"].transpose(0, 2, 1)
        d_in[:, i, : 3 * HIDDEN] = d_g[0]
        d_in[:, j, 3 * HIDDEN :] = d_g[1]
    return d, summed_rows(ids.ravel(), d_in.reshape(n * t, -1), len(gates))


def gates_of(p: Parameters, vectors: np.ndarray) -> np.ndarray:
    return vectors @ p["wx"] + p["bx"]


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS) -> Parameters:
    """Adam on the mean log loss over texts, in a fixed random order."""
    p, rng = new_parameters(), np.random.default_rng(11)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORDS.findall(t.lower())],
                     np.int64) for t in texts]
    own, cells, starts = word_rows(list(vocabulary) or ["-"])
    ends = np.r_[starts[1:], len(cells)]
    labels, moments, step = np.array(toxic, np.float32), {}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for begin in range(0, len(docs), BATCH_TEXTS):
            chosen = order[begin : begin + BATCH_TEXTS]
            lengths = np.array([len(docs[i]) for i in chosen])
            joined = np.concatenate([docs[i] for i in chosen] + [np.zeros(1, np.int64)])
            distinct, local = np.unique(joined, return_inverse=True)
            position, mask, text = window_index(lengths)
            ids = local[position]
            span = ends[distinct] - starts[distinct]
            at = np.repeat(starts[distinct] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            rows = own[distinct], cells[at], (np.cumsum(span) - span)
            vectors = word_vectors(p, rows)
            gates = gates_of(p, vectors)
            if epoch >= SMOOTH_EPOCHS:  # the largest window of each text
                logits = forward(p, gates, ids, mask)
                ranked = np.lexsort((-logits, text))
                best = ranked[np.r_[True, text[ranked][1:] != text[ranked][:-1]]]
                ids, mask, text = ids[best], mask[best], text[best]
            logits, kept = forward(p, gates, ids, mask, keep=True)
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            top = np.maximum.reduceat(logits, first)[text]
            weight = np.exp(logits - top)
            total = np.add.reduceat(weight, first)
            smooth = top[first] + np.log(total)
            d_text = (sigmoid(smooth) - labels[chosen]) / len(chosen)
            d_logits = (weight / total[text] * d_text[text]).astype(gates.dtype)
            d, d_gates = backward(p, gates, ids, mask, kept, d_logits)
            d["wx"], d["bx"] = vectors.T @ d_gates, d_gates.sum(0)
            d_vectors = d_gates @ p["wx"].T
            d["word"] = summed_rows(rows[0], d_vectors, WORD_ROWS)
            d["char"] = summed_rows(rows[1], np.repeat(d_vectors / span[:, None], span, 0),
                                    1 << CHAR_BITS)
            step += 1
            for name, g in d.items():
                m, v = moments.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[name] = m, v
                change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                p[name] = (p[name] - change).astype(p[name].dtype)
    return p


class Scorer:
    """Scores of texts under trained parameters; remembers input gates of words."""

    def __init__(self, p: Parameters):
        self.p, self.rows, self.gates = p, {}, np.empty((0, 6 * HIDDEN), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = [WORDS.findall(t.lower()) if t else [] for t in texts]
        if len(self.rows) > REMEMBERED:
            self.rows, self.gates = {}, self.gates[:0]
        fresh = list(set().union(*words) - self.rows.keys())
        if fresh or not len(self.gates):
            fresh = fresh or ["-"]
            self.rows |= zip(fresh, range(len(self.gates), len(self.gates) + len(fresh)), strict=True)
            new = gates_of(self.p, word_vectors(self.p, word_rows(fresh))).astype(np.float32)
            self.gates = np.concatenate((self.gates, new))
        lengths = np.array([len(w) for w in words], np.int64)
        joined = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(words)), np.int64,
                             lengths.sum())
        joined = np.r_[joined, 0]
        position, mask, text = window_index(lengths)
        logits = np.concatenate([
            forward(self.p, self.gates, joined[position[i : i + STEP_WINDOWS]],
                    mask[i : i + STEP_WINDOWS])
            for i in range(0, len(text), STEP_WINDOWS)])
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        return sigmoid(np.maximum.reduceat(logits.astype(float), first))


def taught_texts(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """text, toxic of the bounded sample that the network learns from."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )

    def some(toxic: int, n: int) -> DataFrame:
        by_hash = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id")
        return by_hash.limit(n)

    chosen = some(1, per_class).unionByName(some(0, per_class * CLEAN_PER_TOXIC))
    # at most per_class * (1 + CLEAN_PER_TOXIC) ids
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(
        F.length("text") <= LONGEST_TAUGHT).select("doc_id", "text", "toxic")


def learn(documents: DataFrame, labels: DataFrame) -> tuple[Parameters | None, float]:
    """Trained parameters, or None and the score that all texts get instead."""
    rows = sorted((tuple(r) for r in taught_texts(documents, labels).collect()),
                  key=lambda r: (r[0], r[1]))
    toxic = [int(r[2]) for r in rows]
    if len(set(toxic)) < 2:
        return None, float(np.mean(toxic)) if toxic else 0.0
    return train([r[1] for r in rows], toxic), 0.0


def with_toxicity(df: DataFrame, learned: tuple[Parameters | None, float], text: str = "text",
                  name: str = "score") -> DataFrame:
    """``df`` with the score of ``text`` as ``name``."""
    shared = df.sparkSession.sparkContext.broadcast(learned)
    kept = in_small_batches(df.drop(name))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, constant = shared.value
        scorer = Scorer(p) if p is not None else None
        for batch in chain.from_iterable(pieces(b, text, 1_000_000) for b in batches):
            texts = batch.column(text).to_pylist()
            found = scorer.scores(texts) if scorer else np.full(len(texts), constant)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())],
                                             names=[*batch.schema.names, name])

    schema = T.StructType([*kept.schema, T.StructField(name, T.DoubleType())])
    return kept.mapInArrow(score, schema)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = documents.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return with_toxicity(rows, learn(documents, labels)).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
