"""Language-model scores of texts: the marginal likelihood over all subword segmentations.

A document is the sequence of its words and an end. The model emits whole words of the training
documents, pieces of a given subword vocabulary, and the end, each independently of what came
before. The probability of a word is the sum over all paths of its lattice: every way to spell the
marked word with pieces, plus the arc of the whole word where the corpus holds it. The sum is taken
by the forward recursion in log space, over byte positions; single bytes are always pieces, so
every word has a path. A document's probability is the product over its words and its end.

The vocabulary's own scores give the first weights: log probabilities of a unigram model as they
are; the scores of a BPE model are ranks of merges and become Zipf weights 1 / (1 + rank). They stay
as a prior worth ``PRIOR`` emissions, while expectation-maximisation fits the weights to the
training words: forward and backward sums give each arc's expected use. Whole words are counted
leaving one out, so a word seen once has to be spelled by pieces, as unseen words will have to be.

Distinct words are counted, scored and joined in Spark; what is sent to every task is the vocabulary
and at most ``FREQUENT`` short words of highest count. Words beyond these meet a document's row by
a join on the word, in which no word holds more than one in ``FREQUENT`` of all tokens.

Defined results: letters A-Z are lower-cased, words are runs without ASCII white space; a null or
empty text is its end alone. Rows without an id are scored and not learned from. Every row gives a
row, also equal ones and those without an id. An empty table gives no rows; a table without
training rows is scored by the prior. Words and texts of any length are scored whole. Extra columns
of any name are neither read nor returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import in_small_batches
from tallyscope.session import staged

MARK = "▁"
#: Emissions that the vocabulary's own scores are worth against the corpus.
PRIOR = 1000.0
#: Rounds of expectation-maximisation.
ROUNDS = 3
#: Words looked up without a join, and the longest one of them in bytes.
FREQUENT = 1 << 16
FREQUENT_BYTES = 64
#: Distinct words that a task counts before it sends them; bounds memory only.
HELD_WORDS = 200_000
#: Bytes of distinct words that are scored together; bounds memory only.
STEP_BYTES = 100_000
NEVER = -np.inf


class Vocabulary:
    """The byte strings of the pieces and their prior weights; the mark is the byte of a space."""

    def __init__(self, weights: dict[bytes, float]):
        least = min(weights.values(), default=1.0)
        self.pieces = sorted(weights.keys() | {bytes([b]) for b in range(256)})
        prior = np.array([weights.get(p, least) for p in self.pieces])
        self.prior = prior / prior.sum()
        self._trie = None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads the pieces and scores of a SentencePiece model file."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        # a mark after another character can't occur in a marked word
        normal = [p for p in model.pieces if p.type == kind.NORMAL and MARK not in p.piece[1:]]
        ranked = model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        best = max((p.score for p in normal), default=0.0)
        return cls({p.piece.replace(MARK, " ").encode():
                    1 / (1 + best - p.score) if ranked else math.exp(p.score) for p in normal})

    def __getstate__(self):
        return self.__dict__ | {"_trie": None}

    def trie(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state by state and byte, and the piece that ends in a state; -1 where there is none."""
        if self._trie is None:
            states, steps, ends = {b"": 0}, [], {}
            for i, piece in enumerate(self.pieces):
                state = 0
                for n in range(1, len(piece) + 1):
                    following = states.setdefault(piece[:n], len(states))
                    steps.append((state, piece[n - 1], following))
                    state = following
                ends[state] = i
            following = np.full((len(states), 256), -1, np.int32)
            rows, columns, targets = np.array(steps).T
            following[rows, columns] = targets
            piece_at = np.full(len(states), -1, np.int32)
            piece_at[list(ends.keys())] = list(ends.values())
            self._trie = following, piece_at
        return self._trie


class Lattice:
    """All arcs of the spellings of some words: nodes are byte positions, arcs are pieces.

    Nodes of all words are numbered through, one more than bytes in each word; arcs are ordered by
    the depth of their last node, then by that node.
    """

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        following, piece_at = vocabulary.trie()
        spelled = np.frombuffer(b" ".join([b"", *words]) if words else b"", np.uint8)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(sizes)
        word_of = np.repeat(np.arange(len(words)), sizes)
        stop = np.repeat(ends, sizes)
        at, state = np.arange(len(spelled)), np.zeros(len(spelled), np.int32)
        starts, lasts, pieces, length = [], [], [], 0
        while len(at):
            inside = at + length < stop[at]
            at, state = at[inside], state[inside]
            state = following[state, spelled[at + length]]
            known = state >= 0
            at, state, length = at[known], state[known], length + 1
            piece = piece_at[state]
            whole = piece >= 0
            starts.append(at[whole])
            lasts.append(at[whole] + length)
            pieces.append(piece[whole])
        start, last = np.concatenate(starts or [at]), np.concatenate(lasts or [at])
        piece = np.concatenate(pieces or [at])
        self.word = word_of[start]
        self.first_node = ends - sizes + np.arange(len(words))
        self.last_node = ends + np.arange(len(words))
        depth = last - (ends - sizes)[self.word]
        order = np.lexsort((last, depth))
        self.start, self.last = (start + self.word)[order], (last + self.word)[order]
        self.piece, self.word = piece[order], self.word[order]
        self.nodes = len(spelled) + len(words)
        self._forward_runs = _runs(depth[order], self.last)
        begin = (start - (ends - sizes)[word_of[start]])[order]
        self._back = np.lexsort((self.start, -begin))
        self._backward_runs = _runs(-begin[self._back], self.start[self._back])

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Log of the sum over all paths from a word's first node to each node."""
        sums = np.full(self.nodes, NEVER)
        sums[self.first_node] = 0
        arcs = weights[self.piece]
        for lo, hi, firsts in self._forward_runs:
            values = sums[self.start[lo:hi]] + arcs[lo:hi]
            sums[self.last[lo:hi][firsts]] = _log_sums(values, firsts)
        return sums

    def backward(self, weights: np.ndarray) -> np.ndarray:
        """Log of the sum over all paths from each node to its word's last node."""
        sums = np.full(self.nodes, NEVER)
        sums[self.last_node] = 0
        start, last, arcs = self.start[self._back], self.last[self._back], weights[self.piece][self._back]
        for lo, hi, firsts in self._backward_runs:
            values = sums[last[lo:hi]] + arcs[lo:hi]
            sums[start[lo:hi][firsts]] = _log_sums(values, firsts)
        return sums

    def spellings(self, weights: np.ndarray) -> np.ndarray:
        """Log of the sum over all spellings of each word."""
        return self.forward(weights)[self.last_node]

    def expected(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, and for each arc the share of its word's spellings that use it."""
        ahead, behind = self.forward(weights), self.backward(weights)
        total = ahead[self.last_node]
        use = ahead[self.start] + weights[self.piece] + behind[self.last] - total[self.word]
        return total, np.exp(use)


def _runs(depth: np.ndarray, node: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Stretches of arcs of one depth, and where each node's arcs start within the stretch."""
    if not len(depth):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(depth)) + 1), len(depth)]
    fresh = np.append(True, np.diff(node) != 0)
    return [(lo, hi, np.flatnonzero(fresh[lo:hi])) for lo, hi in zip(cuts, cuts[1:])]


def _log_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    most = np.maximum.reduceat(values, firsts)
    sizes = np.diff(np.append(firsts, len(values)))
    return most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, sizes)), firsts))


class Weights:
    """Emission probabilities: log weight of every piece, of a whole word and of the end."""

    def __init__(self, used: np.ndarray, whole: float, documents: float, prior: np.ndarray):
        """From expected uses of the pieces, of whole words, and the number of ends."""
        ends = documents + PRIOR / len(prior)
        spelled = used + PRIOR * prior
        total = spelled.sum() + ends + whole
        with np.errstate(divide="ignore"):
            self.pieces = np.log(spelled / total)
            self.whole = float(np.log(whole / total))
        self.end = math.log(ends / total)

    def whole_words(self, counts: np.ndarray, tokens: float) -> np.ndarray:
        """Log weight of the whole-word arcs of words seen so often among ``tokens`` words."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(counts > 0, self.whole + np.log(counts / max(tokens, 1.0)), NEVER)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and counts in steps of bounded length; a longer word is a step of its own."""
    words, counts, held = [], [], 0
    for batch in batches:
        for word, count in zip(batch.column("word").to_pylist(), batch.column("count").to_pylist()):
            if held and held + len(word) > STEP_BYTES:
                yield words, np.array(counts, float)
                words, counts, held = [], [], 0
            words.append(word)
            counts.append(count)
            held += len(word) + 1
    if words:
        yield words, np.array(counts, float)


def _words(texts: pa.Array) -> Iterator[list[bytes]]:
    """Lower-cased words of UTF-8 texts; bytes know only the ASCII letters and white space."""
    for text in texts:
        raw = text.as_py()
        yield raw.lower().split() if raw else []


def learned(doc_id: str) -> Column:
    """Rows that the model may learn from: the id's checksum modulo 7 is not 2; not without id."""
    key = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7
    return F.coalesce(key != 2, F.lit(False))


def held_out(doc_id: str) -> Column:
    key = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7
    return F.coalesce(key == 2, F.lit(False))


def word_counts(documents: DataFrame, training: Column) -> DataFrame:
    """word (UTF-8), count: every distinct word of all texts and how often training texts hold it."""
    rows = in_small_batches(documents.select(
        F.col("text").cast("binary").alias("text"), training.alias("training")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            for words, counts in zip(_words(batch.column("text")),
                                     batch.column("training").to_pylist()):
                if counts:
                    held.update(words)
                else:
                    for word in words:
                        if word not in held:
                            held[word] = 0
                if len(held) > HELD_WORDS:
                    yield sent(held)
                    held = Counter()
        if held:
            yield sent(held)

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())],
            names=["word", "count"])

    return (rows.mapInArrow(count, "word binary, count long")
            .groupBy("word").agg(F.sum("count").alias("count")))


def fitted(counts: DataFrame, vocabulary: Vocabulary, documents: int, tokens: int,
           rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds`` of expectation-maximisation over the training words of ``counts``,
    for so many training documents and words. Each round sends one number per piece to the driver."""
    context = counts.sparkSession.sparkContext
    shared, size = context.broadcast(vocabulary), len(vocabulary.pieces)
    weights = Weights(vocabulary.prior * tokens, float(tokens), documents, vocabulary.prior)
    seen = in_small_batches(counts.where("count > 0"))
    for _ in range(rounds if tokens else 0):
        now = context.broadcast(weights)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used, whole, current = np.zeros(size), 0.0, now.value
            for words, counted in _steps(batches):
                lattice = Lattice(words, shared.value)
                spelled, shares = lattice.expected(current.pieces)
                # leaving one out: the other occurrences are what predicts an occurrence
                other = current.whole_words(counted - 1, tokens - 1)
                as_word = np.exp(other - np.logaddexp(other, spelled))
                whole += float(as_word @ counted)
                by_word = (1 - as_word) * counted
                used += np.bincount(lattice.piece, shares * by_word[lattice.word], size)
            hit = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(hit, -1)), pa.array(np.append(used[hit], whole))],
                names=["piece", "used"])

        # the sum per piece in a fixed order: reruns agree to the last digit
        rows = (seen.mapInArrow(expect, "piece long, used double").groupBy("piece")
                .agg(F.expr("aggregate(array_sort(collect_list(used)), 0D, (a, x) -> a + x)")
                     .alias("used")).toPandas())
        found = rows.set_index("piece")["used"]
        used = found.drop(-1, errors="ignore")
        totals = np.zeros(size)
        totals[used.index.to_numpy(int)] = used.to_numpy(float)
        weights = Weights(totals, float(found.get(-1, 0.0)), documents, vocabulary.prior)
    return weights


def word_scores(counts: DataFrame, vocabulary: Vocabulary, weights: Weights, tokens: int) -> DataFrame:
    """``counts`` with ``logp``, the natural log of each word's probability over all its paths."""
    context = counts.sparkSession.sparkContext
    shared, fixed = context.broadcast(vocabulary), context.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counted in _steps(batches):
            spelled = Lattice(words, shared.value).spellings(fixed.value.pieces)
            logp = np.logaddexp(spelled, fixed.value.whole_words(counted, tokens))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(counted.astype(np.int64)), pa.array(logp)],
                names=["word", "count", "logp"])

    return in_small_batches(counts).mapInArrow(score, "word binary, count long, logp double")


def _with_frequent(documents: DataFrame, key: str, training: Column, scores: DataFrame,
                   base: float, frequent: int) -> DataFrame:
    """Sums over the frequent words of every row; the other words and their numbers are listed."""
    top = (scores.where(F.octet_length("word") <= FREQUENT_BYTES)
           .orderBy(F.desc("count"), "word").limit(frequent).collect())
    shared = documents.sparkSession.sparkContext.broadcast(
        {bytes(r["word"]): (int(r["count"] > 0), math.log10(r["count"] + 1) - base, r["logp"])
         for r in top})
    rows = in_small_batches(documents.select(
        F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"),
        training.alias("held_out"), F.col("text").cast("binary").alias("text")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sums, words, times = [], [], []
            for found in _words(batch.column("text")):
                n, known, base_sum, logp, rest, rest_times = len(found), 0, 0.0, 0.0, [], []
                for word, k in Counter(found).items():
                    if (entry := table.get(word)) is None:
                        rest.append(word)
                        rest_times.append(k)
                    else:
                        known += k * entry[0]
                        base_sum += k * entry[1]
                        logp += k * entry[2]
                sums.append((n, known, base_sum, logp))
                words.append(rest)
                times.append(rest_times)
            columns = list(zip(*sums)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("row"), batch.column("held_out"),
                 pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()),
                 pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))],
                names=["key", "row", "held_out", "n", "known", "base", "logp", "words", "times"])

    return rows.mapInArrow(
        look_up, f"key {rows.schema['key'].dataType.simpleString()}, row long, held_out boolean, "
        "n long, known long, base double, logp double, words array<binary>, times array<int>")


def likelihoods(documents: DataFrame, model: str, rounds: int = ROUNDS,
                frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``base_score`` is the add-one unigram score of the words and the end; ``score`` the model's
    log10 probability of the text. ``frequent`` changes no result.
    """
    vocabulary = Vocabulary.load(model)
    training = learned("doc_id")
    counts = staged(word_counts(documents, training), "word-counts")
    n_documents = documents.where(training).count()
    words, distinct = counts.where("count > 0").agg(
        F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    n, v = words + n_documents, distinct + (n_documents > 0)
    base = math.log10(n + v + 1)

    weights = fitted(counts, vocabulary, n_documents, words, rounds)
    scores = staged(word_scores(counts, vocabulary, weights, words), "word-scores")
    partly = staged(_with_frequent(documents, "doc_id", held_out("doc_id"), scores, base, frequent),
                    "lm-partly")
    rest = (partly.select("row", F.explode(F.arrays_zip("words", "times")).alias("x"))
            .select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
            .join(scores, "word").groupBy("row").agg(
                F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("more_known"),
                F.sum(F.col("times") * (F.log10(F.col("count") + 1) - base)).alias("more_base"),
                F.sum(F.col("times") * F.col("logp")).alias("more_logp")))
    base_end, zero = math.log10(n_documents + 1) - base, F.lit(0.0)
    return partly.join(rest, "row", "left").select(
        F.col("key").alias("doc_id"), "held_out", (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(n_documents > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + base_end).alias("base_score"),
        ((F.col("logp") + F.coalesce("more_logp", zero) + weights.end) / math.log(10)).alias("score"))
