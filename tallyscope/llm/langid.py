"""Language proportions of whole texts as a mixture, fitted by expectation-maximisation.

Learning counts hashed byte trigrams per language over all labelled rows: each task adds up fixed
arrays, so the table sent on has at most languages x 2 ** 16 cells however large the corpus. A
document's trigrams are then draws from a mixture of the languages' distributions. EM estimates
its proportions over all languages; the languages in order of proportion give nested sets, each
set is fitted again, and the set with the best log likelihood less ``PENALTY`` * ln(trigrams) per
further language is kept. The prediction is its largest part, the score that part's share.

Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing was
learned. Letters decide, case and ASCII digits or signs do not. Equal texts get equal results,
whatever rows lie beside them; ties go to the smaller language name. Rows without a label or an id
in the held-out fifth teach nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import free_prefix, held_out, in_small_batches, pieces

CELLS = 1 << 16
#: Pseudo-count of every cell of a language.
SMOOTHING = 0.5
ROUNDS = 12
#: Price of a further language, in units of ln(number of trigrams).
PENALTY = 1.0
#: Languages below this share of a document's first mixture are no candidates for its set.
LEAST_SHARE = 0.02
UNKNOWN = "und"
#: Characters of text that one step of a task works on; bounds memory only.
STEP_CHARS = 1_000_000

#: ASCII to lower-case letters, all else of ASCII to spaces; other bytes stay.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def trigram_cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of its text) of every byte trigram but those of blanks alone."""
    raw = [b" " + t.lower().encode("utf-8", "replace").translate(FOLD) + b"  " if t else b"   "
           for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    owner = np.repeat(np.arange(len(raw)), lengths)[:-2]
    # the last two bytes of a text are blanks, so no trigram with a letter spans two texts
    lettered = (data[:-2] != 32) | (data[1:-1] != 32)
    cells = (gram * np.uint32(2654435761)) >> np.uint32(16)
    return cells[lettered].astype(np.int64), owner[lettered]


def learn_counts(documents: DataFrame) -> DataFrame:
    """lang, cell, n: trigrams of all rows that may teach."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                           & ~held_out("doc_id")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in chain.from_iterable(pieces(b, "text") for b in batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = np.array(batch.column("text").to_pylist(), object)
            for lang in set(langs):
                cells, _ = trigram_cells(list(texts[langs == lang]))
                held = totals.setdefault(lang, np.zeros(CELLS, np.int64))
                held += np.bincount(cells, minlength=CELLS)
        for lang, held in totals.items():
            cell = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(cell), pa.string()),
                "cell": pa.array(cell, pa.int32()), "n": pa.array(held[cell], pa.int64())})

    parts = in_small_batches(rows).mapInArrow(count, "lang string, cell int, n long")
    return parts.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Distributions of the learned languages over the cells."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smoothed = counts + SMOOTHING
        # cells first, so that looking one up reads neighbouring numbers
        self.given = np.ascontiguousarray((smoothed / smoothed.sum(1, keepdims=True)).T)

    @classmethod
    def learn(cls, documents: DataFrame) -> LanguageModel:
        """At most languages x ``CELLS`` sums reach the driver."""
        sums = learn_counts(documents).toPandas()
        languages = sorted(sums["lang"].unique())
        counts = np.zeros((len(languages), CELLS))
        counts[np.searchsorted(languages, sums["lang"].to_numpy(str)) if len(languages) else [],
               sums["cell"].to_numpy(int)] = sums["n"].to_numpy(float)
        return cls(languages, counts)

    def mixtures(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages: each text's proportions, zero outside its chosen set; and per text
        the mean log likelihood of a trigram above that of uniform noise."""
        n, k = len(texts), len(self.languages)
        shares, fits = np.zeros((n, k)), np.zeros(n)
        cells, owner = trigram_cells(texts)
        if not k or not len(cells):
            return shares, fits
        key, times = np.unique(owner * CELLS + cells, return_counts=True)
        owner, given = key // CELLS, self.given[key % CELLS]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        there = owner[first]
        total = np.add.reduceat(times, first).astype(float)
        group = np.repeat(np.arange(len(there)), np.diff(np.r_[first, len(owner)]))

        def fit(mix: np.ndarray, given, times, group, first, total, rounds=ROUNDS):
            """EM from ``mix``; zero proportions stay zero. Also the final log likelihood."""
            for _ in range(rounds):
                part = given * mix[group]
                part *= (times / part.sum(1))[:, None]
                mix = np.add.reduceat(part, first) / total[:, None]
            like = np.add.reduceat(times * np.log((given * mix[group]).sum(1)), first)
            return mix, like

        mix, _ = fit(np.full((len(there), k), 1 / k), given, times, group, first, total)
        order = np.argsort(-mix, axis=1, kind="stable")
        ranked = np.take_along_axis(mix, order, 1)

        best = np.zeros_like(mix)
        np.put_along_axis(best, order[:, :1], 1.0, 1)
        if k > 1:
            gain = np.add.reduceat(times * np.log((given * best[group]).sum(1)), first)
            for size in range(2, k + 1):
                rows = np.flatnonzero(ranked[:, size - 1] >= LEAST_SHARE)
                if not len(rows):
                    break
                inside = np.isin(group, rows)
                own = np.searchsorted(rows, group[inside])
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                trial = np.zeros((len(rows), k))
                top = order[rows, :size]
                np.put_along_axis(trial, top, np.take_along_axis(mix[rows], top, 1), 1)
                trial /= trial.sum(1, keepdims=True)
                trial, like = fit(trial, given[inside], times[inside], own, start, total[rows])
                like -= PENALTY * (size - 1) * np.log(total[rows] + 1)
                better = like > gain[rows]
                gain[rows[better]] = like[better]
                best[rows[better]] = trial[better]
        shares[there] = best
        like = np.add.reduceat(times * np.log((given * best[group]).sum(1)), first)
        fits[there] = like / total + np.log(CELLS)
        return shares, fits


def with_languages(df: DataFrame, model: LanguageModel, prefix: str = "") -> DataFrame:
    """``df`` with lang_pred, score, languages ("en:0.900,fr:0.100", largest first) and fit (how
    much likelier than uniform noise a trigram is, in logs); ``prefix`` goes before these names,
    and columns that have them already are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [prefix + x for x in ("lang_pred", "score", "languages", "fit")]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kept = df.drop(*names)
    helper = free_prefix(kept) + "lettered"
    rows = kept.withColumn(helper, lettered)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chain.from_iterable(pieces(b, "text", STEP_CHARS) for b in batches):
            texts = batch.column("text").to_pylist()
            found, scores, mixes = [], [], []
            shares, fits = model.mixtures(texts)
            for sure, row in zip(batch.column(helper).to_pylist(), shares, strict=True):
                top = [i for i in np.argsort(-row, kind="stable") if row[i] > 0] if sure else []
                found.append(model.languages[top[0]] if top else UNKNOWN)
                scores.append(min(1.0, float(row[top[0]])) if top else 0.0)
                mixes.append(",".join(f"{model.languages[i]}:{row[i]:.3f}" for i in top))
            new = [pa.array(found, pa.string()), pa.array(scores, pa.float64()),
                   pa.array(mixes, pa.string()), pa.array(fits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new],
                                             names=[*batch.schema.names, *names])

    kinds = [T.StringType(), T.DoubleType(), T.StringType(), T.DoubleType()]
    schema = T.StructType([*rows.schema, *map(T.StructField, names, kinds)])
    return in_small_batches(rows).mapInArrow(predict, schema).drop(helper)


def identified_languages(documents: DataFrame) -> DataFrame:
    """Learns from the labelled four fifths and predicts every document."""
    model = LanguageModel.learn(documents)
    rows = documents.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return with_languages(rows, model).drop("text")


def in_a_language(documents: DataFrame) -> DataFrame:
    """The documents that a mixture of learned languages explains better than noise does."""
    prefix = free_prefix(documents)
    found = with_languages(documents, LanguageModel.learn(documents), prefix)
    accepted = (F.col(prefix + "lang_pred") != UNKNOWN) & (F.col(prefix + "fit") > 0)
    return found.where(accepted).select(*documents.columns)
