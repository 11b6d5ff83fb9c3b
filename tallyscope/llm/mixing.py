"""Mixing sources to target weights: each source's documents in a hash-random order, cut at an
exact word budget, in repeated epochs where the budget is larger than the source.

The order of a source is its documents' hash keys. Equal-width ranges of keys hold equally many
documents whatever the source's size, so a running sum needs two steps only: sums per (source,
range), added up over the ranges of a source, and a window within one range. No task sees more
than one range of a source, and a hot source has as many ranges as any other. All steps are
deterministic functions of the rows, so a lost task gives the same rows again.

Null texts have size 0; a null source is a source of its own, last in order; null ids are ordered
by an empty key. Equal rows are told apart by their place only, so their multiset is the same in
every run. Documents of size 0 take nothing. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import WORD, free_prefix
from tallyscope.session import cut

#: Hex digits of a key that name its range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than so many times.
MOST_EPOCHS = 3

_SOURCE = ["_none", "_source"]


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (one row per source: _none, _source, source_size) with its ``target``.

    Targets share the total by weight; none exceeds ``most_epochs`` times its source, and the
    excess is shared again among the rest. With the sources in order of cap per weight, the level
    the rest would get after fixing the first i at their caps rises while the next cap is below
    it and falls afterwards: its maximum is the level that all uncapped sources end at. The two
    windows see one row per source.
    """
    by_name = Window.orderBy("_none", "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("_weight", weight.cast("long")).withColumn(
        "_cap", F.col("source_size") * most_epochs)
    everything = Window.partitionBy()
    earlier = (Window.orderBy(F.col("_cap") / F.col("_weight"), "_none", "_source")
               .rowsBetween(Window.unboundedPreceding, -1))

    def before(column: str) -> Column:
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    left = F.sum("source_size").over(everything) - before("_cap")
    level = left / (F.sum("_weight").over(everything) - before("_weight"))
    return (
        weighed.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(F.col("_cap").cast("double"),
                                      F.col("_weight") * F.col("_level")))
        .drop("_weight", "_cap", "_level")
    )


def mix(documents: DataFrame, key_columns: list[str], weights: tuple[int, ...] = WEIGHTS,
        most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``documents`` (with doc_id, source, size) plus source_size, target and taken.

    ``key_columns`` are kept and break ties between equal ids; other columns go. ``taken`` counts
    the words that the mix takes of a document: all of them once per whole epoch, and in the last
    epoch what fits before the cut, which may lie inside a document.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = cut(documents.select(
        *key_columns, "size", F.col("source").isNull().alias("_none"),
        F.coalesce("source", F.lit("")).alias("_source"), key.alias("_key"),
    )).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))

    ranges = placed.groupBy(*_SOURCE, "_range").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy(*_SOURCE).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*_SOURCE, "_range",
                           F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_start"))
    sizes = ranges.groupBy(*_SOURCE).agg(F.sum("_words").alias("source_size"))
    offsets = starts.join(source_targets(sizes, weights, most_epochs), _SOURCE)

    inside = (Window.partitionBy(*_SOURCE, "_range").orderBy("_key", *key_columns, "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    running = placed.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("_start") - F.col("_before")
    partly = F.least(F.col("size"), F.greatest(F.lit(0), rest))
    return running.join(offsets, [*_SOURCE, "_range"]).select(
        *key_columns, "size", "source_size", "target",
        (epochs * F.col("size") + partly).cast("long").alias("taken"),
    )


def mixed_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(documents.select("doc_id", "source", n_words().alias("size")), ["doc_id"])


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix itself: a row per epoch in which a document is taken, the last one cut to the
    words that fit the budget; n_chars, where there is one, follows the text.

    Columns of any name pass through. Rows of one id, source and size may swap what is taken of
    them, which leaves every source with its budget.
    """
    p = free_prefix(documents)
    own = [p + name for name in ("id", "none", "source", "size")]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    source = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]

    def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
        return rows.withColumn(
            p + "place", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))

    sized = mix(documents.select("doc_id", "source", n_words().alias("size")), ["doc_id", "source"])
    values = [key, *source, F.col("size")]
    taken = placed(sized.select(*(v.alias(n) for v, n in zip(values, own)),
                                F.col("taken").alias(p + "taken")), p + "taken")
    values[-1] = n_words()
    rows = placed(documents.withColumns(dict(zip(own, values))), F.xxhash64("text"))
    size, some = F.col(p + "size"), F.col(p + "some")
    epochs = rows.join(taken.where(F.col(p + "taken") > 0), [*own, p + "place"]).withColumn(
        p + "epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col(p + "taken") / size) - 1)))
    left = F.col(p + "taken") - F.col(p + "epoch") * size
    # possessive, so that the longest texts need no stack
    start = F.expr(r"regexp_extract(text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', "
                   f"cast({p}some as string), '}}+'), 0)")
    out = epochs.withColumn(p + "some", F.least(size, left)).withColumn(
        "text", F.when(some == size, F.col("text")).otherwise(start))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0))::DOUBLE AS level
  FROM sources
  WINDOW earlier AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, w * max(level) OVER ()) AS target
  FROM levels
), running AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier
  FROM sized JOIN targets USING (source)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size,
         greatest(0, budget - (budget // source_size) * source_size - earlier)) END AS BIGINT) AS taken
FROM running
"""
