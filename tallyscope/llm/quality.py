"""Quality rules: a threshold table compiled into one projection, without user functions.

Every measure is an expression over one row, so documents are judged where they lie: no shuffle,
no Python. Repeated 3-word windows are found by sorting a document's window hashes next to each
other, n log n in its length. Intermediate arrays are bound to lambda variables, so that each is
computed once however often it is read.

Null and empty texts have no words and fail the base rule. Equal rows get equal verdicts. Extra
columns are left out of the result; the base measures of any length of text cover all of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import WORD

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = [
    # English
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on",
    "or", "that", "the", "this", "to", "was", "were", "with", "you",
    # French
    "au", "aux", "de", "des", "du", "en", "et", "est", "la", "le", "les", "ou", "par", "pas",
    "pour", "que", "qui", "un", "une",
    # German
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich",
    "und", "von", "zu",
    # Spanish
    "como", "con", "del", "el", "los", "las", "no", "para", "por", "se", "su", "y",
]


@dataclass(frozen=True)
class Rule:
    """A measure must lie between two limits; None is no limit."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table.
RULES = [
    Rule("too_many_words", "n_words", most=1_000_000),
    Rule("words_too_short", "mean_word_chars", least=2.0),
    Rule("words_too_long", "mean_word_chars", most=20.0),
    Rule("symbols", "symbol_ratio", most=0.05),
    Rule("shouting", "shout_ratio", most=0.3),
    Rule("few_stop_words", "stop_word_ratio", least=0.02),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; a lambda-bound array of words."""
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"),
            i.alias("p")),
    )).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))

    def starts(s: Column) -> Column:
        def at(j: Column) -> Column:
            return F.get(s, j).getField("h")

        hit = F.transform(s, lambda x, j: F.when(
            x["h"].eqNullSafe(at(j - 1)) | x["h"].eqNullSafe(at(j + 1)), x["p"]))
        return F.sort_array(F.array_compact(hit))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x,
                                                                         F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(F.sort_array(windows), lambda s: let(starts(s), covered))


def measures(text: str = "text") -> Column:
    """A struct of all counts and ratios of one text."""
    body = F.coalesce(F.col(text), F.lit(""))

    def without(chars: str) -> Column:
        return F.length(F.translate(body, chars, ""))

    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)

    def counted(words: Column) -> Column:
        stops = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
        shouts = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}{2}[^\p{Ll}]*$")))
        return F.struct(F.size(words).alias("n"), _repeated_words(words).alias("repeated"),
                        stops.alias("stops"), shouts.alias("shouts"))

    return F.struct(
        let(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), counted).alias("w"),
        without(SPACE).alias("word_chars"),
        (F.length(body) - without(SYMBOLS)).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"),
                                      (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
            ).alias("lines"),
    )


def failed_rules(rules: list[Rule] = RULES) -> Column:
    """The names of the rules that the row's measures break, in table order."""
    broken = []
    for rule in rules:
        value = F.col(rule.measure)
        out = F.lit(False)
        if rule.least is not None:
            out = out | (value < rule.least)
        if rule.most is not None:
            out = out | (value > rule.most)
        broken.append(F.when(out, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def quality_report(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and failed_rules (comma-joined)."""

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    counted = documents.select("doc_id", measures().alias("m")).select(
        "doc_id", F.col("m.w.n").cast("long").alias("n_words"),
        F.col("m.word_chars").cast("long").alias("word_chars"),
        F.col("m.n_symbols").cast("long").alias("n_symbols"),
        F.col("m.lines.dup").cast("long").alias("n_dup_lines"),
        F.col("m.w.repeated").cast("long").alias("n_repeat_words"),
        F.col("m.lines.n").alias("_lines"), F.col("m.w.stops").alias("_stops"),
        F.col("m.w.shouts").alias("_shouts"),
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counted.select(
        "*", base.alias("base_failed"), share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("_stops", "n_words").alias("stop_word_ratio"),
        share("_shouts", "n_words").alias("shout_ratio"),
        share("n_dup_lines", "_lines").alias("dup_line_ratio"),
    ).withColumn("_failed", failed_rules(rules))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.size("_failed") == 0)).alias("kept"),
        F.array_join("_failed", ",").alias("failed_rules"),
    )


def _oracle(rules: list[Rule] = RULES) -> str:
    """The same table as SQL over lists and window rows."""
    names = []
    for r in rules:
        limits = [f"{r.measure} < {r.least}"] if r.least is not None else []
        limits += [f"{r.measure} > {r.most}"] if r.most is not None else []
        names.append(f"CASE WHEN {' OR '.join(limits)} THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts WHERE len(w) >= 3)
), again AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1
), covered AS (
  SELECT r, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r
), counted AS (
  SELECT doc_id, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops,
         len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}{{2}}[^\p{{Ll}}]*$'))) AS shouts
  FROM parts LEFT JOIN covered USING (r)
), measured AS (
  SELECT *, coalesce(n_words < 50 OR 100 * n_repeat_words > 50 * n_words, false) AS base_failed,
         coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
         coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
         coalesce(stops / nullif(n_words, 0), 0) AS stop_word_ratio,
         coalesce(shouts / nullif(n_words, 0), 0) AS shout_ratio,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio
  FROM counted
), judged AS (SELECT *, concat_ws(',', {", ".join(names)}) AS failed_rules FROM measured)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM judged
"""


ORACLE = _oracle()
