"""Measures against plain Python, and the threshold table."""

import re

from pyspark.sql import functions as F

from tallyscope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words, seen, again = WORD.findall(text), {}, set()
    for i in range(len(words) - 2):
        window = tuple(words[i : i + 3])
        if window in seen:
            again |= {seen[window], i}
        seen.setdefault(window, i)
    covered = {i + d for i in again for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeated = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n)


def test_measures_equal_python(documents_of, odd_documents):
    rows = [(100, "a b c d a b c\nx\nx\n \nx"), (101, "a a a a a"), (102, "the of " * 60),
            (103, "one two three " + "the cat and dog " * 2 + " ".join(f"w{i}" for i in range(60))),
            (104, "#x* $ | <b>"), (105, "a b c x a b c y a b c")]
    df = documents_of(rows).unionByName(odd_documents)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in quality.quality_report(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id]), texts[r.doc_id] and texts[r.doc_id][:50]
        assert not (r.base_failed and r.kept)


def test_rules_catch_junk_and_keep_prose(documents_of):
    # pseudo-random words, so that windows do not repeat
    words = [f"{'abcdefgh'[i * i % 8]}ord{i % 37}x{i * 7 % 91}" for i in range(120)]
    prose = [w if i % 3 else "the" for i, w in enumerate(words)]
    rows = [(1, " ".join(prose)), (2, " ".join(w + "***" for w in prose)), (3, " ".join(words)),
            (4, " ".join(w.upper() + "!!" for w in prose)), (5, " ".join(prose[:30]))]
    found = {r.doc_id: r for r in quality.quality_report(documents_of(rows)).collect()}
    assert [found[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert "symbols" in found[2].failed_rules and "few_stop_words" in found[3].failed_rules


def test_plan_has_no_python(documents_of):
    report = quality.quality_report(documents_of([(1, "a")])).withColumn("x", F.lit(1))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.quality_report(documents_of([(1, "a")]).limit(0)).count() == 0
