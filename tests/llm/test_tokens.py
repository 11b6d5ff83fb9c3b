"""Both tokenisers against their libraries."""

import random
import tracemalloc

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyscope.llm import sentencepiece_codec as codec
from tallyscope.llm import token_counts
from tallyscope.llm.queries import BYTE_BPE, PIECES


def some_texts():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz  eeetttaaa ▁.,ß漢\n'1½"
    return [
        "", " ", "  a  b ", "a" * 300, "<|endoftext|>x<|endoftext|>", "x² ١٢ ½ don't we'LL\t\n\n  \x1c y",
        "日本語 😀😀 👩‍👩‍👧", "▁▁a▁b", "<0x41><s></s><unk>", "\x00\x01", "nbsp 　x", "ab" * 3000,
        " " * 500 + "z", *("".join(rng.choices(letters, k=60)) for _ in range(500)),
    ]


def test_pieces_equal_the_library(spark):
    texts = some_texts()
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in codec.encoded_documents(df, PIECES).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, ids in enumerate(library.encode(texts)):
        assert rows[i].ids == ids, texts[i][:60]
        assert rows[i].round_trip
    assert rows[-1].ids is None and rows[-1].n_tokens == 0


def test_memory_of_a_word_grows_with_its_length():
    """A long run without a space keeps a bounded state for each character."""
    vocabulary = codec.Vocabulary.load(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("x" * 4000, "日本語テスト\n漢字" * 400, "ⴰⵣⵓⵍ" * 1000):
        (word,) = codec.marked_words(text)
        codec.segment({word}, vocabulary)  # the vocabulary remembers pairs of pieces
        tracemalloc.start()
        found = codec.segment({word, word + "x", word[:-1]}, vocabulary)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert list(found[word]) == library.encode(text)
        assert list(found[word + "x"]) == library.encode(text + "x")
        assert peak < 1000 * len(word)


def test_separate_pieces_are_what_merging_gives():
    vocabulary, rng = codec.Vocabulary.load(PIECES), random.Random(3)
    pieces = list(vocabulary.alone)
    for _ in range(3000):
        pair = rng.choice(pieces), rng.choice(pieces)
        ids = vocabulary.ids[pair[0]], vocabulary.ids[pair[1]]
        assert vocabulary.separate(ids) == (vocabulary.merge("".join(pair)) == [*pair])


def test_unigram_paths_have_the_best_sum():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.1, "bc": -3.9, "▁a": -3.0, "abc": -6.0}
    ids = {p: i for i, p in enumerate(scores)}
    vocabulary = codec.Vocabulary(scores, ids, None, 99, "unigram")

    def best(word):
        if not word:
            return 0.0, ()
        options = [(scores[word[:n]] + best(word[n:])[0], (ids[word[:n]], *best(word[n:])[1]))
                   for n in range(1, len(word) + 1) if word[:n] in scores]
        return max(options, key=lambda o: o[0])

    words = {"▁abc", "▁ab", "▁abcabc", "▁cab", "abab", "▁"}
    found = codec.segment(words, vocabulary)
    for word in words:
        assert sum(scores[vocabulary.text_of[i]] for i in found[word]) == pytest.approx(best(word)[0])
    assert codec.segment({"▁axb"}, vocabulary)["▁axb"] == (ids["▁a"], 99, ids["b"])


def test_token_counts_equal_the_library(spark):
    texts = some_texts()
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in token_counts.token_report(df, BYTE_BPE, limit=100).collect()}
    library = Tokenizer.from_file(BYTE_BPE)
    for i, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert rows[i].n_tokens == len(found.ids), texts[i][:60]
        assert rows[i].n_bytes == len(texts[i].encode())
        assert rows[i].over_limit == (len(found.ids) > 100)
    assert (rows[-1].n_bytes, rows[-1].n_tokens, rows[-1].over_limit) == (0, 0, False)


def test_long_and_short_merges_agree():
    _, ranks, _ = token_counts.load_vocabulary(BYTE_BPE)
    rng = random.Random(2)
    for _ in range(50):
        word = "".join(rng.choices("aehinrstlou", k=90))
        assert token_counts.merged_length(list(word), ranks) == token_counts._merged_length_heap(
            list(word), ranks)


def test_odd_rows_and_clashing_columns(odd_documents, spark):
    df = odd_documents.withColumnRenamed("n_chars", "n_tokens").withColumnRenamed("lang", "ids")
    assert codec.encoded_documents(df, PIECES).where("not round_trip").count() == 0
    assert token_counts.with_token_counts(df, BYTE_BPE).count() == df.count()
    empty = df.limit(0)
    assert codec.encoded_documents(empty, PIECES).count() == 0
    assert token_counts.token_report(empty, BYTE_BPE).count() == 0
