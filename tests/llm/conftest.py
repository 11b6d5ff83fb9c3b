import pytest


@pytest.fixture(scope="session")
def documents_of(spark):
    """A documents table from (doc_id, text[, lang[, source]]) rows, over several partitions."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(full, schema).repartition(3)

    return make


#: Texts that every operator takes: nothing, blanks, no letters, other scripts, marks, long ones.
ODD = [None, "", " \t\n", "¡¿ 12 !!", "日本語 テスト 😀", "▁a ▁▁b", "\x00\x01", "word", "The End of it",
       "x" * 30_000, "a b " * 10_000, "1 " * 3_000, "é́ ß 　y"]


@pytest.fixture(scope="session")
def odd_documents(documents_of):
    """Odd texts, twice, some without id, language or source."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(ODD)]
    return documents_of(rows + rows + [(None, "no id", None, None)])
