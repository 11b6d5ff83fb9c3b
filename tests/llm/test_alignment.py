"""Alignment of two tokenizers against their libraries, offset by offset."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyscope.llm import alignment
from tallyscope.llm.queries import BYTE_BPE, PIECES

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain_alignment(text, a, b):
    """Groups of (A ids, B ids) of a text, from token end offsets counted byte by byte."""
    if not text:
        return []
    spelled = {ord(c): x for x, c in enumerate(alignment.byte_chars())}
    spaced = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(spelled[ord(c)] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if b"".join(bytes_a) != spaced or b"".join(bytes_b) != spaced:
        return []
    groups, run_a, run_b, at_a, at_b, j = [], [], [], 0, 0, 0
    for i, token in zip(ids_a, bytes_a):
        run_a.append(i)
        at_a += len(token)
        while j < len(ids_b) and at_b + len(bytes_b[j]) <= at_a:
            run_b.append(ids_b[j])
            at_b += len(bytes_b[j])
            j += 1
        if at_a == at_b:
            groups.append((run_a, run_b))
            run_a, run_b = [], []
    return groups


def expected(rows, a, b):
    found = [(key, plain_alignment(text, a, b)) for key, text in rows]
    counts = Counter((x[-1], y[-1]) for _, groups in found for x, y in groups)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for key, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        told = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((key, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups),
                    len(groups), len(links), sum(counts[p] == most[p[1]] for p in links),
                    sum(counts[p] for p in links),
                    hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return sorted(out, key=str)


def check(df, libraries, **options):
    got = alignment.aligned_documents(df, BYTE_BPE, PIECES, **options)
    assert got.columns == COLUMNS
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == expected([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()],
                            *libraries)
    return rows


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_every_text_and_every_split_of_the_counts(spark, documents_of, libraries, frequent):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz  eeetttaaa ▁.,ß漢\n'1½"
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(90)))) for i in range(120)]
    rows += [(200, "<|endoftext|>x <s></s><unk>"), (201, "  two  spaces "), (202, "<0x41>")]
    assert len(check(documents_of(rows), libraries, frequent=frequent)) == 123


def test_odd_and_repeated_rows(odd_documents, libraries):
    rows = check(odd_documents, libraries)
    assert [r for r in rows if r[1] == 0 and r[7] == ""]
    assert len([r for r in rows if r[0] is None]) == 1


def test_empty_table_and_clashing_columns(documents_of, libraries):
    df = documents_of([(1, "one text"), (1, "one text"), (2, None)])
    assert alignment.aligned_documents(df.limit(0), BYTE_BPE, PIECES).collect() == []
    for name in ("key", "row", "pairs", "times", "n_a", "best_links", "pair", "x", "groups"):
        df = df.withColumn(name, df.text)
    check(df, libraries)


def test_groups_and_pair_table(documents_of):
    df = documents_of([(1, "the cat"), (2, "the dog")])
    aligned = alignment.alignments(df, BYTE_BPE, PIECES, keep_groups=True)
    (row,) = aligned.where("key = 1").collect()
    assert row.groups_sha256 == hashlib.sha256(row.groups.encode()).hexdigest()
    assert row.groups.count(";") + 1 == row.n_groups == row.n_links == sum(row.times)
    counts = alignment.pair_counts(aligned).collect()
    assert max(r.n for r in counts) == 2 and sum(r.n for r in counts) == row.n_links * 2
    assert all(r.pair == r.a_id * alignment.B_IDS + r.b_id for r in counts)
