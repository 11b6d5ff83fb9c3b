"""The Merkle manifest against a plain recursive version."""

import hashlib
import zlib

import pytest

from tallyscope.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [*(row[c] for c in FIELDS[:-1]), text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The top of a list of digests and each one's siblings, level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            run = nodes[at - at % 3:at - at % 3 + 3]
            paths[k].append((run[:at % 3], run[at % 3 + 1:]))
        nodes = [h("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        places = [at // 3 for at in places]
    return nodes[0], paths


def expected(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], {}
    for source in sources:
        group = [(r, leaf_of(r, r["text"])) for r in by_source[source]]
        group.sort(key=lambda g: (g[0]["doc_id"] is not None, g[0]["doc_id"] or 0, g[1]))
        top, paths = climb([leaf for _, leaf in group])
        tops.append(top)
        inner[source] = group, paths
    root, crown = climb(tops)
    out = []
    for source, subroot, last in zip(sources, tops, crown):
        for (row, leaf), path in zip(*inner[source]):
            node = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = row["text"]
                node = leaf_of(row, text if text is None else text.replace("\n", ""))
            proof = ""
            for before, after in path + last:
                proof += "".join(before + after)
                node = h("".join(before) + node + "".join(after))
            out.append((row["doc_id"], leaf, subroot, root, h(proof), node, node == root))
    return sorted(out, key=str)


def compare(df, **options):
    got = merkle.manifest(merkle.leaves(df), **options)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                           "verified"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == expected([r.asDict() for r in df.select(*FIELDS).collect()])
    return rows


@pytest.mark.parametrize("block_levels", [1, 2, 7])
def test_blocks_of_any_size_give_the_plain_tree(documents_of, block_levels):
    rows = [(i, f"line {i}\nnext" if i % 3 else f"one line {i}", "en", f"s{min(i % 40, 3)}")
            for i in range(300)]
    got = compare(documents_of(rows), block_levels=block_levels)
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(odd_documents):
    compare(odd_documents, block_levels=1)


def test_ties_repeats_and_a_single_leaf(documents_of):
    same = [(5, "a\nb", "en", "s")] * 7 + [(5, "c\nd", "en", "s")] * 2 + [(None, "x\n", None, "s")] * 4
    compare(documents_of([*same, (9, None, None, None), (8, "é\n", "fr", "ß")]), block_levels=1)
    (row,) = compare(documents_of([(4, "alone\n", None, None)]))
    assert row[1] == row[2] == row[3] and row[4] == h("")


def test_one_hot_source_and_many_single_ones(documents_of):
    rows = [(i, f"t{i}\n", "en", "hot" if i % 3 else f"site{i}") for i in range(240)]
    compare(documents_of(rows), block_levels=2)


def test_empty_table_and_clashing_columns(documents_of):
    assert merkle.document_manifest(documents_of([(1, "a")]).limit(0)).collect() == []
    df = documents_of([(i, f"a\n{i}", "en", "s") for i in range(20)])
    for name in ("leaf", "root", "_pos", "_none", "_source", "_tampered", "_part", "_block", "LEVELS"):
        df = df.withColumn(name, df.doc_id)
    compare(df, block_levels=1)


def test_versions_share_untouched_nodes():
    block = merkle.PersistentBlock([h(str(i)) for i in range(20)], 3)
    before = [list(level) for level in block.levels]
    copied = block.version(13, h("changed"))
    assert len(copied) == 4 and block.levels == before
    changed = merkle.PersistentBlock([h("changed") if i == 13 else h(str(i)) for i in range(20)], 3)
    assert [changed.levels[k][13 // 3 ** k] for k in range(4)] == copied
    assert sum(a != b for x, y in zip(block.levels, changed.levels) for a, b in zip(x, y)) == 4
