"""Merkle manifest of a dataset as persistent trees: a tampered leaf is a version that copies its path.

Leaves of a source stand in order of their ids; every run of three nodes becomes their hash, until
one node is left, the source's subroot; the subroots, in order of the sources, become the root the
same way. A tree is cut into aligned blocks of 3^7 leaves. A block is one task's work and is held as
a persistent tree: the version of a tampered leaf shares every node of the block and copies only the
ancestors of its leaf. The tops of the blocks are the leaves of the next, far smaller round of
blocks, and so on; a version goes on there by copying the one path above its block.

Defined results: a null value hashes as ``-``; rows without an id come first in their source and
are never tampered; rows of one id stand in the order of their leaves' digests, equal rows in any
order (their digests are equal too); rows without a source form a source of their own, the first;
an empty table has no rows. Texts are hashed whole; extra columns of any name are neither read nor
returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyscope.llm.common import in_small_batches
from tallyscope.session import staged

#: Nodes that one parent takes, and the levels of a block.
FAN = 3
BLOCK_LEVELS = 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SOURCE = ["_none", "_source"]
_PATH = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class PersistentBlock:
    """A block's nodes by level; versions share them and never change them."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i:i + FAN])) for i in range(0, len(below), FAN)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, index: int) -> list[tuple[str, str]]:
        """The siblings before and after the node of each level, joined, from the leaf upwards."""
        out = []
        for nodes in self.levels[:-1]:
            first, own = index - index % FAN, index % FAN
            run = nodes[first:first + FAN]
            out.append(("".join(run[:own]), "".join(run[own + 1:])))
            index //= FAN
        return out

    def version(self, index: int, leaf: str) -> list[str]:
        """The nodes that differ if ``leaf`` stood at ``index``: one a level, the new top last."""
        return continued(leaf, self.path(index))


def continued(node: str, path: list[tuple[str, str]]) -> list[str]:
    """``node`` and its copied ancestors along ``path``."""
    copied = [node]
    for before, after in path:
        copied.append(digest(before + copied[-1] + after))
    return copied


def levels_of(nodes: int, most: int) -> int:
    """Levels above ``nodes`` nodes of a tree within one block: until one is left, or ``most``."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal ``key``: one block each, so so it has a block's rows at most."""
    held, of = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (now := tuple(row[c] for c in key)) != of and held:
                yield held
                held = []
            of = now
            held.append(row)
    if held:
        yield held


def _by_block(nodes: DataFrame, key: list[str], levels: int) -> DataFrame:
    block = F.expr(f"_pos div {FAN ** levels}")
    return in_small_batches(nodes.withColumn("_block", block).repartition(*key, "_block")
                            .sortWithinPartitions(*key, "_block", "_pos"))


def numbered(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` with ``_pos``, the place of the row among those of its key, and ``_nodes``, how many
    there are.

    Rows are dealt by ranges of key and order, so a key of any size is spread over tasks; only the
    counts per key and range, not rows, meet by key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, "_tie"]
    ranged = staged(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *key, *order).withColumn("_part", F.spark_partition_id()),
        "merkle-nodes")
    counts = ranged.groupBy(*key, "_part").count()
    whole, upto = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("_part")
    offsets = counts.select(
        *key, "_part", F.sum("count").over(whole).alias("_nodes"),
        (F.sum("count").over(upto) - F.col("count")).alias("_start"))
    inside = Window.partitionBy(*key, "_part").orderBy(*order)
    return (ranged.withColumn("_row", F.row_number().over(inside) - 1)
            .join(offsets, [*key, "_part"])
            .withColumn("_pos", F.col("_start") + F.col("_row"))
            .drop("_part", "_tie", "_row", "_start"))


def _tops(nodes: DataFrame, key: list[str], levels: int) -> DataFrame:
    """The top of each block of ``nodes`` (key, _pos, _nodes, leaf) as the nodes of the next round."""
    names = [*key, "_block"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for run in _runs(batches, names):
            block = PersistentBlock([r["leaf"] for r in run], levels_of(run[0]["_nodes"], levels))
            above = -(-run[0]["_nodes"] // FAN ** levels)
            out.append({**{c: run[0][c] for c in key}, "_pos": run[0]["_block"],
                        "_nodes": above, "leaf": block.top})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = _by_block(nodes.select(*key, "_pos", "_nodes", "leaf"), key, levels)
    shape = nodes.select(*key, F.col("_pos").cast("long"), F.col("_nodes").cast("long"), "leaf").schema
    schema = to_arrow_schema(shape)
    return rows.mapInArrow(build, shape)


def _paths(nodes: DataFrame, key: list[str], levels: int) -> DataFrame:
    """Every node (key, _pos) with its path within its block and the block's number."""
    names = [*key, "_block"]
    path = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, names):
            block = PersistentBlock([r["leaf"] for r in run], levels_of(run[0]["_nodes"], levels))
            yield pa.RecordBatch.from_pylist(
                [{**{c: r[c] for c in (*key, "_pos", "_block")},
                  "_path": [{"before": b, "after": a} for b, a in block.path(i)]}
                 for i, r in enumerate(run)], schema=schema)

    rows = _by_block(nodes.select(*key, "_pos", "_nodes", "leaf"), key, levels)
    shape = rows.select(*key, "_pos", "_block").schema
    schema = to_arrow_schema(shape).append(pa.field("_path", path))
    return rows.mapInArrow(walk, ", ".join(
        [*(f"{f.name} {f.dataType.simpleString()}" for f in shape), f"_path {_PATH}"]))


def climb(nodes: DataFrame, key: list[str], levels: int) -> tuple[DataFrame, DataFrame]:
    """The top node of each key (key, leaf) and the path to it of every node (key, _pos, _path).

    ``nodes`` (key, _pos, _nodes, leaf) is the result of a round; each round has 3^levels times
    fewer nodes than the one before, so a handful of rounds serves any table.
    """
    rounds = [nodes]
    most = nodes.agg(F.max("_nodes")).first()[0] or 0
    while most > 1:
        rounds.append(staged(_tops(rounds[-1], key, levels), "merkle-tops"))
        most = -(-most // FAN ** levels)
    top = rounds[-1]
    paths = top.select(*key, "_pos", F.expr(f"cast(array() as {_PATH})").alias("_path"))
    for below in reversed(rounds[:-1]):
        above = paths.withColumnsRenamed({"_pos": "_block", "_path": "_above"})
        paths = _paths(below, key, levels).join(above, [*key, "_block"]).select(
            *key, "_pos", F.concat("_path", "_above").alias("_path"))
    return top.select(*key, "leaf"), paths


def field_text(column: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field_text(columns[name]) for name in FIELDS]).cast("binary"), 256)


def tampered_rows(doc_id: Column) -> Column:
    """The rows whose text the manifest's own test tampers with: an even checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(documents: DataFrame, tampered: Column | None = None,
           tampered_text: Column | None = None) -> DataFrame:
    """doc_id, the source, the leaf of every document, and the leaf of its tampered text or null.

    The defaults tamper with the rows of ``tampered_rows`` by deleting line feeds.
    """
    own = {name: F.col(name) for name in FIELDS}
    which = tampered_rows(F.col("doc_id")) if tampered is None else tampered
    changed = F.expr(r"replace(text, '\n', '')") if tampered_text is None else tampered_text
    return documents.select(
        "doc_id", F.col("source").isNull().alias("_none"),
        F.coalesce("source", F.lit("")).alias("_source"),
        leaf_digest(own).alias("leaf"),
        F.when(which, leaf_digest(own | {"text": changed})).alias("_tampered"))


def manifest(rows: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``leaves``.

    ``folded_root`` is the root of the version that the row's tampered leaf makes (its own leaf
    where there is none); ``verified`` tells whether it is the root. ``block_levels`` sets the
    blocks' size and changes no result.
    """
    # ranges are drawn from a sample, so the digests are written first and computed once
    placed = staged(numbered(staged(rows, "merkle-leaves"), _SOURCE,
                             [F.col("doc_id").asc_nulls_first(), F.col("leaf")]), "merkle-placed")
    tops = staged(_tops(placed, _SOURCE, block_levels), "merkle-tops")
    subroots, in_source = climb(tops, _SOURCE, block_levels)
    # the source without a name is the first, so its flag is ordered downwards
    crown = staged(numbered(subroots.withColumn("_all", F.lit(0)), ["_all"],
                            [F.col("_none").desc(), F.col("_source")]), "merkle-sources")
    roots, in_crown = climb(crown, ["_all"], block_levels)
    sources = (crown.join(in_crown, ["_all", "_pos"])
               .join(roots.withColumnRenamed("leaf", "root"), "_all")
               .select(*_SOURCE, F.col("leaf").alias("subroot"), "root",
                       F.col("_path").alias("_last")))
    above = in_source.join(sources, _SOURCE).select(
        *_SOURCE, F.col("_pos").alias("_block"), "subroot", "root",
        F.concat("_path", "_last").alias("_path"))
    return _versions(placed, staged(above, "merkle-above"), block_levels)


def _versions(placed: DataFrame, above: DataFrame, block_levels: int) -> DataFrame:
    """Proofs and versions of all leaves. The path above a block stands before its leaves, once,
    as a row with the place -1, so that no leaf row carries it through the shuffle."""
    names = [*_SOURCE, "_block"]
    first = above.withColumns({"_pos": F.lit(-1).cast("long")})
    rows = (placed.withColumn("_block", F.expr(f"_pos div {FAN ** block_levels}"))
            .unionByName(first, allowMissingColumns=True)
            .repartition(*names).sortWithinPartitions(*names, "_pos"))
    fields = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out = rows.select(*fields[:4], F.lit("").alias(fields[4]), F.lit("").alias(fields[5]),
                      F.lit(True).alias(fields[6])).schema
    schema = to_arrow_schema(out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *run in _runs(batches, names):
            block = PersistentBlock([r["leaf"] for r in run],
                                    levels_of(run[0]["_nodes"], block_levels))
            beyond = [(p["before"], p["after"]) for p in head["_path"]]
            for i, row in enumerate(run):
                path = block.path(i) + beyond
                row["subroot"], row["root"] = head["subroot"], head["root"]
                row["proof_sha256"] = digest("".join(b + a for b, a in path))
                version = block.version(i, row["_tampered"] or row["leaf"])
                row["folded_root"] = continued(version[-1], beyond)[-1]
                row["verified"] = row["folded_root"] == row["root"]
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in fields} for r in run], schema=schema)

    return in_small_batches(rows).mapInArrow(walk, out)


def document_manifest(documents: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and the check of every leaf, with the tampering of ``leaves``."""
    return manifest(leaves(documents))


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
             WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384::BIGINT) ELSE crc // 2 END) % 2 = 1 AS even
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), field AS (
  SELECT d.doc_id, source, coalesce(even, false) AS tampered,
         coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, replace(text, chr(10), '') AS less
  FROM documents d LEFT JOIN bits USING (doc_id)
), leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(less) || ':' || less, '-')) END AS t
  FROM field
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h, t) - 1 AS i
  FROM leaf
), tree AS (
  SELECT source, 0 AS level, i, h, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM tree WHERE n > 1 GROUP BY source, level, i // 3
), subroot AS (
  SELECT source, h, level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS level, i, h, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM crown WHERE n > 1 GROUP BY level, i // 3
), node AS (
  SELECT s.i AS s, false AS upper, t.level, t.i, t.h FROM tree t JOIN subroot s
    ON t.source IS NOT DISTINCT FROM s.source WHERE n > 1
  UNION ALL
  SELECT NULL, true, level, i, h FROM crown WHERE n > 1
), step AS (
  SELECT p.doc_id, p.i AS place, s.i AS s, false AS upper, l.level, p.i // (3 ** l.level)::BIGINT AS own,
         l.level AS k
  FROM placed p JOIN subroot s ON p.source IS NOT DISTINCT FROM s.source
  JOIN (SELECT DISTINCT s, level FROM node WHERE NOT upper) l ON l.s = s.i
  UNION ALL
  SELECT p.doc_id, p.i, s.i, true, l.level, s.i // (3 ** l.level)::BIGINT, s.level + l.level
  FROM placed p JOIN subroot s ON p.source IS NOT DISTINCT FROM s.source
  CROSS JOIN (SELECT DISTINCT level FROM node WHERE upper) l
), sibling AS (
  SELECT t.s, t.place, t.k, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < t.own), '') AS before,
         coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > t.own), '') AS after
  FROM step t JOIN node n ON n.upper = t.upper AND (n.upper OR n.s = t.s) AND n.level = t.level
    AND n.i // 3 = t.own // 3
  GROUP BY t.s, t.place, t.k
), proof AS (
  SELECT s, place, list(before ORDER BY k) AS b, list(after ORDER BY k) AS a,
         sha256(string_agg(before || after, '' ORDER BY k)) AS proof
  FROM sibling GROUP BY s, place
), start AS (
  SELECT p.doc_id, p.h AS leaf, s.h AS subroot, s.i AS s, p.i AS place, coalesce(p.t, p.h) AS x
  FROM placed p JOIN subroot s ON p.source IS NOT DISTINCT FROM s.source
), fold AS (
  SELECT s, place, x, 1 AS k, coalesce(len(b), 0) AS steps, b, a
  FROM start LEFT JOIN proof USING (s, place)
  UNION ALL
  SELECT s, place, sha256(b[k] || x || a[k]), k + 1, steps, b, a FROM fold WHERE k <= steps
)
SELECT doc_id, leaf, subroot, c.h AS root, coalesce(proof, sha256('')) AS proof_sha256,
       f.x AS folded_root, f.x = c.h AS verified
FROM start JOIN fold f USING (s, place) LEFT JOIN proof USING (s, place)
CROSS JOIN (SELECT h FROM crown WHERE n = 1) c
WHERE f.k = f.steps + 1
"""
