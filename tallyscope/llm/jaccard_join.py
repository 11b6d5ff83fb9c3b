"""Exact Jaccard join of documents on word shingles, with skipping by set relations.

Equal sets are one set from the start. The shingles of a set are put into one global order: first
those of rare words, last those that are frequent themselves, then by hash. The counts of all
documents' words and shingles lie in tables of a fixed number of cells; since a text has far fewer
different words than shingles, rare shingles are still told apart in a large corpus. Two sets that
link share a shingle among the first few of both (prefix filter), so only those are indexed. An
index list is kept by set size and holds each set's position in it.

Set relations spare most of the work:
* in each list, a set is first paired only with the list's leaders, its ``LEADERS`` sets of lowest
  hash, then with the hubs, the best-linked sets of other groups; those it shares enough lists with
  are checked, which links the members of a group of near copies in a number of checks that grows
  with the members, not with their pairs;
* what a set's answers are inside its group follows from its leaders', so that later only sets
  of different groups are compared; lists that hold one group are skipped whole;
* in what is left, a list lies in blocks by size and position; pairs of blocks are skipped whole
  where their sizes, their least positions or what is left behind them rule out the needed
  overlap, and single pairs where their own do or where they share too few lists for it. Every
  pair that remains is checked: first on short codes, the upper bits of the hashes, which can only
  make an overlap look larger, then on the full sets.

So no link between sets of different groups is lost, while the pairs inside a group of thousands
are never listed. Long lists are dealt into pairs of chunks, so that no task holds a whole one.
Copies are dropped per task before the index is sent.

Links are counted exactly. Inside a group they follow from each set's difference to the group's
leader, its best-linked set: the sizes of two differences bound the overlap of their sets from both
sides, and only pairs that these leave open are decided by what the differences have in common.

A document's set: distinct shingles of ``words`` words, lower-cased A-Z; with fewer words the
whole sequence as one shingle; null texts and texts without words have the empty set, which links
with nothing. Rows without an id link with nothing and have no component. Repeated rows have
equal results. Extra columns are ignored. Shingles are told apart by all 64 bits of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import in_small_batches, pieces
from tallyscope.llm.components import components, groups_within
from tallyscope.session import cut, scratch_path, staged

#: Cells of the table of shingle counts, and of the table of word counts.
CELL_BITS = 16
#: Shingles are frequent themselves if their cell holds so many times the median of all cells.
FREQUENT = 1.3
#: Ranks of shingles by their words are below this, those of frequent ones from it on; both fit 12 bits.
WORD_RANKS = 2048
#: Words that are hashed at once, and the bytes beyond which a word is hashed on its own.
HASHED = 1 << 16
LONG_WORD = 256
#: Sets of a list, and of those a set meets, that it is checked against before all others.
LEADERS = 12
HUB_ROUNDS = 1
#: Sets of a list that one task compares with each other at once.
BLOCK = 4096
#: Sets of a block of a list; pairs of blocks are skipped by their sizes and positions.
SKIP_BLOCK = 256
#: Sets of a group whose differences to its leader one task compares with each other at once.
GROUP_BLOCK = 2048
#: Tasks that the links of one set are dealt to.
SALTS = 16
#: Rows of link counts that a task sends at once.
SENT = 10_000
#: Words of 64 bits in the filter that spares computing sets nobody asks for.
FILTER_BITS = 18
STEP_BYTES = 2_000_000


_BYTE = np.arange(256)
_BLANK = (_BYTE == 0x20) | (_BYTE >= 0x09) & (_BYTE <= 0x0D)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE).astype(np.uint8)
#: Masks for the last bytes of a word, by their number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts, and where the words of each text begin."""
    texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = texts.buffers()
    edges = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    low = np.zeros(len(raw) + 8, np.uint8)
    low[: len(raw)] = _LOWER[raw]
    blank = _BLANK[raw]
    outside = np.zeros(len(raw) + 1, bool)  # whether a word can't go on from the byte before
    outside[edges] = True
    start = np.flatnonzero(~blank & (outside[:-1] | np.r_[True, blank[:-1]]))
    size = np.flatnonzero(~blank & (outside[1:] | np.r_[blank[1:], True])) + 1 - start
    eight = np.ndarray(len(raw) + 1, "<u8", low, strides=(1,))  # the eight bytes from each byte on
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(out), HASHED):
        h, begin, left = (x[at : at + HASHED] for x in (out, start, size))
        rows = np.flatnonzero(left <= LONG_WORD)
        for step in range(0, LONG_WORD, 8):
            rows = rows[left[rows] > step]
            if not len(rows):
                break
            block = eight[begin[rows] + step] & _BYTES[np.minimum(left[rows] - step, 8)]
            mixed = (h[rows] ^ block) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0x94D049BB133111EB)
            h[rows] = mixed ^ mixed >> np.uint64(29)
        for i in np.flatnonzero(left > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(low[begin[i] : begin[i] + left[i]])
    return out, np.searchsorted(start, edges)


def _windows(each: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words."""
    n = max(len(each) - width + 1, 0)
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ each[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def _runs(hashes: np.ndarray, first: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, slice]]:
    """Of each text, the hashes of its shingles as they come, and where its words lie."""
    mixed = _windows(hashes, words)
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - begin >= words:
            yield mixed[begin : end - words + 1], slice(begin, end)
        else:
            yield _windows(hashes[begin:end], end - begin) if end > begin else mixed[:0], slice(begin, end)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different ones of sorted values."""
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    return [_distinct(np.sort(run)) for run, _ in _runs(*word_hashes(texts), words)]


def set_key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def needed(a: Column, b: Column, percent: int) -> Column:
    """Index lists that two sets of these sizes share at least if they link.

    Of the two indexed parts, take the one that ends first in the global order: what of it isn't
    in the other part isn't in the other set. So the overlap is at most the shared lists and the
    set's shingles behind its part, and must reach its least value for the sizes.
    """
    overlap = F.ceil(percent * (a + b) / (100 + percent))
    return overlap - F.ceil(percent * F.greatest(a, b) / 100) + 1


def can_link(n: int, percent: int) -> bool:
    """Whether a set of this size can link with a set that isn't equal."""
    return 100 * n >= percent * (n + 1)


def in_order(shingles: np.ndarray, ranks: np.ndarray, first: int) -> np.ndarray:
    """The ``first`` distinct shingles in the global order: rank, then hash."""
    order = ranks.astype(np.uint64) << np.uint64(52) | shingles >> np.uint64(12)
    if first < len(order):
        chosen = np.argpartition(order, first)[:first]
        return shingles[chosen[np.argsort(order[chosen])]]
    return shingles[np.argsort(order)]


def _classes(totals: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """From the counts of all shingles and words, what a word adds to the rank of its shingles, by
    its cell, and the least rank of a shingle, by its own."""
    shingles, each = totals.reshape(2, -1)
    of_words = WORD_RANKS / (48 * words) * np.log2(each + 1)
    of_cells = np.minimum(WORD_RANKS + 32 * np.log2(shingles + 1), 2 * WORD_RANKS - 1)
    often = shingles > FREQUENT * max(np.median(shingles), 1)
    return of_words.astype(np.int64), np.where(often, of_cells, 0).astype(np.int64)


def _ranks(run: np.ndarray, of_words: np.ndarray, of_cells: np.ndarray) -> np.ndarray:
    """The ranks of a text's shingles, from what its words add."""
    width = len(of_words) - len(run) + 1
    added = sum(of_words[i : len(run) + i] for i in range(width))
    return np.maximum(added, of_cells[_cell(run)])


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _described(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, key, n of every row, and beside them cell, count of the task's shingles and words."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = 1 << CELL_BITS
        totals = np.zeros(2 * cells, np.int64)  # of shingles, then of words
        kind = None
        for batch in chain.from_iterable(pieces(b, "text", STEP_BYTES) for b in batches):
            kind = batch.schema.field("doc_id").type
            hashes, first = word_hashes(batch.column("text"))
            sets = [_distinct(np.sort(run)) for run, _ in _runs(hashes, first, words)]
            held = np.concatenate([*sets, np.empty(0, np.uint64)])
            totals[:cells] += np.bincount(_cell(held), minlength=cells)
            totals[cells:] += np.bincount(_cell(hashes), minlength=cells)
            n = len(sets)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "key": pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "cell": pa.nulls(n, pa.int32()), "count": pa.nulls(n, pa.int64())})
        cell = np.flatnonzero(totals)
        if len(cell):
            m = len(cell)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.nulls(m, kind), "key": pa.nulls(m, pa.int64()),
                "n": pa.nulls(m, pa.int64()), "cell": pa.array(cell, pa.int32()),
                "count": pa.array(totals[cell], pa.int64())})

    rows = in_small_batches(documents.select("doc_id", "text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(describe, f"doc_id {kind}, key long, n long, cell int, count long")


def _postings(documents: DataFrame, totals: np.ndarray, words: int, percent: int) -> DataFrame:
    """token, key, n, pos: the indexed shingles of every set, once per task."""
    shared = documents.sparkSession.sparkContext.broadcast(_classes(totals, words))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (of_words, of_cells) = set(), shared.value
        for batch in chain.from_iterable(pieces(b, "text", STEP_BYTES) for b in batches):
            tokens, keys, sizes = [], [], []
            hashes, first = word_hashes(batch.column("text"))
            added = of_words[_cell(hashes)]
            for run, own in _runs(hashes, first, words):
                order = np.argsort(run)
                s = run[order]
                new = np.r_[True, s[1:] != s[:-1]][: len(s)]
                s = s[new]
                if len(s) and can_link(len(s), percent) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    ranks = _ranks(run, added[own], of_cells)[order[new]]
                    tokens.append(in_order(s, ranks, prefix_length(len(s), percent)))
                    keys.append(key)
                    sizes.append(len(s))
            if tokens:
                each = np.array([len(t) for t in tokens])
                begin = np.repeat(np.cumsum(each) - each, each)
                yield pa.RecordBatch.from_pydict({
                    "token": np.concatenate(tokens).view(np.int64),
                    "key": np.repeat(np.array(keys, np.int64), each),
                    "n": np.repeat(np.array(sizes, np.int32), each),
                    "pos": (np.arange(each.sum()) - begin).astype(np.int32)})

    rows = in_small_batches(documents.where("doc_id is not null").select("doc_id", "text"))
    return rows.mapInArrow(index, "token long, key long, n int, pos int")


def _with_leaders(lists: DataFrame, percent: int) -> DataFrame:
    """Rows of lists of two sets or more, with the leaders before each set in its list.

    Rows come by token, hash of the key, key. The first ``LEADERS`` sets of a list are its leaders;
    only they are kept in mind, not the list.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose list may go on
        token, leaders = None, []
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            fresh = [batch.column(c).to_numpy() for c in ("token", "key", "n", "pos")] if batch else None
            if held is None and fresh is None:
                return
            columns = fresh if held is None else held if fresh is None else [
                np.concatenate(x) for x in zip(held, fresh, strict=True)]
            t, k = columns[0], columns[1]
            # the same set may come from several tasks
            again = np.r_[False, (t[1:] == t[:-1]) & (k[1:] == k[:-1])]
            t, k, n, pos = (c[~again] for c in columns)
            joined = t[1:] == t[:-1]
            member = np.r_[joined, False] | np.r_[t[0] == token, joined]
            end = len(t) if fresh is None else len(t) - 1
            rows = np.flatnonzero(member[:end])
            keys, sizes, ends = [], [], [0]
            for x, y, z in zip(t[rows].tolist(), k[rows].tolist(), n[rows].tolist(), strict=True):
                if x != token:
                    token, leaders = x, []
                for other, size in leaders:
                    if 100 * min(size, z) >= percent * max(size, z):
                        keys.append(other)
                        sizes.append(size)
                ends.append(len(keys))
                if len(leaders) < LEADERS:
                    leaders.append((y, z))
            held = [c[end:] for c in (t, k, n, pos)] if end < len(t) else None
            if held is not None and not (end and t[end] == t[end - 1]) and t[end] != token:
                token = None
            if len(rows):
                entries = pa.StructArray.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "n"])
                yield pa.RecordBatch.from_pydict({
                    "token": t[rows], "key": k[rows], "n": n[rows], "pos": pos[rows],
                    "leaders": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)})

    return in_small_batches(lists).mapInArrow(
        lead, "token long, key long, n int, pos int, leaders array<struct<key:long,n:int>>")


def _filter_words(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for every value of ``column``, in a table of fixed size."""
    hashed = keys.select(F.xxhash64(column).alias("h")).select(
        F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int").alias("word"),
        F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    rows = hashed.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << FILTER_BITS, np.int64)
    out[rows["word"].to_numpy(int)] = rows["bits"].to_numpy(np.int64)
    return out


def _codes(shingles: np.ndarray) -> bytes:
    """A byte for the width, then the upper 16 bits of each hash, or 24 or 32 in large sets."""
    width = 2 if len(shingles) <= 1 << 12 else 3 if len(shingles) <= 1 << 20 else 4
    upper = shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + upper.tobytes()


def _most_common(x: bytes, y: bytes) -> tuple[int, int, int]:
    """Sizes of two sets and, from their codes, the most shingles that they can have in common."""
    width = min(x[0], y[0])
    sides = []
    for data in (x, y):
        upper = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])[:, :width]
        wide = np.zeros((len(upper), 4), np.uint8)
        wide[:, 4 - width :] = upper
        code = wide.view(">u4").ravel().astype(np.uint64)
        # equal codes of one set are told apart by their turn, so that each meets one of the other
        turn = np.arange(len(code)) - np.searchsorted(code, code)
        sides.append(code << np.uint64(32) | turn.astype(np.uint64))
    p, q = sides
    return len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))


def _common(x: bytes, y: bytes) -> tuple[int, int, int]:
    """Sizes of two sets and what they have in common."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))


def _sets(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """key, codes, shingles of the sets whose ids are wanted; of a few others too."""
    shared = documents.sparkSession.sparkContext.broadcast(_filter_words(wanted, "doc_id"))
    hashed = F.xxhash64("doc_id")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in chain.from_iterable(pieces(b, "text", STEP_BYTES) for b in batches):
            h = batch.column("h").to_numpy()
            word = (h.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            asked = (bits[word] >> (h & 63)) & 1
            keys, codes, data = [], [], []
            for s in shingle_sets(batch.column("text").take(pa.array(np.flatnonzero(asked))), words):
                if len(s):
                    keys.append(set_key(s))
                    codes.append(_codes(s))
                    data.append(s.tobytes())
            if keys:
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(keys, pa.int64()), "codes": pa.array(codes, pa.binary()),
                    "shingles": pa.array(data, pa.binary())})

    rows = documents.where("doc_id is not null").select("doc_id", "text", hashed.alias("h"))
    found = in_small_batches(rows).mapInArrow(
        compute, "key long, codes binary, shingles binary")
    return found.groupBy("key").agg(
        F.first("codes").alias("codes"), F.first("shingles").alias("shingles"))


def _with_sets_of(pairs: DataFrame, known: DataFrame | None, documents: DataFrame,
                  firsts: DataFrame, words: int) -> DataFrame:
    """``known`` (key, codes, shingles) and the written sets of all ends of ``pairs`` it doesn't have."""
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    missing = ends.distinct()
    if known is not None:
        missing = missing.join(known.select("key"), "key", "left_anti")
    wanted = cut(firsts.join(missing, "key"))
    if not wanted.take(1):
        return known if known is not None else staged(_sets(documents.limit(0), wanted, words))
    found = staged(_sets(documents, wanted, words).join(wanted.select("key"), "key", "left_semi"))
    return found if known is None else known.unionByName(found)


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link: by their codes at most, then by the sets themselves."""

    def keep(pairs: DataFrame, column: str, overlap) -> DataFrame:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column("_a"), batch.column("_b"), strict=True):
                    n, m, same = overlap(x.as_py(), y.as_py())
                    good.append(100 * same >= percent * (n + m - same))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        left = sets.select(F.col("key").alias("a"), F.col(column).alias("_a"))
        right = sets.select(F.col("key").alias("b"), F.col(column).alias("_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b")
        return in_small_batches(both).mapInArrow(check, "a long, b long")

    return keep(keep(pairs, "codes", _most_common), "shingles", _common)


def _grouped(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of the lists that hold more than one group, with the group of each set."""
    rows = lists.join(groups.withColumnRenamed("id", "key"), "key", "left").withColumn(
        "group", F.coalesce("component", "key")).select("token", "key", "n", "pos", "group")
    several = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.min("group").alias("_x"), F.max("group").alias("_y"))
    return rows.join(several.where("_x <> _y").drop("_x", "_y"), "token")


def _shared_enough(pairs: DataFrame, percent: int, most: int) -> DataFrame:
    """Of pairs (key, n, leader, leader_n), a row for each shared list: those that share enough
    lists, at most ``most`` for each key, as (a, b). What is left out here is met again later."""
    shared = pairs.groupBy("key", "n", "leader", "leader_n").agg(F.count(F.lit(1)).alias("m"))
    ranked = Window.partitionBy("key").orderBy(F.desc("m"), "leader")
    return (
        shared.where(F.col("m") >= needed(F.col("n"), F.col("leader_n"), percent))
        .withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= most)
        .select(F.col("key").alias("a"), F.col("leader").alias("b"))
    )


def _with_hubs(grouped: DataFrame, links: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of a set and the sets with most links of other groups in its lists."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    ranked = Window.partitionBy("component").orderBy(F.desc("degree"), "id")
    hubs = (
        ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).join(groups, "id")
        .withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= LEADERS)
        .select(F.col("id").alias("key"))
    )
    rows = grouped.join(hubs, "key").select(
        "token", F.col("key").alias("leader"), F.col("n").alias("leader_n"),
        F.col("group").alias("_group"))
    small, large = F.least("n", "leader_n"), F.greatest("n", "leader_n")
    pairs = grouped.join(rows, "token").where(
        (F.col("group") != F.col("_group")) & (100 * small >= percent * large))
    return _shared_enough(pairs, percent, LEADERS)


def _in_blocks(n: np.ndarray, pos: np.ndarray, percent: int, size: int) -> tuple[np.ndarray, list[int]]:
    """A list's rows by band of sizes, then position, and where its blocks begin.

    Two bands span the ratio of sizes that can link; a block has rows of one band.
    """
    band = np.floor(2 * np.log(n) / np.log(100 / percent)).astype(np.int64) if percent < 100 else n
    order = np.lexsort((n, pos, band))
    edges = np.flatnonzero(np.r_[True, np.diff(band[order]) != 0, True]).tolist()
    return order, [b for start, end in zip(edges, edges[1:], strict=False)
                   for b in range(start, end, size)]


def _open_blocks(n: np.ndarray, pos: np.ndarray, group: np.ndarray, begins: list[int],
                 percent: int) -> list[np.ndarray]:
    """For each block, itself and the later blocks that it can have a link of two groups with."""
    low, high = np.minimum.reduceat(n, begins), np.maximum.reduceat(n, begins)
    before = np.maximum.reduceat(pos, begins)
    behind = np.maximum.reduceat(n - pos, begins)
    one, other = np.minimum.reduceat(group, begins), np.maximum.reduceat(group, begins)
    found = []
    for i in range(len(begins)):
        need = (percent * (low[i] + low[i:]) + 99 + percent) // (100 + percent)
        most = np.minimum(before[i], before[i:]) + np.minimum(behind[i], behind[i:])
        sizes = ((100 * high[i:] >= percent * low[i]) & (100 * high[i] >= percent * low[i:]))
        groups = (one[i] != other[i:]) | (other[i] != one[i:])
        found.append(i + np.flatnonzero(sizes & groups & (most >= need)))
    return found


def _across_groups(grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different groups that a list's sizes and positions leave possible."""
    dealt = (
        grouped.withColumn("_chunks", F.ceil(F.col("m") / BLOCK).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("_chunks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .select("token", "key", "n", "pos", "group", "chunk",
                F.least("chunk", "_other").alias("low"), F.greatest("chunk", "_other").alias("high"))
    )
    keys = ["token", "low", "high"]
    parts = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "n", "key")

    def open_pairs(a: np.ndarray, b: np.ndarray, run: list[np.ndarray]) -> np.ndarray:
        """Whether sizes, positions and groups leave rows a, b of the lists possible."""
        _, _, n, pos, group, chunk, low, high = run
        small = np.minimum(n[a], n[b])
        both = n[a] + n[b]
        need = (percent * both + 99 + percent) // (100 + percent)
        # the overlap is at most what lies before this shingle in both, it, and what lies behind
        left = np.minimum(pos[a], pos[b]) + np.minimum((n - pos)[a], (n - pos)[b])
        return ((group[a] != group[b]) & (left >= need) & (100 * small >= percent * (both - small))
                & ((low[a] == high[a]) | (chunk[a] != chunk[b])))

    def packed(x: np.ndarray, y: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Pairs of rows as one row for the lesser key of each, with its partners."""
        x, y = np.where(key[x] < key[y], x, y), np.where(key[x] < key[y], y, x)
        order = np.argsort(key[x], kind="stable")
        x, y = x[order], y[order]
        first = np.flatnonzero(np.r_[True, key[x[1:]] != key[x[:-1]]])
        partners = pa.StructArray.from_arrays([pa.array(key[y]), pa.array(n[y])], names=["key", "n"])
        return pa.RecordBatch.from_pydict({
            "a": key[x[first]], "n": n[x[first]],
            "partners": pa.ListArray.from_arrays(pa.array(np.r_[first, len(x)], pa.int32()), partners)})

    def pairs_of_long(run: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Of one list, block by block."""
        if (run[4] == run[4][0]).all():
            return
        order, begins = _in_blocks(run[2], run[3], percent, SKIP_BLOCK)
        run = [c[order] for c in run]
        ends = [*begins[1:], len(order)]
        partners_of = _open_blocks(run[2], run[3], run[4], begins, percent)
        for begin, end, others in zip(begins, ends, partners_of, strict=True):
            if not len(others):
                continue
            a = np.arange(begin, end)[:, None]
            b = np.concatenate([np.arange(begins[o], ends[o]) for o in others])
            i, j = np.nonzero(open_pairs(a, b, run) & (a < b))
            if len(i):
                yield packed(begin + i, b[j], run[1], run[2])

    def pairs_of_short(run: list[np.ndarray], size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of lists of these sizes, one after the other, all at once."""
        later = np.repeat(np.cumsum(size), size) - np.arange(len(run[1])) - 1  # rows of its list behind each
        a = np.repeat(np.arange(len(later)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        open_ = open_pairs(a, b, run)
        if open_.any():
            yield packed(a[open_], b[open_], run[1], run[2])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ["token", "key", "n", "pos", "group", "chunk", "low", "high"]
        for batch in chain(batches, [None]):
            if batch is not None:
                fresh = [batch.column(c).to_numpy().astype(np.int64) for c in names]
                held = fresh if not held else [np.concatenate(x)
                                               for x in zip(held, fresh, strict=True)]
            if not held or not len(held[0]):
                continue
            change = np.zeros(len(held[0]) - 1, bool)
            for c in (held[0], held[6], held[7]):
                change |= c[1:] != c[:-1]
            edges = np.r_[0, np.flatnonzero(change) + 1, len(held[0])]
            done = edges if batch is None else edges[:-1]
            size = np.diff(done)
            for start, m in zip(done[:-1][size > SKIP_BLOCK], size[size > SKIP_BLOCK], strict=True):
                yield from pairs_of_long([c[start : start + m] for c in held])
            short = np.repeat(size <= SKIP_BLOCK, size)
            if short.any():
                yield from pairs_of_short([c[: done[-1]][short] for c in held], size[size <= SKIP_BLOCK])
            held = [c[edges[-2] :] for c in held] if batch is not None else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partners of a set from all its lists, which lie next to each other."""
        held: list[list[np.ndarray]] = []  # the last set's, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            partners = batch.column("partners")
            each, entries = partners.value_lengths().to_numpy(), partners.flatten()
            rows = [np.repeat(batch.column(c).to_numpy(), each) for c in ("a", "n")]
            held.append([*rows, *(entries.field(c).to_numpy() for c in ("key", "n"))])
            if held[-1][0][-1] != held[0][0][0]:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                end = np.searchsorted(rows[0], rows[0][-1])
                yield enough(*(c[:end] for c in rows))
                held = [[c[end:] for c in rows]]
        if held:
            yield enough(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def enough(own: np.ndarray, size: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((keys, own))
        own, size, keys, sizes = (c[order] for c in (own, size, keys, sizes))
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])])
        times = np.diff(np.r_[first, len(own)])
        own, size, keys, sizes = (c[first] for c in (own, size, keys, sizes))
        both, large = sizes + size, np.maximum(sizes, size)
        least = -(-percent * both // (100 + percent)) + (-percent * large // 100) + 1  # needed()
        return pa.RecordBatch.from_pydict({"a": own[times >= least], "b": keys[times >= least]})

    found = in_small_batches(blocks).mapInArrow(
        compare, "a long, n long, partners array<struct<key:long,n:long>>")
    by_set = found.repartition(parts, "a").sortWithinPartitions("a")
    return in_small_batches(by_set).mapInArrow(count, "a long, b long")


def _differences(groups: DataFrame, links: DataFrame, sets: DataFrame, copies: DataFrame) -> DataFrame:
    """group, key, n, copies, chunk, chunks and the difference to the group's leader, of every set
    in a group of two or more."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    degrees = groups.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id")
    leaders = degrees.groupBy("component").agg(
        F.max(F.struct("degree", "id")).alias("_best"), F.count(F.lit(1)).alias("m"))
    members = (
        groups.join(leaders.where("m > 1"), "component")
        .withColumn("chunks", F.ceil(F.col("m") / GROUP_BLOCK).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .select(F.col("component").alias("group"), F.col("id").alias("key"),
                F.col("_best.id").alias("leader"), "chunk", "chunks")
        .join(sets, "key").join(copies.where("copies > 1"), "key", "left")
        .select("group", "key", F.coalesce("copies", F.lit(1)).alias("copies"), "chunk", "chunks",
                (F.col("key") == F.col("leader")).alias("_leads"), "shingles")
    )
    # the leader's set goes before each chunk of its group
    columns = ["group", "key", "copies", "chunk", "chunks", "leads", "shingles"]
    heads = members.where("_leads").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("leads", F.lit(1))
    rows = members.withColumn("leads", F.lit(0)).select(*columns).unionByName(heads.select(*columns))
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "group", "chunk").sortWithinPartitions(
        "group", "chunk", F.desc("leads"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = np.empty(0, np.uint64)
        for batch in batches:
            kept, sizes, data = [], [], []
            for i, leads in enumerate(batch.column("leads").to_pylist()):
                own = np.frombuffer(batch.column("shingles")[i].as_py(), np.uint64)
                if leads:
                    leader = own
                    continue
                apart = np.setxor1d(own, leader, assume_unique=True)
                kept.append(i)
                sizes.append(len(own))
                data.append(apart.tobytes())
            if kept:
                mine = batch.select(["group", "key", "copies", "chunk", "chunks"]).take(pa.array(kept))
                yield pa.RecordBatch.from_arrays(
                    [*mine.columns, pa.array(sizes, pa.int64()), pa.array(data, pa.binary())],
                    names=[*mine.schema.names, "n", "difference"])

    return in_small_batches(rows).mapInArrow(
        differ, "group long, key long, copies long, chunk int, chunks int, n long, difference binary")


def _links_of(n: np.ndarray, copies: np.ndarray, differences: list[np.ndarray], percent: int,
              chunk: np.ndarray | None = None) -> np.ndarray:
    """Each set's links with the others, from the differences to one leader; if there is
    ``chunk``, only the links from one chunk to another."""
    size = np.array([len(d) for d in differences])
    token = np.unique(np.concatenate([*differences, np.empty(0, np.uint64)]), return_inverse=True)[1]
    holder = np.repeat(np.arange(len(n)), size)[np.argsort(token, kind="stable")]
    begin = np.r_[0, np.cumsum(np.bincount(token, minlength=1))]
    first = np.r_[0, np.cumsum(size)]
    total = np.zeros(len(n), np.int64)
    for i in range(len(n) - 1):
        both = n[i] + n[i + 1 :]
        need = -(-percent * both // (100 + percent))
        # the overlap is this and what the differences have in common
        least = (both - size[i] - size[i + 1 :]) // 2
        linked = least >= need
        open_ = ~linked & (least + np.minimum(size[i], size[i + 1 :]) >= need)
        if chunk is not None:
            other = chunk[i + 1 :] != chunk[i]
            linked &= other
            open_ &= other
        if open_.any():
            t = token[first[i] : first[i + 1]]
            each = begin[t + 1] - begin[t]
            at = np.repeat(begin[t] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            common = np.bincount(holder[at], minlength=len(n))[i + 1 :]
            linked |= open_ & (least + common >= need)
        total[i] += copies[i + 1 :][linked].sum()
        total[i + 1 :] += linked * copies[i]
    return total


def _links_inside(differences: DataFrame, percent: int) -> DataFrame:
    """key, n_links: the links of a set with sets of its own group, in a row for each block."""
    dealt = differences.withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    ).select(
        "group", "key", "copies", "chunk", "n", "difference",
        F.least("chunk", "_other").alias("low"), F.greatest("chunk", "_other").alias("high"))
    keys = ["group", "low", "high"]
    parts = int(differences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)

    def counted(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        key, n, copies, chunk = (np.concatenate([r.column(c).to_numpy() for r in rows])
                                 for c in ("key", "n", "copies", "chunk"))
        apart = [np.frombuffer(d.as_py(), np.uint64) for r in rows for d in r.column("difference")]
        inside = rows[0].column("low")[0] == rows[0].column("high")[0]
        return key, _links_of(n, copies, apart, percent, None if inside else chunk)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, ready = [], None, []
        for batch in chain(batches, [None]):
            if batch is None:
                edges = [0]
            else:
                marks = np.stack([batch.column(c).to_numpy() for c in keys])
                change = (marks[:, 1:] != marks[:, :-1]).any(axis=0)
                edges = [0, *(np.flatnonzero(change) + 1), batch.num_rows] if batch.num_rows else [0]
            for start, end in zip(edges, edges[1:], strict=False):
                here = tuple(marks[:, start])
                if held and here != at:
                    ready.append(counted(held))
                    held = []
                held.append(batch.slice(start, end - start))
                at = here
            if batch is None and held:
                ready.append(counted(held))
            if ready and (batch is None or sum(len(k) for k, _ in ready) >= SENT):
                yield pa.RecordBatch.from_pydict({
                    "key": np.concatenate([k for k, _ in ready]),
                    "n_links": np.concatenate([c for _, c in ready])})
                ready = []

    return in_small_batches(blocks).mapInArrow(compare, "key long, n_links long")


def _links_across(links: DataFrame, copies: DataFrame) -> DataFrame:
    """key, n_links of both ends of distinct links (a, b); the links of one set in ``SALTS`` tasks."""
    both = links.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("key"), F.col("a").alias("other")))
    salted = both.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    every = copies.where("copies > 1").select(
        F.col("key").alias("other"), "copies",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return salted.join(every, ["other", "_salt"], "left").select(
        "key", F.coalesce("copies", F.lit(1)).alias("n_links"))


def linked_documents(documents: DataFrame, words: int = 3, percent: int = 90,
                     count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, the key of its set, and n_links of every row.

    Two documents link when 100 * intersection >= percent * union of their sets. ``n_links`` is
    the number of other ids that a row links with, equal sets included; without ``count_links``
    the column isn't there and its work not done.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "shingles")
    _described(documents, words).write.parquet(path)
    described = spark.read.parquet(path)
    rows = described.where("cell is null").select("doc_id", "key", "n")
    counts = described.where("cell is not null").groupBy("cell").agg(F.sum("count").alias("count"))
    cells = counts.toPandas()  # at most 2 << CELL_BITS rows
    totals = np.zeros(2 << CELL_BITS)
    totals[cells["cell"].to_numpy(int)] = cells["count"].to_numpy(float)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = _postings(documents, totals, words, percent).repartition(
        parts, "token").sortWithinPartitions("token", F.xxhash64("key"), "key")
    path = scratch_path(spark, "lists")
    _with_leaders(lists, percent).write.parquet(path)
    lists = spark.read.parquet(path)

    firsts = cut(rows.where("key is not null and doc_id is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc_id")))
    led = lists.where(F.size("leaders") > 0).select("key", "n", F.explode("leaders").alias("l"))
    nearest = cut(_shared_enough(
        led.select("key", "n", F.col("l.key").alias("leader"), F.col("l.n").alias("leader_n")),
        percent, LEADERS))
    sets = _with_sets_of(nearest, None, documents, firsts, words)
    links = cut(_checked(nearest, sets, percent))
    groups = groups_within(links)
    lists = lists.drop("leaders")
    for _ in range(HUB_ROUNDS):
        grouped = cut(_grouped(lists, groups))
        hubs = cut(_with_hubs(grouped, links, groups, percent))
        sets = _with_sets_of(hubs, sets, documents, firsts, words)
        links = cut(links.unionByName(_checked(hubs, sets, percent)))
        groups = groups_within(links)
        lists = grouped.select("token", "key", "n", "pos")
    across = cut(_across_groups(_grouped(lists, groups), percent))
    sets = _with_sets_of(across, sets, documents, firsts, words)
    found = _checked(across, sets, percent)
    if count_links:
        # every link is inside one of the groups or between two of them
        found = cut(found)
        copies = cut(rows.where("key is not null and doc_id is not null").select("key", "doc_id")
                     .distinct().groupBy("key").agg(F.count(F.lit(1)).alias("copies")))
        inside = _links_inside(_differences(groups, links, sets, copies), percent)
        counted = (
            inside.unionByName(_links_across(found, copies))
            .unionByName(copies.select("key", (F.col("copies") - 1).alias("n_links")))
            .groupBy("key").agg(F.sum("n_links").alias("n_links"))
        )
    links = links.unionByName(found)
    # the groups' own links stand for the many that they came from
    stars = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
    groups = components(stars.unionByName(links))

    named = firsts.join(groups.withColumnRenamed("id", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_key = named.join(smallest, "component").select("key", "component_id")
    if count_links:
        of_key = of_key.join(counted, "key")
    known = F.col("doc_id").isNotNull()
    columns = ["doc_id", F.col("n").alias("n_shingles"),
               F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), "key"]
    if count_links:
        columns.append(F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
    return rows.join(of_key, "key", "left").select(*columns)


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each group of linked ones, that of the smallest id; rows
    without an id all stay."""
    copies = linked_documents(documents, words, percent, count_links=False).where(
        "doc_id <> component_id")
    return documents.join(copies.select("doc_id").distinct(), "doc_id", "left_anti").select(
        *documents.columns)
