"""Near-duplicate vectors of one label by cross-polytope hashing after fast Hadamard rotations.

Equal vectors of a label become one representative with a count first. A hash rotates a vector
with random signs and three Walsh-Hadamard transforms and takes the axis, with its sign, that the
result is nearest to. A table joins ``HASHES`` hashes; besides its own bucket a vector is put
into those where one hash gives its second-nearest axis (multiprobe), so two vectors meet if any
of their buckets is the same. Buckets of one vector are dropped before vectors are sent.

Inside a bucket all pairs are checked by cosine in double precision, block by block: a bucket of
more than ``BLOCK`` vectors is dealt into chunks, and each pair of chunks is a task's work of its
own, so that no bucket is held whole, capped or left out. Pairs are counted, never sent on: a
pair counts in the first bucket that both vectors have, and a block sends its vectors' link
counts and a spanning forest of its links. Links are between vectors, so copies count each.

Null, empty, zero vectors, vectors with null or non-finite parts and rows without a label link
with nothing; vectors of different lengths are never compared. Rows without an id keep null as
their component. Repeated rows are copies of each other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import in_small_batches
from tallyscope.llm.components import components
from tallyscope.session import cut

LEAST_COSINE = 0.93
TABLES, HASHES, AXES = 8, 2, 2
BLOCK = 2048
#: Buckets of up to so many vectors are compared together with others.
SMALL_RUN = 32
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2)
        h *= 2
        x = x.reshape(n, d)
    return x


def bucket_codes(vectors: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """vectors x tables x probes: the buckets of each vector, its own first."""
    n, d = vectors.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = vectors
    out = np.empty((n, tables, 1 + HASHES * (AXES - 1)), np.int64)
    for table in range(tables):
        near = []
        for part in range(HASHES):
            signs = np.random.default_rng((SEED, table, part)).choice((-1.0, 1.0), (3, size))
            x = padded
            for s in signs:
                x = hadamard(x * s)
            order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :AXES]
            near.append(order * 2 + (np.take_along_axis(x, order, 1) > 0))
        own = [a[:, 0] for a in near]
        probes = [own] + [[*own[:part], near[part][:, k], *own[part + 1 :]]
                          for part in range(HASHES) for k in range(1, AXES)]
        for i, parts in enumerate(probes):
            code = np.zeros(n, np.int64)
            for axis in parts:
                code = code * (2 * size) + axis
            out[:, table, i] = code
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as doubles."""
    n = len(column)
    return np.asarray(column.flatten(), float).reshape(n, -1)


def _bucket_rows(reps: DataFrame) -> DataFrame:
    """rep, table, code: the buckets of every representative."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                found = bucket_codes(_matrix(part.column("embedding")))
                n, tables, probes = found.shape
                yield pa.RecordBatch.from_pydict({
                    "rep": np.repeat(part.column("rep").to_numpy(), tables * probes),
                    "table": np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n),
                    "code": found.ravel()})

    rows = in_small_batches(reps.select("rep", "d", "embedding"))
    return rows.mapInArrow(codes, "rep long, table int, code long").distinct()


def _pairs(run: np.ndarray, chunk: np.ndarray, across: np.ndarray, vectors: np.ndarray,
           least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one run (rows of a run lie next to each other) with enough cosine.

    Small runs are compared all at once, pair by pair; large ones as blocks of a product. Where
    a run holds two chunks (``across``), only rows of different chunks are compared.
    """
    norms = np.sqrt((vectors * vectors).sum(1))
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[first, len(run)])
    small = size <= SMALL_RUN
    # each row of a small run with every later row of it
    row = np.flatnonzero(np.repeat(small, size))
    later = (np.repeat(first + size, size) - np.arange(len(run)) - 1)[row]
    i = np.repeat(row, later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    dots = np.empty(len(i))
    for at in range(0, len(i), 20_000):
        part = slice(at, at + 20_000)
        dots[part] = np.einsum("ij,ij->i", vectors[i[part]], vectors[j[part]])
    found = [(i, j, dots / (norms[i] * norms[j]) >= least)]
    for begin, n in zip(first[~small], size[~small], strict=True):
        for at in range(begin, begin + n, 512):
            end = min(at + 512, begin + n)
            cosines = (vectors[at:end] @ vectors[at : begin + n].T) / (
                norms[at:end, None] * norms[at : begin + n])
            x, y = np.nonzero(cosines >= least)
            found.append((x[x < y] + at, y[x < y] + at, np.ones((x < y).sum(), bool)))
    i, j, hit = (np.concatenate(x) for x in zip(*found, strict=True))
    hit &= ~across[i] | (chunk[i] != chunk[j])
    return i[hit], j[hit]


def _in_first_bucket(i: np.ndarray, j: np.ndarray, table: np.ndarray, code: np.ndarray,
                     vectors: np.ndarray) -> np.ndarray:
    """Whether the bucket at hand is the first that both vectors of a pair are in."""
    named, local = np.unique(np.r_[i, j], return_inverse=True)
    codes = bucket_codes(vectors[named])
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 20_000):
        part = slice(at, at + 20_000)
        x, y = codes[local[: len(i)][part]], codes[local[len(i) :][part]]
        common = (x[:, :, :, None] == y[:, :, None, :]).any(3)
        shared = np.where(common, x, np.iinfo(np.int64).max).min(2)  # smallest code by table
        first = common.any(2).argmax(1)
        out[part] = (first == table[i[part]]) & (shared[np.arange(len(x)), first] == code[i[part]])
    return out


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reached from each of ``n`` nodes over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(blocks: DataFrame, least: float) -> DataFrame:
    """rep, root, links: per block, the links of each vector and the forest of the block."""

    def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows again, cut between keys only; a key has at most two chunks of rows."""
        held: pa.Table | None = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            last = run_numbers(held)
            cut_at = int(np.searchsorted(last, last[-1])) if len(last) else 0
            if cut_at:
                yield held.slice(0, cut_at).combine_chunks()
                held = held.slice(cut_at)
        if held is not None and held.num_rows:
            yield held.combine_chunks()

    def run_numbers(rows: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, rows.num_rows - 1), np.int64)
        for key in ("bucket", "low", "high"):
            column = rows[key].to_numpy()
            change |= column[1:] != column[:-1]
        return np.cumsum(np.r_[np.zeros(min(1, rows.num_rows), np.int64), change])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches):
            # vectors of one length: a bucket's are, so runs stay whole
            for d in np.unique(rows["d"].to_numpy()):
                part = rows.filter(pc.equal(rows["d"], int(d))).combine_chunks()
                vectors = _matrix(part["embedding"].combine_chunks())
                names = ("rep", "copies", "chunk", "low", "high", "table", "code")
                rep, copies, chunk, low, high, table, code = (part[c].to_numpy() for c in names)
                i, j = _pairs(run_numbers(part), chunk, low != high, vectors, least)
                if not len(i):
                    continue
                mine = _in_first_bucket(i, j, table, code, vectors)
                ids, at = np.unique(rep, return_inverse=True)
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, at[i[mine]], copies[j[mine]])
                np.add.at(links, at[j[mine]], copies[i[mine]])
                root = ids[_forest(at[i], at[j], len(ids))]
                keep = (links > 0) | (root != ids)
                yield pa.RecordBatch.from_pydict(
                    {"rep": ids[keep], "root": root[keep], "links": links[keep]})

    return in_small_batches(blocks).mapInArrow(verify, "rep long, root long, links long")


def linked_vectors(embeddings: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    finite = F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    alive = (F.col("vec_id").isNotNull() & F.col("label").isNotNull()
             & F.col("embedding").isNotNull() & finite
             & F.exists("embedding", lambda x: x != 0))
    rows = embeddings.select("vec_id", F.col("label").alias("_label"),
                             F.when(alive, F.col("embedding")).alias("_v"))
    # equal vectors of a label, counted per task before they are sent
    reps = cut(
        rows.where("_v is not null").groupBy("_label", F.col("_v").alias("embedding"))
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("_label", "embedding", "first", "copies", F.size("embedding").alias("d"),
                # an id of its own: two vectors may have one vec_id
                F.xxhash64("_label", "embedding").alias("rep"))
    )
    codes = cut(_bucket_rows(reps).join(reps.select("rep", "_label", "d"), "rep").select(
        "rep", "table", "code", F.xxhash64("_label", "d", "table", "code").alias("bucket")))
    counts = codes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / block).cast("int")
    dealt = (
        codes.join(counts, "bucket")
        .withColumn("_chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("_chunks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .select("rep", "table", "code", "bucket", "chunk", F.least("chunk", "_other").alias("low"),
                F.greatest("chunk", "_other").alias("high"))
    )
    keys = ["bucket", "low", "high"]
    parts = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (
        dealt.join(reps.select("rep", "copies", "d", "embedding"), "rep")
        .repartition(parts, *keys).sortWithinPartitions(*keys)
    )
    verified = cut(_verified(blocks, least))
    found = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        reps.join(links, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    by_vector = named.join(smallest, "component").select(
        "_label", F.col("embedding").alias("_v"), "smallest",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.join(by_vector, ["_label", "_v"], "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
