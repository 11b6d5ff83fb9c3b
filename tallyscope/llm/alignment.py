"""Alignment of two tokenizers' encodings of the same texts, in Arrow from end to end.

Every text is encoded by a byte-level BPE (A) and a SentencePiece model (B). Both tokenizations
cover the same bytes, a space and the text, so the byte offsets where tokens of both end cut them
into groups, and the two tokens that end there are linked.

A task works on Arrow arrays of a step's texts: token lists are flattened next to their parent
indices, byte lengths are summed up within each parent, Acero joins A and B on (document, end), and
``Table.group_by`` counts a document's linked id pairs. Spark merges these partial counts into the
table of id pairs. The second pass gives each document the counts of its pairs: the most frequent
pairs, a list of bounded length, by lookup in the task; all others by a join on the pair.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte by byte
(for instance the literal mark U+2581, which B reads as a space), have no tokens: zeros and an
empty digest. Strings of special tokens are plain text. Every row gives a row, equal rows and rows
without an id too; ties for a B id's best pair all count; an empty table gives no rows. Texts are
encoded whole. Extra columns of any name are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import in_small_batches, pieces
from tallyscope.llm.token_counts import byte_chars
from tallyscope.session import staged

#: Bytes of text that one step of a task works on; bounds memory only.
STEP_BYTES = 1_500_000
#: Rows of partial pair counts that a task holds before it sends them; bounds memory only.
HELD_PAIRS = 500_000
#: Most frequent pairs that every task looks up without a join: 20 bytes each.
FREQUENT_PAIRS = 1 << 18
#: A pair of ids as one number.
B_IDS = 1 << 24
MARK = "▁"
#: The split pattern of byte-level vocabularies, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoders:
    """Both tokenizers and the bytes of their ids; sent to the tasks as data, built on first use."""

    def __init__(self, byte_bpe: str, piece_model: str):
        with open(byte_bpe, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        vocabulary = {token: i for token, i in spec["model"]["vocab"].items()
                      if token not in self.special}
        self.ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        if made != sorted(set(made)) or len(made) + 256 != len(vocabulary):
            raise ValueError("the ids of this vocabulary don't follow its merges")
        if spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel":
            raise ValueError("only plain byte-level vocabularies are supported")
        with open(piece_model, "rb") as file:
            self.model = file.read()
        self._built = None

    def __getstate__(self):
        return self.__dict__ | {"_built": None}

    def build(self) -> tuple:
        """(A's encoder, B's processor, bytes of A's ids, bytes of B's ids)."""
        if self._built is None:
            import sentencepiece
            import tiktoken

            a = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=self.ranks,
                                  special_tokens={})
            b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            a_bytes = [b""] * (max(self.ranks.values()) + 1)
            for token, i in self.ranks.items():
                a_bytes[i] = token
            b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode()
                       for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
            self._built = (a, b, pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary()))
        return self._built


def _joined(tokens: pa.ListArray, of_id: pa.BinaryArray) -> pa.BinaryArray:
    spelled = pa.ListArray.from_arrays(tokens.offsets, pc.take(of_id, tokens.values))
    return pc.binary_join(spelled, pa.scalar(b"", pa.binary()))


def _ends(tokens: pa.ListArray, of_id: pa.BinaryArray) -> pa.Table:
    """A row per token: its document's place, the byte offset where it ends, its id and place."""
    flat, parent = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    lengths = pc.take(pc.binary_length(of_id), flat).cast(pa.int64())
    running = pc.cumulative_sum(lengths)
    # what ran up before a document starts is taken off again
    starts = tokens.offsets.slice(0, len(tokens))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), running]), starts)
    return pa.table({"doc": parent, "end": pc.subtract(running, pc.take(before, parent)),
                     "id": flat, "at": pa.array(np.arange(len(flat)))})


def _listed(values: pa.Array, lasts: np.ndarray) -> pa.ListArray:
    """``values`` cut into lists that end at the places ``lasts``."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, lasts + 1), pa.int32()), values)


def aligned_texts(texts: pa.Array, encoders: Encoders) -> dict[str, pa.Array]:
    """n_a, n_b, n_groups, n_links, groups (text), pairs and times (linked id pairs of a text and
    how often it holds them) of every text."""
    encode_a, encode_b, a_bytes, b_bytes = encoders.build()
    texts = pc.fill_null(texts, "")
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
    a = pa.array(encode_a.encode_ordinary_batch(spaced.to_pylist(), num_threads=1), pa.list_(pa.int32()))
    b = pa.array(encode_b.encode(texts.to_pylist(), num_threads=1), pa.list_(pa.int32()))
    whole = spaced.cast(pa.binary())
    same = pc.and_(pc.equal(_joined(a, a_bytes), whole), pc.equal(_joined(b, b_bytes), whole))
    kept = pc.and_(same, pc.greater(pc.binary_length(texts), 0))
    a, b, rows = a.filter(kept), b.filter(kept), np.flatnonzero(kept.to_numpy(zero_copy_only=False))

    ends_a, ends_b = _ends(a, a_bytes), _ends(b, b_bytes)
    met = ends_a.select(["doc", "end", "at"]).join(
        ends_b.select(["doc", "end", "at"]), ["doc", "end"], join_type="inner",
        right_suffix="_b", use_threads=False)
    # the join's order is its own: links are put back by the place of their A token
    partner = np.full(len(ends_a), -1)
    partner[met["at"].to_numpy()] = met["at_b"].to_numpy()
    last_a = np.flatnonzero(partner >= 0)
    last_b = partner[last_a]
    doc = ends_a["doc"].to_numpy()[last_a]
    id_a, id_b = ends_a["id"].to_numpy(), ends_b["id"].to_numpy()

    side = [pc.binary_join(_listed(pc.cast(pa.array(ids), pa.string()), lasts), ",")
            for ids, lasts in ((id_a, last_a), (id_b, last_b))]
    links = np.bincount(doc, minlength=len(rows))
    groups = pc.binary_join(_listed(pc.binary_join_element_wise(*side, "|"),
                                    np.cumsum(links) - 1), ";")
    pairs = pa.table({"doc": doc, "pair": id_a[last_a].astype(np.int64) * B_IDS + id_b[last_b]})
    counted = pairs.group_by(["doc", "pair"], use_threads=False).aggregate(
        [([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")])

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        out[rows] = values
        return out

    different = spread(np.bincount(counted["doc"].to_numpy(), minlength=len(rows)))
    offsets = pa.array(np.append(0, np.cumsum(different)), pa.int32())
    place = np.full(len(texts), -1)
    place[rows] = np.arange(len(rows))
    n_links = pa.array(spread(links))
    return {
        "n_a": pa.array(spread(pc.list_value_length(a).to_numpy())),
        "n_b": pa.array(spread(pc.list_value_length(b).to_numpy())),
        # a text's last tokens end together, so each link ends one group and each group in one
        "n_groups": n_links, "n_links": n_links,
        "groups": pc.fill_null(pc.take(groups, pa.array(place, mask=place < 0)), ""),
        "pairs": pa.ListArray.from_arrays(offsets, counted["pair"].combine_chunks()),
        "times": pa.ListArray.from_arrays(offsets, counted["count_all"].combine_chunks().cast(pa.int32())),
    }


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def alignments(documents: DataFrame, byte_bpe: str, piece_model: str, key: str = "doc_id",
               keep_groups: bool = False) -> DataFrame:
    """The alignment of every text: the key, row (a number of its own for each row), n_a, n_b,
    n_groups, n_links, groups_sha256, pairs and times; with ``keep_groups`` also groups, the text
    ``a1,a2|b1;a3|b2,b3`` of A and B ids."""
    shared = documents.sparkSession.sparkContext.broadcast(Encoders(byte_bpe, piece_model))
    rows = in_small_batches(documents.select(
        F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), "text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", STEP_BYTES):
                found = aligned_texts(part.column("text"), shared.value)
                found["groups_sha256"] = pa.array(
                    [hashlib.sha256(g).hexdigest() if g else ""
                     for g in found["groups"].cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("row"), *(found[c] for c in names)],
                    names=["key", "row", *names])

    names = [*COUNTS, "groups_sha256", "pairs", "times", *["groups"] * keep_groups]
    shape = ", ".join([f"key {rows.schema['key'].dataType.simpleString()}", "row long",
                       *(f"{c} long" for c in COUNTS),
                       "groups_sha256 string, pairs array<long>, times array<int>",
                       *["groups string"] * keep_groups])
    return rows.mapInArrow(align, shape)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n (links that hold the pair), best (no pair of this B id has more) over
    the rows of ``alignments``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        for batch in batches:
            more = pa.table({"pair": pc.list_flatten(batch.column("pairs")),
                             "n": pc.list_flatten(batch.column("times")).cast(pa.int64())})
            held = pa.concat_tables([held, more])
            if len(held) > 2 * HELD_PAIRS:
                held = merged(held)
                if len(held) > HELD_PAIRS:
                    yield from held.to_batches()
                    held = held.slice(0, 0)
        yield from merged(held).to_batches()

    def merged(table: pa.Table) -> pa.Table:
        sums = table.group_by("pair", use_threads=False).aggregate([("n", "sum")])
        return sums.rename_columns(["pair", "n"]).combine_chunks()

    counts = (aligned.select("pairs", "times").mapInArrow(count, "pair long, n long")
              .groupBy("pair").agg(F.sum("n").alias("n")))
    counts = staged(counts.select("pair", F.expr(f"cast(pair div {B_IDS} as int)").alias("a_id"),
                                  (F.col("pair") % B_IDS).cast("int").alias("b_id"), "n"), "id-pairs")
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("pair", "a_id", "b_id", "n",
                                            (F.col("n") == F.col("most")).alias("best"))


def _with_frequent(aligned: DataFrame, counts: DataFrame, frequent: int) -> DataFrame:
    """``aligned`` with best_links and sum_links over the most frequent pairs; the others are left
    in pairs and times."""
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    shared = aligned.sparkSession.sparkContext.broadcast(
        (top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    names = ["key", "row", *COUNTS, "groups_sha256"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair_of, n_of, best_of = shared.value
        for batch in batches:
            pairs = pc.list_flatten(batch.column("pairs")).to_numpy()
            times = pc.list_flatten(batch.column("times")).to_numpy()
            doc = pc.list_parent_indices(batch.column("pairs")).to_numpy()
            at = np.minimum(np.searchsorted(pair_of, pairs), max(0, len(pair_of) - 1))
            found = pair_of[at] == pairs if len(pair_of) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], doc[found], times[found] * best_of[at[found]])
            np.add.at(sums[1], doc[found], times[found] * n_of[at[found]])
            left = np.bincount(doc[~found], minlength=batch.num_rows)
            offsets = pa.array(np.append(0, np.cumsum(left)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sums[0]), pa.array(sums[1]),
                 pa.ListArray.from_arrays(offsets, pa.array(pairs[~found])),
                 pa.ListArray.from_arrays(offsets, pa.array(times[~found]))],
                names=[*names, "best_links", "sum_links", "pairs", "times"])

    kept = aligned.select(*names, "pairs", "times")
    shape = kept.select(*names, F.lit(0).cast("long").alias("best_links"),
                        F.lit(0).cast("long").alias("sum_links"), "pairs", "times").schema
    return kept.mapInArrow(look_up, shape)


def aligned_documents(documents: DataFrame, byte_bpe: str, piece_model: str,
                      frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``frequent`` pairs are looked up without a join; it changes no result.
    """
    aligned = staged(alignments(documents, byte_bpe, piece_model), "aligned")
    counts = staged(pair_counts(aligned), "id-pairs")
    partly = staged(_with_frequent(aligned, counts, frequent), "aligned-partly")
    rest = (partly.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
            .select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
            .join(counts, "pair").groupBy("row")
            .agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("best_rest"),
                 F.sum(F.col("times") * F.col("n")).alias("sum_rest")))
    zero = F.lit(0).cast("long")
    return partly.join(rest, "row", "left").select(
        F.col("key").alias("doc_id"), *COUNTS,
        (F.col("best_links") + F.coalesce("best_rest", zero)).alias("n_best"),
        (F.col("sum_links") + F.coalesce("sum_rest", zero)).alias("count_sum"), "groups_sha256")
