"""SentencePiece encoding and decoding of whole texts, shared prefixes scored once.

Texts are marked (a dummy mark in front, spaces become marks) and cut into marked words: a run of
marks and what follows up to the next mark. No piece of the vocabulary has a mark after another
character (checked on loading), so no segmentation crosses that cut. The distinct words of a
batch are sorted, and the trie they form is walked depth-first: the forward state of a position
depends only on the characters before it, so words reuse the states of their common prefix.

Two kinds of forward state:
* unigram models: the best sum of piece scores up to the position and the last piece on that path
  (Viterbi);
* BPE models, such as the supplied one: their scores are merge priorities, and the path with the
  best sum isn't what the merges give. The state is the last piece of the merged prefix. It is
  found like a Viterbi back pointer, among the pieces that end here: the one that stays separate
  from the last piece of the prefix before it. A sequence is what the merges give exactly when
  each piece merges to itself and no two neighbours would merge differently, so this is exact.

Characters outside the vocabulary become byte pieces (or the unknown id without byte pieces).
Null text gives null ids, empty text no ids. Literal marks in a text decode to spaces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import in_small_batches, pieces

MARK = "▁"
#: Segmented words remembered by a task before it starts over; bounds memory only.
REMEMBERED = 500_000
#: Pairs of pieces whose separation is remembered likewise.
PAIRS = 250_000
#: Bytes of text that one step of a task works on; bounds memory only.
STEP_BYTES = 2_000_000
NEVER = float("-inf")
MARKED_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces, scores and byte pieces of a model; ``kind`` is "bpe" or "unigram"."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int] | None,
                 unknown: int, kind: str):
        if any(MARK in piece.lstrip(MARK) for piece in scores):
            raise ValueError("a piece holds a mark after another character")
        self.scores, self.ids, self.kind = scores, ids, kind
        self.byte_ids, self.unknown = byte_ids, unknown
        alone = [p for p in scores if kind == "unigram" or self.merge(p) == [p]]
        self.alone = {p: ids[p] for p in alone}
        # lengths of the pieces that end in these three characters, longest first
        lengths: dict[str, set[int]] = {}
        for piece in alone:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {end: (*sorted(found, reverse=True), 2, 1) for end, found in lengths.items()}
        self.text_of = {i: p for p, i in ids.items()}
        self.bytes_of = {i: p.encode() for p, i in ids.items()} | {unknown: " \u2047 ".encode()}
        self.bytes_of |= {i: bytes([b]) for b, i in enumerate(byte_ids or [])}
        self.stable: dict = {}
        self.traces: dict = {}
        self.known = KnownWords()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads the pieces of a SentencePiece model file."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = sentencepiece_model_pb2.ModelProto.SentencePiece.NORMAL
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that keep the text as it is are supported")
        if any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        kinds = {1: "unigram", 2: "bpe"}
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
        byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls({p.piece: p.score for p in model.pieces if p.type == normal}, ids,
                   byte_ids if model.trainer_spec.byte_fallback else None,
                   processor.unk_id(), kinds[model.trainer_spec.model_type])

    def separate(self, ids: tuple[int, int]) -> bool:
        """Whether merging the characters of two pieces, given by id, gives these two pieces.

        Each piece's own merges are known. Run side by side, best first and the left one of
        equals, they meet only where the parts next to the border would merge before theirs.
        """
        pair = self.text_of[ids[0]], self.text_of[ids[1]]
        left, right = self.trace(pair[0]), self.trace(pair[1])
        x, y, i, j, known = pair[0][-1], pair[1][0], 0, 0, None
        while known is None:
            border = self.scores.get(x + y, NEVER)
            a = left[i][0] if i < len(left) else NEVER
            b = right[j][0] if j < len(right) else NEVER
            if border > a and border >= b and border != NEVER:
                known = False
            elif a == b == NEVER:
                known = True
            elif a >= b:
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1
        if len(self.stable) > PAIRS:
            self.stable.clear()
        self.stable[ids] = known
        return known

    def trace(self, piece: str) -> list[tuple[float, str, str]]:
        """The merges of a piece's characters: score, and the first and last part afterwards."""
        found = self.traces.get(piece)
        if found is None:
            found = self.traces[piece] = []
            self.merge(piece, found)
        return found

    def merge(self, text: str, steps: list | None = None) -> list[str]:
        """Best-scored neighbours first, leftmost of equals, until no merge is a piece."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1], NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))
        return parts

    def char_ids(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]


class ForwardStates:
    """Forward states along the current path from the root of the trie of sorted words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.word = vocabulary, ""
        # for each position: the id of the piece that ends there (none for an unknown character,
        # which merges with nothing), where that piece starts, and the best sum of scores
        self.last: list[int | None] = [None]
        self.start: list[int] = [0]
        self.best: list[float] = [0.0]
        # an unknown character costs more than any path of known pieces, as in the published model
        self.floor = min(vocabulary.scores.values(), default=0.0) - 10.0

    def advance(self, word: str) -> tuple[int, ...]:
        """Goes up to the common prefix of the last word and down to the end of this one."""
        before, shared = self.word, 0
        if word.startswith(before):
            shared = len(before)
        else:
            most = min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del self.last[shared + 1 :], self.start[shared + 1 :], self.best[shared + 1 :]
        self.word = word
        (self._bpe if self.vocabulary.kind == "bpe" else self._unigram)(word, shared + 1)
        return self._ids()

    def _ids(self) -> tuple[int, ...]:
        """The word's ids, read from its end back along the pieces' starts."""
        v, last, start, ids, end = self.vocabulary, self.last, self.start, [], len(self.word)
        while end:
            own = last[end]
            if own is None:
                ids.extend(reversed(v.char_ids(self.word[end - 1])))
            else:
                ids.append(own)
            end = start[end]
        ids.reverse()
        return tuple(ids)

    def _bpe(self, word: str, begin: int) -> None:
        v, last, start = self.vocabulary, self.last, self.start
        piece_id, separate, lengths = v.alone.get, v.stable.get, v.lengths.get
        for end in range(begin, len(word) + 1):
            for length in lengths(word[end - 3 : end] if end > 2 else word[:end], (2, 1)):
                if length > end:
                    continue
                own = piece_id(word[end - length : end])
                if own is None:
                    continue
                # nothing merges across the word's start or an unknown character
                left = last[end - length]
                if left is not None:
                    apart = separate((left, own))
                    if apart is None:
                        apart = v.separate((left, own))
                    if not apart:
                        continue
                last.append(own)
                start.append(end - length)
                break
            else:
                last.append(None)
                start.append(end - 1)

    def _unigram(self, word: str, begin: int) -> None:
        v, scores = self.vocabulary, self.best
        for end in range(begin, len(word) + 1):
            best, at, piece = None, 0, ""
            for length in v.lengths.get(word[max(0, end - 3) : end], (2, 1)):
                start = end - length
                score = v.scores.get(word[start:end]) if start >= 0 else None
                if score is not None and (best is None or scores[start] + score > best):
                    best, at, piece = scores[start] + score, start, word[start:end]
            if word[end - 1] not in v.scores:
                alone = scores[end - 1] + self.floor
                if best is None or alone > best:
                    best, at, piece = alone, end - 1, ""
            scores.append(best)
            self.last.append(v.ids.get(piece))
            self.start.append(at)


class KnownWords:
    """Ids of the words segmented so far, in one flat array."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.flat, self.begins = array("i"), array("q", [0])

    def learn(self, words: set[str], vocabulary: Vocabulary) -> None:
        """One walk over the trie of the sorted new words."""
        fresh = words - self.rows.keys()
        if len(self.rows) > REMEMBERED:
            self.__init__()
            fresh = words
        states = ForwardStates(vocabulary)
        for word in sorted(fresh):
            self.flat.extend(states.advance(word))
            self.rows[word] = len(self.rows)
            self.begins.append(len(self.flat))

    def ids(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts' words in a row, and where each text's begin and end."""
        each = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(words)), np.int64,
                           each.sum())
        begins = np.frombuffer(self.begins, np.int64)
        length = begins[rows + 1] - begins[rows]
        upto = np.r_[0, np.cumsum(length)]
        at = np.repeat(begins[rows] - upto[:-1], length) + np.arange(upto[-1])
        return np.frombuffer(self.flat, np.int32)[at], upto[np.r_[0, np.cumsum(each)]]


def segment(words: set[str], vocabulary: Vocabulary) -> dict[str, tuple[int, ...]]:
    """Ids of each distinct marked word, from one walk over the trie of the sorted words."""
    states = ForwardStates(vocabulary)
    return {word: states.advance(word) for word in sorted(words)}


def marked_words(text: str) -> list[str]:
    return MARKED_WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of ids; runs of byte pieces are read as UTF-8, broken ones as U+FFFD."""
    get = vocabulary.bytes_of.get
    data = b"".join([get(i, b"") for i in ids])
    return data.decode(errors="replace").replace(MARK, " ").removeprefix(" ")


def _replaced(df: DataFrame, source: str, name: str, kind: T.DataType):
    kept = in_small_batches(df.drop(name) if name != source else df)
    return kept, T.StructType([*(f for f in kept.schema if f.name != name),
                               T.StructField(name, kind)])


def encode_texts(df: DataFrame, model: str, text: str = "text", name: str = "ids",
                 round_trip: str | None = None) -> DataFrame:
    """``df`` with the piece ids of ``text`` as ``name`` (array of int); no shuffle.

    ``model`` is a SentencePiece model file; its pieces, a bounded table, go to the executors.
    ``round_trip`` names a further column: whether decoding the ids gives the text.
    """
    if name == text or round_trip in (text, name):
        raise ValueError("the results need columns of their own")
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    base = df if round_trip is None else df.drop(round_trip)
    kept, schema = _replaced(base, text, name, T.ArrayType(T.IntegerType()))
    if round_trip is not None:
        schema = schema.add(round_trip, T.BooleanType())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        known = vocabulary.known  # lives as long as the Python worker
        for batch in chain.from_iterable(pieces(b, text, STEP_BYTES) for b in batches):
            texts = batch.column(text).to_pylist()
            words = [marked_words(t) if t is not None else None for t in texts]
            known.learn(set().union(*filter(None, words)), vocabulary)
            values, offsets = known.ids([w or [] for w in words])
            missing = pa.array([w is None for w in words], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=missing)
            columns = [*batch.columns, ids]
            if round_trip is not None:
                columns.append(pa.array([
                    t is None or decode(values[a:b].tolist(), vocabulary) == t.replace(MARK, " ")
                    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(encode, schema)


def decode_ids(df: DataFrame, model: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``df`` with the text of ``ids`` as ``name``; null ids give null."""
    if name == ids:
        raise ValueError("the text needs a column of its own")
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kept, schema = _replaced(df, ids, name, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            texts = pa.array([None if i is None else decode(i, vocabulary)
                              for i in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts],
                                             names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def encoded_documents(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (the ids decode to the text) of every document."""
    encoded = encode_texts(documents.select("doc_id", "text"), model, round_trip="round_trip")
    count = F.coalesce(F.size("ids"), F.lit(0)).cast("long")
    return encoded.select("doc_id", count.alias("n_tokens"), "ids", "round_trip")
