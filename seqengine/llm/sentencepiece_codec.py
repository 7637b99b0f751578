"""SentencePiece encoding and decoding by best score (operator 3).

An Aho-Corasick automaton over the pieces reads a text once; at each position
its output links give every piece that ends there, and each relaxes the best
score of that position.  The path back gives the ids.  Scores are those of the
model file, as exact integers or floats; links come longest first and on a tie the longest piece
stays.  A
character that is no piece costs the model's lowest score less 10 and becomes
its UTF-8 byte pieces, so decoding is lossless (U+2581 reads back as a space).

No piece has the space mark after another character, so a text is encoded a
word at a time, and a bounded cache of words changes speed alone.  A task empties
it at its end, as the worker process lives on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqengine.llm.shared import freeing

MARK = "▁"
UNKNOWN_PENALTY = 10
CACHE_WORDS = 300_000
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    """Pieces of a model as (piece, score, id), with an id for each byte, to encode and decode."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int], controls: dict[int, str] | None = None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score, i in pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s, _ in pieces), default=0) - UNKNOWN_PENALTY
        self.byte_ids = byte_ids
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _, _ in pieces)
        self.raw = {i: p.replace(MARK, " ").encode() for p, _, i in pieces} | {x: bytes([b]) for b, x in enumerate(byte_ids)}
        for i in controls or {}:
            self.raw.setdefault(i, b"")
        self.known: dict[str, bytes] = {}

    @classmethod
    @lru_cache(2)
    def load(cls, path: str) -> Codec:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_of, controls = [], {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_of[int(piece[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                controls[i] = piece
            else:
                score = model.get_score(i)
                pieces.append((piece, int(score) if score == int(score) else score, i))
        if len(bytes_of) != 256:
            raise ValueError("the model has no byte pieces")
        return cls(pieces, [bytes_of[b] for b in range(256)], controls)

    @classmethod
    @contextmanager
    def of_task(cls, path: str) -> Iterator[Codec]:
        """The codec of a model, without its words at the end."""
        codec = cls.load(path)
        try:
            yield codec
        finally:
            codec.known.clear()

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best-scoring segmentation of a marked text."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        odd = set(text) - self.single
        done = 0
        for last, (length, score, piece) in self.automaton.iter(text):
            end = last + 1
            if odd and end > done + 1:
                self._unknown(text, odd, best, back, done + 1, end - 1)
            start = end - length
            if best[start] is not None:
                total = best[start] + score
                if best[end] is None or total > best[end]:
                    best[end], back[end] = total, (start, piece)
            if odd and end > done:
                # A piece may end at a character that is no piece itself.
                done = end - 1
        if odd:
            self._unknown(text, odd, best, back, done + 1, n)
        out: list[int] = []
        while n:
            start, piece = back[n]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(text[start:n].encode("utf-8", "surrogatepass"))]
            n = start
        return out[::-1]

    def _unknown(self, text: str, odd: set[str], best: list, back: list, first: int, last: int) -> None:
        """Relax positions first..last by the unknown character before each; a tie keeps the piece."""
        for end in range(first, last + 1):
            if text[end - 1] in odd and best[end - 1] is not None:
                total = best[end - 1] + self.unknown
                if best[end] is None or total > best[end]:
                    best[end], back[end] = total, (end - 1, -1)

    def _word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = np.array(self.viterbi(MARK + word), "<i4").tobytes()
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without control ids; an empty text has none."""
        if not text:
            return np.zeros(0, "<i4")
        if not self.by_word:
            return np.array(self.viterbi(MARK + text.replace(" ", MARK)), "<i4")
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            words = [c[1:] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        known, word = self.known, self._word
        return np.frombuffer(b"".join([known.get(w) or word(w) for w in words]), "<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts first is taken away."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode_column(documents: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """documents with a column of the ids of its text; a null text has no ids.

    Other columns stay, but one that is named `ids` already is replaced.
    """
    documents = documents.drop(ids)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from seqengine.llm.wordhash import batches

        with Codec.of_task(model) as codec:
            for batch in batches(stream, text):
                found = [codec.encode(x or "") for x in batch.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, values)], [*batch.schema.names, ids])

    schema = T.StructType([*documents.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return documents.mapInArrow(freeing(run), schema)


def _checked(model: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from seqengine.llm.wordhash import batches

        with Codec.of_task(model) as codec:
            for batch in batches(stream):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                found = [codec.encode(x) for x in texts]
                same = [codec.decode(ids.tolist()) == x for ids, x in zip(found, texts)]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
                more = [pa.ListArray.from_arrays(ends, values), pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "ids", "n_tokens", "lossless"])

    return run


def encode_checked(documents: DataFrame, model: str) -> DataFrame:
    """documents with ids (array of int), n_tokens and lossless: whether the ids decode to the text.

    A text that holds the model's own space mark, U+2581, comes back with a
    space in its place and isn't lossless.  Columns that have these names already are replaced; a null text is empty.
    """
    documents = documents.drop("ids", "n_tokens", "lossless")
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())]
    return documents.mapInArrow(freeing(_checked(model)), T.StructType([*documents.schema.fields, *more]))


def decode_digests(encoded: DataFrame, model: str) -> DataFrame:
    """Of doc_id, text and ids: number and crc32 of the ids, and the decoded text's size, sha256 and whether it is the text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        codec = Codec.load(model)
        for batch in stream:
            values = batch.column(2)
            ends = np.asarray(values.offsets)
            flat = values.values.to_numpy(zero_copy_only=False)
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = flat[ends[i] : ends[i + 1]]
                back = codec.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(ids.astype("<i4").tobytes()), len(back), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == (text or "")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["row", "n_tokens", "ids_crc32", "decoded_chars", "decoded_sha256", "lossless"])

    columns = encoded.select("doc_id", F.col("text").cast("string").alias("text"), "ids")
    kind = columns.schema["doc_id"].dataType.simpleString()
    return columns.mapInArrow(run, f"row {kind}, n_tokens long, ids_crc32 long, decoded_chars long, decoded_sha256 string, lossless boolean").withColumnRenamed("row", "doc_id")
