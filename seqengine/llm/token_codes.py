"""Token ids in directly addressable codes (operator 4).

An id is cut into 8-bit chunks.  Level 0 holds the low chunk of every id; a
bitmap says which ids continue, and level 1 holds the next chunk of just these,
and so on.  A rank directory counts the bits before every 512-bit block, so
token i is found by one rank a level, without decoding its neighbours.

A segment is one self-contained byte string:
    magic "DAC1", u32 levels, u64 tokens, then for each level u64 entries,
    the chunks, and unless it is the last the bitmap and its directory.
Segments are rows of a Parquet table in ascending order of document.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqengine.llm.shared import written

MAGIC = b"DAC1"
BLOCK_BITS = 512
SEGMENT_TOKENS = 1 << 20
CACHE_CHUNKS = 400_000
GATHER = 1 << 18  # chunks whose ids are put in their places at a time
_MARKS = frozenset(",.;:!?")
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def dac_encode(ids: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit ids."""
    rest = np.asarray(ids, np.uint32)
    parts: list[bytes] = []
    levels = 0
    while True:
        parts += [struct.pack("<Q", len(rest)), rest.astype(np.uint8).tobytes()]
        levels += 1
        more = rest > 255
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.uint32)
        parts += [bits.tobytes(), np.r_[np.uint32(0), np.cumsum(ones[:-1], dtype=np.uint32)].tobytes()]
        rest = rest[more] >> np.uint32(8)
    return MAGIC + struct.pack("<IQ", levels, len(ids)) + b"".join(parts)


class DacReader:
    """Random and bulk access to a segment, over its bytes as they are."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        count, self.tokens = struct.unpack_from("<IQ", data, 4)
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        at = 16
        for level in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if level + 1 < count:
                bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, np.uint32, (n + BLOCK_BITS - 1) // BLOCK_BITS, at)
                at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK_BITS * (BLOCK_BITS // 8)
            ones = int(np.bitwise_count(bits[first : i >> 3]).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[i // BLOCK_BITS]) + ones
            shift += 8
        return value

    def all(self) -> np.ndarray:
        value = self.levels[-1][0].astype(np.uint32)
        for chunks, bits, _ in reversed(self.levels[:-1]):
            low = chunks.astype(np.uint32)
            low[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= value << np.uint32(8)
            value = low
        return value


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return found


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones themselves, others from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b if b in plain else 256 + rest.index(b)) for b in range(256)}


class Aging(dict):
    """A bounded cache that learns what it is asked for.

    When it is full its entries become the older generation, from which those
    still asked for come back.
    """

    def __init__(self, size: int, learn: Callable[[str], bytes]):
        super().__init__()
        self.size, self.learn = size, learn
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.learn(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class ChunkEncoder:
    """Byte-level BPE of whole texts, by the library, a word at a time.

    The pre-tokenizer's pattern never crosses the place before a single space
    between two other characters, so a text cut there encodes as its chunks
    do.  A chunk is cut by the same pattern and the library's model encodes the
    words.  Bounded caches keep ids of chunks and words; they change speed alone.
    A text with a token that the file adds to the vocabulary, such as
    `<|endoftext|>`, is encoded by the library as a whole.
    """

    _cut = re.compile(r"(?<=\S)(?= \S)")
    #: Every character that the library or Python counts as white space.
    _blanks = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str, pattern: str, end: int):
        import regex

        self.whole = _tokenizer(path)
        self.model, self.end = self.whole.model, struct.pack("<I", end)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.letters = _byte_letters()
        self.space, self.tokenize = self.letters[32], self.model.tokenize
        self.find = regex.compile(pattern).findall
        self.first = Aging(CACHE_CHUNKS // 8, partial(self._chunk, ""))
        self.later = Aging(CACHE_CHUNKS, partial(self._chunk, " "))
        self.word = Aging(CACHE_CHUNKS, self._word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text with the end id."""
        out: list[bytes] = [b""] * len(texts)
        even = []
        for k, text in enumerate(texts):
            if any(t in text for t in self.added):
                ids = self.whole.encode(text, add_special_tokens=False).ids
                out[k] = struct.pack(f"<{len(ids)}I", *ids) + self.end
            elif self._uneven(text):
                head, *rest = self._cut.split(text)
                out[k] = self.first[head] + b"".join([self.later[c[1:]] for c in rest]) + self.end
            else:
                even.append(k)
        for k, code in zip(even, self._even([texts[k] for k in even])):
            out[k] = code + self.end
        return out

    def _even(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose spaces stand alone between other characters: each different chunk of them is looked up once."""
        if not texts:
            return []
        cut = [text.partition(" ") for text in texts]
        rest = pc.split_pattern(pa.array([r if space else None for _, space, r in cut], pa.large_string()), " ")
        chunks = rest.flatten().dictionary_encode()
        codes = [self.later[c] for c in chunks.dictionary.to_numpy(zero_copy_only=False)]
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        begin, data = np.cumsum(size) - size, np.frombuffer(b"".join(codes), "<u4")
        index = chunks.indices.to_numpy()
        parts = [np.zeros(0, "<u4")]
        for at in range(0, len(index), GATHER):
            part = index[at : at + GATHER]
            n = size[part]
            ends = np.cumsum(n)
            parts.append(data[np.repeat(begin[part] - ends + n, n) + np.arange(n.sum())])
        raw = memoryview(np.concatenate(parts)).cast("B")
        before = np.concatenate([[0], np.cumsum(size[index])]) * 4
        rows = before[np.concatenate([[0], np.cumsum(pc.list_value_length(rest).fill_null(0).to_numpy())])].tolist()
        return [self.first[head] + raw[i:j] for (head, _, _), i, j in zip(cut, rows, rows[1:])]

    def _uneven(self, text: str) -> bool:
        """Whether a space stands beside white space or at an end."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return True
        return any(b in text and (b + " " in text or " " + b in text) for b in (self._blanks if not text.isascii() else self._blanks[:9]))

    def _chunk(self, lead: str, chunk: str) -> bytes:
        # Letters alone, or before one mark, are what the pattern would find.
        if chunk.isalpha():
            return self.word[lead + chunk]
        if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            return self.word[lead + chunk[:-1]] + self.word[chunk[-1]]
        return b"".join([self.word[w] for w in self.find(lead + chunk)])

    def _word(self, word: str) -> bytes:
        letters = word[1:]
        if word[0] == " " and letters.isascii() and letters.isalpha():  # all but the space are written by themselves
            written = self.space + letters
        else:
            written = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(written)]
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[tuple[str, str, int], ChunkEncoder] = {}


def _pack(path: str, pattern: str, end: int):
    """Sorted documents to segments, each with the tokens of its partition before it."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from seqengine.llm.wordhash import batches

        encoder = _encoders.setdefault((path, pattern, end), ChunkEncoder(path, pattern, end))
        part = TaskContext.get().partitionId()
        docs: list[int | None] = []
        ids: list[bytes] = []
        held = number = before = 0

        def segment() -> pa.RecordBatch:
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            row = {
                "part": pa.array([part], pa.int32()),
                "segment": pa.array([number], pa.int64()),
                "before": pa.array([before], pa.int64()),
                "tokens": pa.array([int(sizes.sum())], pa.int64()),
                "docs": pa.array([docs], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "codes": pa.array([dac_encode(np.frombuffer(b"".join(ids), "<u4"))], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches(stream):
            docs_in = batch.column(0).to_pylist()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, code in zip(docs_in, encoder.encode(texts)):
                docs.append(doc)
                ids.append(code)
                held += len(code) // 4
                if held >= SEGMENT_TOKENS:
                    yield segment()
                    number, before = number + 1, before + held
                    docs, ids, held = [], [], 0
        if docs:
            yield segment()

    return run


SEGMENTS = "part int, segment long, before long, tokens long, docs array<bigint>, sizes array<bigint>, codes binary"


def token_segments(documents: DataFrame, tokenizer: str, pattern: str, end: int = 2) -> DataFrame:
    """Encode documents(doc_id, text) into a written table of token segments.

    `tokenizer` is the library's file of a byte-level BPE and `pattern` the one
    that cuts its words.  Documents are ordered by doc_id by a range exchange, nulls first; rows with
    equal doc_id by text.  A null text is empty and has just the end id.
    """
    ordered = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text"))
    return written(ordered.mapInArrow(_pack(tokenizer, pattern, end), SEGMENTS), "segments")


def _read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for row in batch.to_pylist():
            ids = DacReader(row["codes"]).all().astype("<u4")
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            raw = ids.tobytes()
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([row["part"]] * len(sizes), pa.int32()),
                    "doc_id": pa.array(row["docs"], pa.int64()),
                    "at": pa.array(row["before"] + ends - sizes, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the stored segments.

    Only a row a partition of the segment table is summed in order and
    broadcast; its number is that of the writing tasks, not of the documents.
    """
    totals = segments.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    base = totals.select("part", (F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).alias("base"))
    found = segments.mapInArrow(_read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
