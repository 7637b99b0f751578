"""Encoding and decoding with learned vocabularies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqengine.functions.scalars import chars
from seqengine.operators import vocab as V
from seqengine.sources import io


def _lookup(tokens: Sequence[str]) -> Column:
    return F.create_map(*[F.lit(x) for i, t in enumerate(tokens) for x in (t, i)])


def _known(found: Column, token: Column) -> Column:
    """The id, or an error that names the unknown token."""
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown token: "), token)).cast("int"))


def encode_chars(text: Column, tokens: Sequence[str]) -> Column:
    """Ids of the characters; an unknown one raises."""
    ids = _lookup(tokens)
    return F.transform(chars(text), lambda c: _known(F.try_element_at(ids, c), c))


def decode_ids(ids: Column, tokens: Sequence[str], skip: Sequence[int] = ()) -> Column:
    """The tokens of ids joined; `skip` ids vanish, others out of range raise."""
    table = F.array(*map(F.lit, tokens))
    kept = F.filter(ids, lambda i: ~i.isin(list(skip))) if skip else ids
    return F.array_join(F.transform(kept, lambda i: F.element_at(table, (i + 1).cast("int"))), "")


def encode_greedy(text: Column, tokens: Sequence[str]) -> Column:
    """From the left the known pair, else the single character, which raises if unknown.

    A fold over the characters keeps the last one open until the next decides.
    """
    ids = _lookup(tokens)
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<int>").alias("ids"))

    def step(state: Column, c: Column) -> Column:
        pair = F.try_element_at(ids, F.concat(state["open"], c))
        paired = (state["open"] != "") & pair.isNotNull()
        single = _known(F.try_element_at(ids, state["open"]), state["open"])
        return F.when(paired, F.struct(F.lit("").alias("open"), F.concat(state["ids"], F.array(pair)).alias("ids"))).otherwise(
            F.struct(c.alias("open"), F.when(state["open"] == "", state["ids"]).otherwise(F.concat(state["ids"], F.array(single))).alias("ids"))
        )

    last = lambda s: F.when(s["open"] == "", s["ids"]).otherwise(F.concat(s["ids"], F.array(_known(F.try_element_at(ids, s["open"]), s["open"]))))
    return F.aggregate(chars(text), start, step, last)


def longest_match(text: Column, tokens: Sequence[str]) -> Column:
    """From the left always the longest known token; what starts none raises."""
    known = {t: i for i, t in enumerate(tokens) if t}
    longest = max(map(len, known), default=1)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(column: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[int] | None:
            if text is None:
                return None
            out, i = [], 0
            while i < len(text):
                j = next((j for j in range(min(len(text), i + longest), i, -1) if text[i:j] in known), None)
                if j is None:
                    raise KeyError(text[i])
                out.append(known[text[i:j]])
                i = j
            return out

        return column.map(one)

    return encode(text)


def viterbi(word: str, scores: dict[str, float], longest: int = 16) -> list[str]:
    """The pieces of the best-scoring segmentation; raises if there is none."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], s) for s in range(max(0, end - longest), end) if word[s:end] in scores and best[s][0] != float("-inf")]
        best.append(max(options, key=lambda o: (o[0], -o[1]), default=(float("-inf"), 0)))
    if best[-1][0] == float("-inf"):
        raise ValueError(f"no pieces for {word!r}")
    out, end = [], len(word)
    while end:
        out.append(word[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def _arrow_encoder(pieces: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """A column function that cuts labels into words and marks and encodes each once a batch."""
    import regex

    cut = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(column: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}

        def one(text: str | None) -> list[int] | None:
            if text is None:
                return None
            out: list[int] = []
            for word in cut.findall(text):
                if word not in known:
                    known[word] = pieces(word)
                out += known[word]
            return out

        return column.map(one)

    return encode


def encode_bpe(text: Column, tokens: Sequence[str], merges: Sequence[tuple[str, str]]) -> Column:
    """Ids after the merges in rank order; unknown characters vanish."""
    ids = {t: i for i, t in enumerate(tokens)}
    rank = {(ids[a], ids[b]): (k, ids[a + b]) for k, (a, b) in reversed(list(enumerate(merges)))}

    def pieces(word: str) -> list[int]:
        spelled = [ids[c] for c in word if c in ids]
        while True:
            best = min(((rank[p][0], p) for p in zip(spelled, spelled[1:]) if p in rank), default=None)
            if best is None:
                return spelled
            spelled = V.merged(spelled, best[1], rank[best[1]][1])

    return _arrow_encoder(pieces)(text)


def encode_unigram(text: Column, pieces: Sequence[tuple[str, float]]) -> Column:
    """Ids of the best-scoring segmentation of each word; an unknown character raises."""
    ids = {t: i for i, (t, _) in enumerate(pieces)}
    scores = {t: s for t, s in pieces if t != V.PAD}
    return _arrow_encoder(lambda word: [ids[t] for t in viterbi(word, scores)])(text)


class Tokenizer(Protocol):
    """What every tokenizer offers: learn, size, and column encode and decode."""

    def train(self, labels: DataFrame, categories: Sequence[str], size: int) -> Tokenizer: ...
    @property
    def size(self) -> int: ...
    def encode(self, text: Column) -> Column: ...
    def decode(self, ids: Column) -> Column: ...


class _Base:
    skip: tuple[int, ...] = ()

    def __init__(self, tokens: Sequence[str] = ()):
        self.tokens = list(tokens)

    def _ready(self) -> list[str]:
        if not self.tokens:
            raise ValueError("the tokenizer is not trained or loaded")
        return self.tokens

    @property
    def size(self) -> int:
        return len(self._ready())

    def decode(self, ids: Column) -> Column:
        return decode_ids(ids, self._ready(), self.skip)


class CharTokenizer(_Base):
    def train(self, labels: DataFrame, categories: Sequence[str], size: int = 0) -> CharTokenizer:
        self.tokens = list(categories)
        return self

    def encode(self, text: Column) -> Column:
        return encode_chars(text, self._ready())


class BigramTokenizer(_Base):
    def train(self, labels: DataFrame, categories: Sequence[str], size: int = 200) -> BigramTokenizer:
        rows = V.bigram_vocab(labels, (), size=size, categories=categories).orderBy("token_id").collect()
        self.tokens = [r["token"] for r in rows]
        return self

    def encode(self, text: Column) -> Column:
        return encode_greedy(text, self._ready())


class BpeTokenizer(_Base):
    skip = (0,)
    merges: list[tuple[str, str]] = []

    def train(self, labels: DataFrame, categories: Sequence[str], size: int = 200) -> BpeTokenizer:
        self.tokens, self.merges = V.fit_bpe(labels, size, categories)
        return self

    def save(self, path: str) -> None:
        io.save_bpe(self._ready(), self.merges, path)

    def load(self, path: str) -> BpeTokenizer:
        kind, self.tokens, self.merges = io.load_tokenizer(path)
        if kind != "bpe":
            raise ValueError(f"not a byte-pair file: {path}")
        return self

    def encode(self, text: Column) -> Column:
        return encode_bpe(text, self._ready(), self.merges)


class UnigramTokenizer(_Base):
    skip = (0,)
    pieces: list[tuple[str, float]] = []

    def train(self, labels: DataFrame, categories: Sequence[str], size: int = 200) -> UnigramTokenizer:
        self.pieces = V.fit_unigram(labels, size, categories)
        self.tokens = [t for t, _ in self.pieces]
        return self

    def save(self, path: str) -> None:
        self._ready()
        io.save_unigram(self.pieces, path)

    def load(self, path: str) -> UnigramTokenizer:
        kind, self.tokens, self.pieces = io.load_tokenizer(path)
        if kind != "unigram":
            raise ValueError(f"not a unigram file: {path}")
        return self

    def encode(self, text: Column) -> Column:
        self._ready()
        return encode_unigram(text, self.pieces)


TOKENIZERS = {"char": CharTokenizer, "bigram": BigramTokenizer, "bpe": BpeTokenizer, "unigram": UnigramTokenizer}


def get_tokenizer(name: str) -> Tokenizer:
    """A new tokenizer by name: char, bigram, bpe or unigram."""
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer: {name}")
    return TOKENIZERS[name]()
