"""Vocabularies and encoders: fixtures, round trips and the library as a differential."""

import pytest
from pyspark.sql import functions as F

from seqengine.operators import encode as E
from seqengine.operators import planned as D
from seqengine.operators import vocab as V

WORDS = ["hello", "the cat", "then", "theme", "cat", "straße", "abc def", ""]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "label string")


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_bigram_counts_use_distinct_labels(spark):
    rows = spark.createDataFrame([("hello",), ("hello",), ("",), ("a",)], "label string")
    assert {r["bigram"]: r["count"] for r in V.bigram_counts(rows).collect()} == {"he": 1, "el": 1, "ll": 1, "lo": 1}


def test_greedy_bigrams(spark):
    tokens = ["", "t", "h", "e", "x", "th", "he"]
    df = spark.createDataFrame([("thethx",), ("",), (None,)], "s string")
    out = values(df, E.encode_greedy(F.col("s"), tokens))
    assert [tokens[i] for i in out[0]] == ["th", "e", "th", "x"]
    assert out[1] == []


@pytest.mark.parametrize("encoder", [E.encode_chars, E.encode_greedy])
def test_unknown_character_raises(spark, encoder):
    df = spark.createDataFrame([("a?",)], "s string")
    with pytest.raises(Exception, match="unknown token"):
        df.select(encoder(F.col("s"), ["", "a"])).collect()


@pytest.mark.parametrize("name", ["char", "bigram"])
def test_round_trip(spark, labels, name):
    letters = ["", *sorted({c for w in WORDS for c in w})]
    tokenizer = E.get_tokenizer(name).train(labels, letters, len(letters) + 5)
    back = tokenizer.decode(tokenizer.encode(F.col("label")))
    assert labels.where(back != F.col("label")).count() == 0
    assert tokenizer.size == len(letters) + (5 if name == "bigram" else 0)


def test_vocabulary_must_exceed_alphabet(spark, labels):
    with pytest.raises(ValueError):
        V.bigram_vocab(labels, (), size=3, categories=["", "a", "b"])


def test_factory_and_untrained():
    with pytest.raises(ValueError):
        E.get_tokenizer("embed")
    with pytest.raises(ValueError):
        E.get_tokenizer("char").size


@pytest.mark.parametrize("size", [20, 30, 60])
def test_bpe_equals_the_library(spark, labels, size):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    tokens, merges = V.fit_bpe(labels, size)
    ours = Tokenizer(models.BPE())
    ours.pre_tokenizer = pre_tokenizers.Whitespace()
    ours.decoder = decoders.BPEDecoder()
    ours.train_from_iterator([w for w in WORDS if w], trainers.BpeTrainer(vocab_size=size, min_frequency=1, special_tokens=["<PAD>"]))
    assert {t: i for i, t in enumerate(tokens)} == ours.get_vocab()
    out = values(labels, E.encode_bpe(F.col("label"), tokens, merges))
    assert out == [ours.encode(w).ids for w in WORDS]


def test_bpe_drops_unknown_and_spaces(spark, labels):
    tokens, merges = V.fit_bpe(labels, 40)
    df = spark.createDataFrame([("abc def",), ("a?c",)], "s string")
    assert values(df, E.decode_ids(E.encode_bpe(F.col("s"), tokens, merges), tokens, (0,))) == ["abcdef", "ac"]


def test_unigram(spark, labels):
    pieces = V.fit_unigram(labels, 30)
    assert pieces[0][0] == V.PAD and len(pieces) <= 30
    tokens = [t for t, _ in pieces]
    assert values(labels, E.decode_ids(E.encode_unigram(F.col("label"), pieces), tokens, (0,))) == [w.replace(" ", "") for w in WORDS]
    with pytest.raises(Exception, match="no pieces"):
        spark.createDataFrame([("Q",)], "s string").select(E.encode_unigram(F.col("s"), pieces)).collect()


def test_viterbi_is_best():
    from itertools import product

    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -1.2, "aba": -3.4}
    for word in map("".join, product("ab", repeat=5)):
        def splits(w):
            return [[]] if not w else [[w[:k], *s] for k in range(1, len(w) + 1) if w[:k] in scores for s in splits(w[k:])]

        best = max(sum(scores[p] for p in s) for s in splits(word))
        assert sum(scores[p] for p in E.viterbi(word, scores)) == pytest.approx(best)


def test_longest_match(spark):
    tokens = ["", "t", "h", "e", "th", "the"]
    df = spark.createDataFrame([("thet",)], "s string")
    assert values(df, E.longest_match(F.col("s"), tokens)) == [[5, 1]]


def test_motion_vocabularies():
    tokens, merges = D.motion_merges({"abab": 3, "cd": 5}, {"ab": 0.9, "cd": 0.1, "ba": 0.2}, 8)
    assert merges[0] == ("a", "b") and len(tokens) <= 8
    assert D.motion_merges({"ab": 1}, {}, 10)[1] == []
    kept = D.motion_unigram([(V.PAD, 0.0), ("a", -1.0), ("b", -1.0), ("ab", -0.5), ("ba", -0.1)], {"ab": 0.9}, 1.0, 4)
    assert [t for t, _ in kept] == [V.PAD, "a", "b", "ab"]
