"""Vocabulary learning: characters, bigrams, byte pairs and unigrams.

Each fit takes labels, a DataFrame of (group..., label), and returns rows
(group..., token_id, token), so one job fits every fold.  Statistics come from
the labels given alone: fit on the training part of a fold and apply to the rest.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAD = "<PAD>"


def char_vocab(labels: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The caller's category list; a token's place is its id."""
    return labels.sparkSession.createDataFrame(list(enumerate(categories)), "token_id int, token string")


def alphabet(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Distinct characters of the labels of each group."""
    return labels.select(*group, F.explode(F.split("label", "")).alias("token")).where("token <> ''").distinct()


def bigram_counts(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Overlapping bigrams over distinct labels: group..., bigram, count."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("label") - 1), lambda i: F.substring(F.col("label"), i, F.lit(2)))
    distinct = labels.select(*group, "label").distinct().where(F.length("label") > 1)
    return distinct.select(*group, F.explode(pairs).alias("bigram")).groupBy(*group, "bigram").agg(F.count("*").alias("count"))


def bigram_vocab(labels: DataFrame, group: Sequence[str], size: int | None = None, top: int | None = None, categories: Sequence[str] | None = None, blank: bool = True) -> DataFrame:
    """Characters in code point order, then the most frequent bigrams; a tie takes the smaller one.

    Characters are `categories` or those of the labels, with '' first if
    `blank`.  Either `size`, the vocabulary's, or `top`, the number of bigrams.
    """
    spark = labels.sparkSession
    if categories is not None:
        known = spark.createDataFrame([(c,) for c in sorted(set(categories))], "token string")
        letters = labels.select(*group).distinct().crossJoin(F.broadcast(known)) if group else known
        if size is not None and size <= len(set(categories)):
            raise ValueError("the vocabulary must be larger than the alphabet")
    else:
        letters = alphabet(labels, group)
        if blank:
            letters = letters.unionByName(labels.select(*group).distinct().withColumn("token", F.lit(""))) if group else letters.unionByName(spark.createDataFrame([("",)], "token string"))
    by = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    letters = letters.withColumn("rank", F.row_number().over(by.orderBy("token"))).withColumn("section", F.lit(0))
    counts = bigram_counts(labels, group).withColumn("rank", F.row_number().over(by.orderBy(F.desc("count"), "bigram")))
    if top is not None:
        chosen = counts.where(F.col("rank") <= top)
    elif group:
        room = letters.groupBy(*group).agg((F.lit(size) - F.count("*")).alias("room"))
        chosen = counts.join(F.broadcast(room), list(group)).where("rank <= room")
    else:
        chosen = counts.where(F.col("rank") <= size - letters.count())
    both = letters.select(*group, "section", "rank", "token").unionByName(chosen.select(*group, F.lit(1).alias("section"), "rank", F.col("bigram").alias("token")))
    return both.select(*group, (F.row_number().over(by.orderBy("section", "rank")) - 1).alias("token_id"), "token")


def vocab_sizes(labels: DataFrame, group: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """Bigram vocabularies of several sizes from one count: group..., size, tokens, bigrams."""
    by = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    letters = alphabet(labels, group).groupBy(*group).agg((F.count("*") + 1).alias("letters"))
    available = bigram_counts(labels, group).groupBy(*group).agg(F.count("*").alias("available"))
    both = letters.join(available, list(group)) if group else letters.crossJoin(available)
    wide = both.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    bigrams = F.greatest(F.lit(0), F.least(F.col("size") - F.col("letters"), F.col("available")))
    return wide.select(*group, "size", bigrams.alias("bigrams"), (F.col("letters") + bigrams).alias("tokens"))


def word_frequencies(labels: DataFrame) -> DataFrame:
    """Words and marks of distinct labels with their frequency, as the whitespace pre-tokenizer cuts them."""
    parts = F.regexp_extract_all("label", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))
    return labels.select("label").distinct().select(F.explode(parts).alias("word")).groupBy("word").agg(F.count("*").alias("frequency"))


def fit_bpe(labels: DataFrame, size: int, categories: Sequence[str] = (), limit: int = 2_000_000) -> tuple[list[str], list[tuple[str, str]]]:
    """Byte-pair tokens in id order and the merges, from distinct labels.

    Ids are <PAD>, the characters by code point, then the merges.  Each round
    merges the most frequent pair, the smallest ids on a tie, until `size`
    tokens or no pair is left.  The word table, not the corpus, comes to the
    driver; over `limit` distinct words it raises.
    """
    rows = word_frequencies(labels).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} distinct words")
    return bpe_merges({r["word"]: r["frequency"] for r in rows}, size, categories)


def bpe_merges(frequency: dict[str, int], size: int, categories: Sequence[str] = ()) -> tuple[list[str], list[tuple[str, str]]]:
    """The rounds of fit_bpe over a word table; only words that hold the merged pair are counted again."""
    letters = sorted({c for w in frequency for c in w} | {c for c in categories if len(c) == 1})
    tokens = [PAD, *letters]
    ids = {t: i for i, t in enumerate(tokens)}
    spelled = [[ids[c] for c in w] for w in frequency]
    weight = list(frequency.values())
    count: Counter = Counter()
    where: defaultdict = defaultdict(set)
    for k, word in enumerate(spelled):
        for pair in zip(word, word[1:]):
            count[pair] += weight[k]
            where[pair].add(k)
    merges: list[tuple[str, str]] = []
    heap = [(-n, pair) for pair, n in count.items()]
    heapify(heap)
    while len(tokens) < size:
        while heap and -heap[0][0] != count.get(heap[0][1], 0):
            heappop(heap)  # its count has changed since
        if not heap or not heap[0][0]:
            break
        pair = heappop(heap)[1]
        text = tokens[pair[0]] + tokens[pair[1]]
        merges.append((tokens[pair[0]], tokens[pair[1]]))
        new = ids.get(text)
        if new is None:
            new = ids[text] = len(tokens)
            tokens.append(text)
        changed: set[tuple[int, int]] = set()
        for k in list(where.pop(pair, ())):
            word = spelled[k]
            for old in zip(word, word[1:]):
                count[old] -= weight[k]
                changed.add(old)
            spelled[k] = word = merged(word, pair, new)
            for now in zip(word, word[1:]):
                count[now] += weight[k]
                where[now].add(k)
                changed.add(now)
        count.pop(pair, None)
        for other in changed - {pair}:
            if count[other] > 0:
                heappush(heap, (-count[other], other))
    return tokens, merges


def merged(word: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """A word with each occurrence of a pair, from the left, replaced."""
    out, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and (word[i], word[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


def fit_unigram(labels: DataFrame, size: int, categories: Sequence[str] = (), rounds: int = 4, longest: int = 8, limit: int = 2_000_000) -> list[tuple[str, float]]:
    """Unigram pieces with log-probabilities, best first, after <PAD> and within `size`.

    Substrings of words up to `longest` characters start the vocabulary; each
    round re-estimates counts on best segmentations and drops the pieces whose
    loss, count times the score gained over their own best split, is smallest.
    Characters always stay.
    """
    from seqengine.operators.encode import viterbi

    rows = word_frequencies(labels).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} distinct words")
    frequency = {r["word"]: r["frequency"] for r in rows}
    letters = {c for w in frequency for c in w} | {c for c in categories if len(c) == 1}
    count: Counter = Counter({c: 1 for c in letters})
    for word, n in frequency.items():
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + longest) + 1):
                count[word[i:j]] += n
    room = max(1, size - 1)
    count = Counter({t: n for t, n in count.items() if len(t) == 1 or n > 1})
    keep = max(room * 10, len(letters))
    ranked = sorted(count, key=lambda t: (len(t) > 1, -count[t] * len(t), t))
    pieces = {t: count[t] for t in ranked[:keep]}
    for turn in range(rounds):
        scores = _log_shares(pieces)
        used: Counter = Counter({c: 1 for c in letters})
        for word, n in frequency.items():
            for piece in viterbi(word, scores):
                used[piece] += n
        scores = _log_shares(used)
        loss = {}
        for piece, n in used.items():
            if len(piece) > 1:
                apart = viterbi(piece, {t: s for t, s in scores.items() if t != piece})
                loss[piece] = n * (scores[piece] - sum(scores[t] for t in apart))
        final = turn + 1 == rounds
        target = max(room - len(letters), 0) if final else max(room - len(letters), int(len(loss) * 0.6))
        stay = sorted(loss, key=lambda t: (-loss[t], t))[:target]
        pieces = {t: used[t] for t in (*letters, *stay)}
    scores = _log_shares(pieces)
    return [(PAD, 0.0), *sorted(scores.items(), key=lambda x: (-x[1], x[0]))]


def _log_shares(count: dict[str, int]) -> dict[str, float]:
    from math import log

    total = sum(count.values())
    return {t: log(n / total) for t, n in count.items()}


def sweep(labels: DataFrame, sizes: Sequence[int], categories: Sequence[str] = (), kinds: Sequence[str] = ("bigram", "bpe", "unigram")) -> DataFrame:
    """Vocabularies of every kind and size of one fold's labels: tokenizer, size, token_id, token.

    Bigrams and words are counted once; a smaller byte-pair vocabulary is the
    beginning of the largest one.
    """
    spark, out = labels.sparkSession, []
    letters = sorted(set(categories)) or ["", *sorted(r[0] for r in alphabet(labels).collect())]
    if "bigram" in kinds:
        room = max(sizes) - len(letters)
        counts = [r["bigram"] for r in bigram_counts(labels).orderBy(F.desc("count"), "bigram").limit(max(room, 0)).collect()]
        out += [("bigram", n, k, t) for n in sizes for k, t in enumerate([*letters, *counts[: max(n - len(letters), 0)]])]
    if "bpe" in kinds:
        tokens, _ = fit_bpe(labels, max(sizes), categories)
        base = 1 + len({c for c in tokens[1:] if len(c) == 1})
        out += [("bpe", n, k, t) for n in sizes for k, t in enumerate(tokens[: max(n, base)])]
    if "unigram" in kinds:
        out += [("unigram", n, k, t) for n in sizes for k, (t, _) in enumerate(fit_unigram(labels, n, categories))]
    return spark.createDataFrame(out, "tokenizer string, size int, token_id int, token string")
