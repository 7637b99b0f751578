"""Motion-aware segmentation: features at boundaries, continuity, pair statistics and vocabularies.

Statistics come from the rows given alone: pass a fold's training part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqengine.operators import vocab as V


def to_steps(frame: Column, ratio: int = 8) -> Column:
    """The recording step of a frame."""
    return frame * ratio


def confident(intervals: DataFrame, least: float) -> DataFrame:
    return intervals.where(F.col("confidence") >= least)


def boundary_features(steps: DataFrame, keys: Sequence[str], channels: Sequence[str], half_widths: Sequence[int] = (5, 10, 15), t: str = "t") -> DataFrame:
    """Mean and deviation of each channel in windows around each step (50, 100 and 150 ms at 100 Hz)."""
    out = steps
    for k in half_widths:
        by = W.partitionBy(*keys).orderBy(t).rowsBetween(-k, k)
        for c in channels:
            out = out.withColumn(f"{c}_mean_{k}", F.avg(c).over(by)).withColumn(f"{c}_std_{k}", F.stddev_pop(c).over(by))
    return out


def pauses(steps: DataFrame, keys: Sequence[str], channels: Sequence[str], half_widths: Sequence[int] = (5, 10, 15), t: str = "t", still: float = 1e-3) -> DataFrame:
    """The share of still steps in windows around each step: those whose channels all moved by at most `still` since the step before."""
    order = W.partitionBy(*keys).orderBy(t)
    quiet = F.lit(True)
    for c in channels:
        quiet &= F.abs(F.col(c) - F.coalesce(F.lag(c).over(order), F.col(c))) <= still
    out = steps.withColumn("__quiet", quiet.cast("double"))
    for k in half_widths:
        out = out.withColumn(f"pause_{k}", F.avg("__quiet").over(order.rowsBetween(-k, k)))
    return out.drop("__quiet")


def frame_similarity(frames: DataFrame, keys: Sequence[str], feature: str = "feature", t: str = "t", reach: int = 1) -> DataFrame:
    """Cosine similarity of each frame's encoder output with that `reach` frames later, null at the end and for zero vectors."""
    after = F.lead(feature, reach).over(W.partitionBy(*keys).orderBy(t))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    out = frames.withColumn("__after", after)
    norm = F.sqrt(dot(F.col(feature), F.col(feature)) * dot(F.col("__after"), F.col("__after")))
    return out.withColumn("similarity", F.when(norm > 0, dot(F.col(feature), F.col("__after")) / norm)).drop("__after")


def at_boundaries(boundaries: DataFrame, features: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Features of the steps where boundaries lie: an equi-join on recording and step."""
    return boundaries.join(features, [*keys, t])


def continuity(features: Sequence[Column], weights: Sequence[float]) -> Column:
    """The weighted mean of features in [0, 1], clipped to it."""
    total = sum(weights)
    score = sum((F.coalesce(f, F.lit(0.0)) * (w / total) for f, w in zip(features, weights)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def pair_statistics(pairs: DataFrame, pair: str = "pair", group: str = "writer", value: str = "score", times: str | None = None) -> DataFrame:
    """Count, group coverage, median and interquartile range of each pair.

    A row stands for one pair, or for as many as its column `times` has.  Equal
    (pair, group, value) rows are counted before the shuffle; one weighted
    percentile then reads the counts.
    """
    small = pairs.groupBy(pair, group, value).agg((F.sum(times) if times else F.count("*")).alias("n"))
    out = small.groupBy(pair).agg(F.sum("n").alias("count"), F.size(F.collect_set(group)).cast("long").alias("coverage"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    return out.select(pair, "count", "coverage", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def motion_bigrams(statistics: DataFrame, top: int, least_count: int = 1, least_coverage: int = 1, least_median: float = 0.0) -> DataFrame:
    """The `top` pairs by median continuity among those with enough support; ties by count, then pair."""
    usable = statistics.where((F.col("count") >= least_count) & (F.col("coverage") >= least_coverage) & (F.col("median") >= least_median))
    return usable.orderBy(F.desc("median"), F.desc("count"), "pair").limit(top).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("median"), F.desc("count"), "pair")))


def motion_merges(frequency: dict[str, int], continuity: dict[str, float], size: int) -> tuple[list[str], list[tuple[str, str]]]:
    """Byte-pair rounds in which a pair's score is its count times its weakest inner boundary.

    `continuity` has the score of each two-character boundary (0 if absent);
    ties take the larger count, then the smaller ids.
    """
    tokens = [V.PAD, *sorted({c for w in frequency for c in w})]
    ids = {t: i for i, t in enumerate(tokens)}
    words = [([ids[c] for c in w], n) for w, n in frequency.items()]
    merges: list[tuple[str, str]] = []
    while len(tokens) < size:
        count: dict[tuple[int, int], int] = {}
        for word, n in words:
            for p in zip(word, word[1:]):
                count[p] = count.get(p, 0) + n

        def weakest(pair: tuple[int, int]) -> float:
            text = tokens[pair[0]] + tokens[pair[1]]
            return min(continuity.get(text[k : k + 2], 0.0) for k in range(len(text) - 1))

        scored = [(-n * weakest(p), -n, p) for p, n in count.items()]
        best = min(scored, default=None)
        if best is None or best[0] >= 0:
            break
        pair = best[2]
        merges.append((tokens[pair[0]], tokens[pair[1]]))
        text = tokens[pair[0]] + tokens[pair[1]]
        if text not in ids:
            ids[text] = len(tokens)
            tokens.append(text)
        words = [(V.merged(w, pair, ids[text]), n) for w, n in words]
    return tokens, merges


def motion_unigram(pieces: Sequence[tuple[str, float]], continuity: dict[str, float], weight: float, size: int) -> list[tuple[str, float]]:
    """Unigram pieces rescored by `weight` times the log of their weakest inner boundary, the best `size` kept.

    Single characters stay.
    """
    from math import log

    def bonus(piece: str) -> float:
        inner = [continuity.get(piece[k : k + 2], 0.0) for k in range(len(piece) - 1)]
        return weight * log(max(min(inner), 1e-6)) if inner else 0.0

    scored = [(t, s if t == V.PAD else s + bonus(t)) for t, s in pieces]
    single = [x for x in scored if len(x[0]) == 1 or x[0] == V.PAD]
    rest = sorted((x for x in scored if x not in single), key=lambda x: (-x[1], x[0]))
    return single + rest[: max(0, size - len(single))]


def fit_motion_unigram(frequency: dict[str, int], pieces: Sequence[tuple[str, float]], continuity: dict[str, float], weight: float, size: int, rounds: int = 2) -> list[tuple[str, float]]:
    """Motion-aware unigram training: rescore, prune and re-estimate on the best segmentations, in turn.

    Each round rescores pieces by their weakest inner boundary, keeps a share of
    them that falls to `size`, segments every word by dynamic programming and
    counts pieces anew.  Single characters stay.
    """
    from collections import Counter

    from seqengine.operators.encode import viterbi

    now = list(pieces)
    for turn in range(rounds):
        target = size + (len(now) - size) * (rounds - 1 - turn) // rounds if len(now) > size else size
        scores = {t: s for t, s in motion_unigram(now, continuity, weight, target) if t != V.PAD}
        used: Counter = Counter({t: 1 for t in scores if len(t) == 1})
        for word, n in frequency.items():
            for piece in viterbi(word, scores):
                used[piece] += n
        shares = V._log_shares(used)
        now = [(V.PAD, 0.0), *sorted(shares.items(), key=lambda x: (-x[1], x[0]))]
    return now
