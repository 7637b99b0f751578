"""Recognition metrics, alignments and their summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqengine.functions.scalars import strip, word_points, words

EVENTS = ("equal", "substitute", "insert", "delete")


def edit_counts(pairs: DataFrame) -> DataFrame:
    """pairs(..., ref, hyp) with character and word edits and reference sizes, after stripping."""
    ref, hyp = strip(F.col("ref")), strip(F.col("hyp"))
    one, two = word_points(words(ref), words(hyp))
    return (
        pairs.withColumn("char_edits", F.levenshtein(ref, hyp))
        .withColumn("ref_chars", F.length(ref))
        .withColumn("word_edits", F.levenshtein(one, two))
        .withColumn("ref_words", F.size(words(ref)))
    )


def evaluate(pairs: DataFrame, group: Sequence[str] = (), distance: bool = True, cer: bool = True, wer: bool = True) -> DataFrame:
    """The four metrics of pairs(ref, hyp) for each group; those switched off are -1.

    Distance and sentence length are means a pair without stripping; the error
    rates are pooled, edits over reference size.
    """
    counted = edit_counts(pairs) if cer or wer else pairs
    off = F.lit(-1.0)
    rate = lambda a, b: F.sum(a).cast("double") / F.sum(b)
    return counted.groupBy(*group).agg(
        (F.avg(F.levenshtein("hyp", "ref")) if distance else off).alias("levenshtein_distance"),
        (F.avg(F.length("ref")) if distance else off).alias("average_sentence_length"),
        (rate("char_edits", "ref_chars") if cer else off).alias("character_error_rate"),
        (rate("word_edits", "ref_words") if wer else off).alias("word_error_rate"),
    )


def align(ref: str, hyp: str) -> list[tuple[str, int, int, int, int]]:
    """Chunks (event, ref first, ref end, hyp first, hyp end) of a least-cost alignment.

    From the end, a diagonal step comes before a deletion, and that before an
    insertion; neighbouring steps of one event are one chunk.  A row of costs is
    kept as the bits of its differences.
    """
    n, m = len(ref), len(hyp)
    places: dict[str, int] = {}
    for k, c in enumerate(hyp):
        places[c] = places.get(c, 0) | 1 << k
    # Bit k of a number is column k + 1 of a row of costs: `same` tells where a cost equals the diagonal one before, `more` where it is one above that of the row before.
    whole = (1 << m) - 1
    up, down, rows = whole, 0, []  # where a cost is one above, one below that of the column before
    for c in ref:
        there = places.get(c, 0)
        same = ((((there & up) + up) ^ up) | there | down) & whole
        less, more = up & same, down | whole & ~(up | same)
        rows.append((same, more))
        ahead = more << 1 | 1
        up, down = (less << 1 | ~(ahead | same)) & whole, ahead & same & whole
    steps = []
    i, j = n, m
    while i or j:
        same, more = rows[i - 1] if i else (0, 0)
        if i and j and (ref[i - 1] == hyp[j - 1] or not same >> j - 1 & 1):
            i, j = i - 1, j - 1
            steps.append(("equal" if ref[i] == hyp[j] else "substitute", i, i + 1, j, j + 1))
        elif i and (not j or more >> j - 1 & 1):
            i -= 1
            steps.append(("delete", i, i + 1, j, j))
        else:
            j -= 1
            steps.append(("insert", i, i, j, j + 1))
    out: list[tuple[str, int, int, int, int]] = []
    for event, a, b, c, d in reversed(steps):
        if out and out[-1][0] == event:
            out[-1] = (event, out[-1][1], b, out[-1][3], d)
        else:
            out.append((event, a, b, c, d))
    return out


def aligned(pairs: DataFrame) -> DataFrame:
    """Chunks of pairs(ref, hyp): event, ref_part, hyp_part; equal pairs are aligned once a batch."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in stream:
            known: dict[tuple[str, str], list] = {}
            out = []
            for pair in zip(rows["ref"], rows["hyp"]):
                if pair not in known:
                    known[pair] = [(e, pair[0][a:b], pair[1][c:d]) for e, a, b, c, d in align(*pair)]
                out += known[pair]
            yield pd.DataFrame(out, columns=["event", "ref_part", "hyp_part"])

    return pairs.select("ref", "hyp").where("ref is not null and hyp is not null").mapInPandas(run, "event string, ref_part string, hyp_part string")


def event_totals(chunks: DataFrame) -> DataFrame:
    """Characters an event: of the reference for deletions, else of the hypothesis."""
    size = F.when(F.col("event") == "delete", F.length("ref_part")).otherwise(F.length("hyp_part"))
    return chunks.groupBy("event").agg(F.sum(size).cast("long").alias("total"))


def substitutions(chunks: DataFrame, diagonal: bool = False) -> DataFrame:
    """Counts of (hyp, ref) character cells of substitute chunks.

    A chunk of k characters counts all k * k cells, or with `diagonal` its k
    aligned ones.
    """
    rows = chunks.where("event = 'substitute'")
    if diagonal:
        cells = rows.select(F.explode(F.arrays_zip(F.split("hyp_part", "").alias("hyp"), F.split("ref_part", "").alias("ref"))).alias("c")).select("c.*").toDF("hyp", "ref")
    else:
        cells = rows.select(F.explode(F.split("hyp_part", "")).alias("hyp"), "ref_part").select("hyp", F.explode(F.split("ref_part", "")).alias("ref"))
    return cells.groupBy("hyp", "ref").agg(F.count("*").alias("count"))


def substitution_rates(pairs: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Each substitution's count over its reference character's count; characters off the list raise."""
    counts = pairs.select(F.explode(F.split("ref", "")).alias("ref")).where("ref <> ''").groupBy("ref").agg(F.count("*").alias("ref_count"))
    cells = substitutions(aligned(pairs))
    if categories is not None:
        for c in ("hyp", "ref"):
            cells = cells.withColumn(c, F.when(F.col(c).isin(list(categories)), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("not a category: "), F.col(c)))))
    return cells.join(counts, "ref").select("hyp", "ref", "count", "ref_count", (F.col("count") / (F.col("ref_count") + 1e-9)).alias("rate"))


def best_epochs(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The first smallest value of each metric of metrics(keys..., epoch, metric, value), and its epoch."""
    return metrics.groupBy(*keys, "metric").agg(F.min(F.struct("value", "epoch")).alias("b")).select(*keys, "metric", F.col("b.epoch").alias("epoch"), F.col("b.value").alias("value"))


def running_best(metrics: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Whether each value is below all earlier ones."""
    before = F.min(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return metrics.withColumn("is_best", F.col(value).isNotNull() & (before.isNull() | (F.col(value) < before)))


def cross_validation(metrics: DataFrame, lead: str = "character_error_rate", others: Sequence[str] = ("word_error_rate",)) -> DataFrame:
    """Mean and population deviation over folds of each metric at its fold's best `lead` epoch."""
    best = best_epochs(metrics.where(F.col("metric") == lead), ["fold"]).select("fold", "epoch")
    chosen = metrics.where(F.col("metric").isin([lead, *others])).join(best, ["fold", "epoch"])
    return chosen.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("fold", "value")))).alias("raw"))


def token_histogram(tokens: DataFrame, blank: str | None = None) -> DataFrame:
    """Counts and shares of tokens(token), blanks left out after counting."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("count"))
    counts = counts if blank is None else counts.where(F.col("token") != blank)
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("token", "count", (F.col("count") / F.col("total")).alias("ratio"))


def length_shares(histogram: DataFrame) -> DataFrame:
    """Shares by token length."""
    return histogram.groupBy(F.length("token").alias("length")).agg(F.sum("ratio").alias("ratio"))


def share_summary(histogram: DataFrame) -> DataFrame:
    return histogram.agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("std"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both by key; new values win where they are not null."""
    values = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = a.join(b, same, "full")
    return joined.select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], *[F.coalesce(f"b.{v}", f"a.{v}").alias(v) for v in values])
