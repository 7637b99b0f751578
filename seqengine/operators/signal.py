"""Time-series transforms on recordings, in the long or the array layout.

Long: one row a step (keys..., t, value columns).  Array: one row a recording
(keys..., values), a value array for one channel or an array of rows for many.
Time is the step's place, from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqengine.operators.prep import dense_ids


def to_arrays(steps: DataFrame, keys: Sequence[str], channels: Sequence[str], t: str = "t") -> DataFrame:
    """Long to array layout: keys..., values (array of channel arrays in order of t)."""
    row = F.struct(F.col(t).alias("t"), F.array(*[F.col(c).cast("double") for c in channels]).alias("v"))
    return steps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["v"]).alias("values"))


def to_steps(arrays: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Array to long layout."""
    return arrays.select(*keys, F.posexplode("values").alias("t", "v")).select(*keys, "t", *[F.col("v")[k].alias(c) for k, c in enumerate(channels)])


def z_score(steps: DataFrame, keys: Sequence[str], channels: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """(x - mean) / (population deviation + eps) for each channel of each recording."""
    by = W.partitionBy(*keys)
    out = steps
    for c in channels:
        out = out.withColumn(c, (F.col(c) - F.avg(c).over(by)) / (F.stddev_pop(c).over(by) + eps))
    return out


def group_members(rows: DataFrame, group: str, member: str) -> DataFrame:
    """The sorted members of each group (one writer's recordings)."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(member)).alias("members"))


def concat_same_group(rows: DataFrame, group: str, member: str, count: int, pick: Column | None = None, seed: int = 0, chunk: Column | None = None) -> DataFrame:
    """For each row, `count` members of its own group drawn with replacement around itself.

    The first half of the draws, the row itself, then the rest: group, member,
    parts.  A draw k is the member whose place in order is `pick` plus k, or a
    hash of member, k and seed, modulo the group's size.  Every draw meets the
    one member of that place by an equi-join on group and place, so bytes grow
    with rows and draws, whatever a group's size.  `chunk` as in dense_ids.
    """
    placed = dense_ids(rows.select(group, member).distinct(), [group], [member], "__place", chunk)
    sizes = placed.groupBy(group).agg(F.count("*").alias("__n"))
    drawn = rows.select(group, member, *([pick.alias("__pick")] if pick is not None else [])).join(sizes, group).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count else None
    if drawn is None:
        return rows.select(group, member, F.array(member).alias("parts"))
    start = F.col("__pick") + F.col("__k") if pick is not None else F.xxhash64(F.col(member), F.col("__k"), F.lit(seed))
    drawn = drawn.withColumn("__place", F.pmod(start.cast("long"), F.col("__n")))
    other = placed.select(F.col(group), F.col("__place"), F.col(member).alias("__other"))
    met = drawn.join(other, [group, "__place"])
    parts = met.groupBy(group, member).agg(F.array_sort(F.collect_set(F.struct("__k", "__other"))).alias("d")).withColumn("d", F.transform("d", lambda x: x["__other"]))
    half = count // 2
    return parts.select(group, member, F.concat(F.slice("d", 1, half) if half else F.array().cast(f"array<{rows.schema[member].dataType.simpleString()}>"), F.array(member), F.slice("d", half + 1, count - half)).alias("parts"))


def cumulative(steps: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "total") -> DataFrame:
    by = W.partitionBy(*keys).orderBy(*order)
    return steps.withColumn(out, F.sum(value).over(by.rowsBetween(W.unboundedPreceding, 0)))


def from_baseline(steps: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "shift") -> DataFrame:
    """Value less the recording's first one."""
    by = W.partitionBy(*keys).orderBy(*order)
    return steps.withColumn(out, F.col(value) - F.first_value(value).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def forward_fill(steps: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, masked: Column, out: str = "filled") -> DataFrame:
    """Masked steps take the last unmasked value before them; leading ones stay as they are."""
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn(out, F.coalesce(F.last(F.when(~masked, F.col(value)), ignorenulls=True).over(by), F.col(value)))


def backward_fill(steps: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, masked: Column, out: str = "filled") -> DataFrame:
    """Masked steps take the first unmasked value after them; trailing ones stay as they are."""
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    return steps.withColumn(out, F.coalesce(F.first(F.when(~masked, F.col(value)), ignorenulls=True).over(by), F.col(value)))


def resample(steps: DataFrame, keys: Sequence[str], t: str, value: str, length: int) -> DataFrame:
    """Linear resampling of each recording to `length` steps: keys..., step, value.

    A target falls between two steps, which a window puts side by side, so each
    step makes the targets of its own interval and nothing is joined.
    """
    by = W.partitionBy(*keys)
    placed = steps.select(*keys, F.col(t).alias("__t"), F.col(value).alias("__v"), F.lead(value).over(by.orderBy(t)).alias("__w"), F.count("*").over(by).alias("__n"))
    scale = (F.col("__n") - 1) / (length - 1)
    targets = F.filter(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.least(F.floor(k * scale), F.greatest(F.col("__n") - 2, F.lit(0))) == F.col("__t"))
    rows = placed.withColumn("step", F.explode(targets)).withColumn("__f", F.col("step") * scale - F.col("__t"))
    return rows.select(*keys, "step", F.when(F.col("__w").isNull(), F.col("__v")).otherwise(F.col("__v") + F.col("__f") * (F.col("__w") - F.col("__v"))).alias("value"))


def batch_lengths(rows: DataFrame, order: Sequence[str], size: Column, batch: int, dense: str) -> DataFrame:
    """Batch number and the longest size of each batch, from a dense ordinal from 0."""
    numbered = rows.withColumn("batch", F.floor(F.col(dense) / batch).cast("long")).withColumn("__size", size)
    return numbered.withColumn("longest", F.max("__size").over(W.partitionBy("batch"))).drop("__size")


def collate(arrays: DataFrame, batch: int, dense: str, values: str = "values", ids: str = "ids") -> DataFrame:
    """Padded batches: batch, seqs (items, channels, time), labels (items, length) and both lengths.

    A batch is bounded by `batch` rows; lengths are those after earlier padding.
    """
    item = F.struct(F.col(dense).alias("i"), F.col(values).alias("v"), F.col(ids).alias("l"))
    rows = arrays.withColumn("batch", F.floor(F.col(dense) / batch).cast("long")).groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("time", F.expr("array_max(transform(items, x -> size(x.v)))")).withColumn("length", F.expr("array_max(transform(items, x -> size(x.l)))"))
    channel = "transform(sequence(0, size(x.v[0]) - 1), c -> transform(sequence(0, time - 1), t -> coalesce(get(get(x.v, t), c), 0D)))"
    return rows.select(
        "batch",
        F.expr(f"transform(items, x -> {channel})").alias("seqs"),
        F.expr("transform(items, x -> concat(x.l, array_repeat(0, length - size(x.l))))").alias("labels"),
        F.expr("transform(items, x -> cast(size(x.v) as bigint))").alias("lens_seq"),
        F.expr("transform(items, x -> cast(size(x.l) as bigint))").alias("lens_label"),
    )
