"""Dataset preparation: positional zip, filters, dense ids, paths and annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqengine.functions.scalars import strip, zero_fill

#: The label alphabet in index order, ended by the space.
CATEGORIES = (*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "Ä", "Ö", "Ü", "ä", "ö", "ü", "ß", " ")
MOST_STEPS = 1024


def zip_positions(first: DataFrame, second: DataFrame, position: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of two tables at equal positions; a position that only one has raises.

    `keys` name the folds and splits within which positions count.
    """
    on = [*keys, position]
    both = first.withColumn("__one", F.lit(1)).join(second.withColumn("__two", F.lit(1)), on, "full")
    whole = F.assert_true(F.col("__one").isNotNull() & F.col("__two").isNotNull(), F.lit("the parts differ in length"))
    return both.where(whole.isNull()).drop("__one", "__two")


def zip_arrays(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parallel array columns as rows with their position; unequal sizes raise."""
    same = [F.size(columns[0]) == F.size(c) for c in columns[1:]]
    rest = [c for c in rows.columns if c not in columns]
    checked = rows
    for condition in same:
        checked = checked.where(F.assert_true(condition, F.lit("the parts differ in length")).isNull())
    return checked.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("pos", "z")).select(*rest, "pos", *[F.col(f"z.{c}") for c in columns])


def usable_length(length: Column, most: int = MOST_STEPS) -> Column:
    """Whether a recording has steps, and at most `most`."""
    return (length > 0) & (length <= most)


def label_of(indices: Column, categories: Sequence[str] = CATEGORIES) -> Column:
    """The label that category indices spell, stripped."""
    table = F.array(*map(F.lit, categories))
    return strip(F.array_join(F.transform(indices, lambda i: F.element_at(table, (i + 1).cast("int"))), ""))


def dense_ids(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "id", chunk: Column | None = None) -> DataFrame:
    """Ordinals from 0 within each key, in order.

    With `chunk`, an expression that never falls along the order and isn't
    null, rows are numbered within each chunk and the counts of the chunks
    before are added, so that a key with many rows is spread over tasks.
    """
    if chunk is None:
        return rows.withColumn(out, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    cut = rows.withColumn("__chunk", chunk)
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    base = cut.groupBy(*keys, "__chunk").agg(F.count("*").alias("n")).withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    base = base.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__c"), "__base")
    same = F.col("__chunk") == F.col("__c")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = F.row_number().over(W.partitionBy(*keys, "__chunk").orderBy(*order)) - 1
    numbered = cut.withColumn("__place", inside).join(base, same)
    return numbered.select(*rows.columns, (F.col("__base") + F.col("__place")).cast("long").alias(out))


def file_path(fold: Column, split: Column, number: Column) -> Column:
    return F.concat_ws("/", F.lit("data"), fold.cast("string"), split, F.concat(zero_fill(number, 8), F.lit(".csv")))


def head(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The rows whose dense ordinal is below `most`; 0 keeps all."""
    return rows.where(F.col(order) < most) if most else rows


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """A seeded permutation, the same whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed), F.lit(epoch)), key)


def batch_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.ceil(F.count("*") / size).cast("long").alias("batches"))


def prepare(recordings: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """Annotations of recordings(fold, split, pos, values, indices, id_writer), with their values.

    Filter by length, spell the label, number densely by (fold, split) in order
    of position and name the file.
    """
    kept = dense_ids(recordings.where(usable_length(F.size("values"), most)), ["fold", "split"], ["pos"])
    return kept.select(
        "fold",
        "split",
        "id",
        file_path(F.col("fold"), F.col("split"), F.col("id")).alias("filename"),
        label_of(F.col("indices")).alias("label"),
        F.col("id_writer").cast("string").alias("id_writer"),
        F.lit(100).alias("rate_sample_orig"),
        "values",
    )


def group_overlap(one: DataFrame, two: DataFrame, group: str) -> DataFrame:
    """The groups (writers) that both tables have; empty for a disjoint split."""
    return one.select(group).intersect(two.select(group))


def check_dataset(annotations: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Per fold and split: rows, whether ids are dense and unique, and labels outside the alphabet."""
    foreign = F.exists(F.split("label", ""), lambda c: (c != "") & ~c.isin(list(categories)))
    return annotations.groupBy("fold", "split").agg(
        F.count("*").alias("rows"),
        ((F.min("id") == 0) & (F.max("id") == F.count("*") - 1) & (F.count_distinct("id") == F.count("*"))).alias("dense"),
        F.count_if(foreign).alias("foreign_labels"),
    )


def select_fold(rows: DataFrame, fold: str | int, column: str = "fold") -> DataFrame:
    """One fold's rows; on a table partitioned by fold this prunes the scan."""
    return rows.where(F.col(column).cast("string") == str(fold))


def without_blank(categories: Column) -> Column:
    """The category list without its first, the blank."""
    return F.slice(categories, F.lit(2), F.greatest(F.size(categories) - 1, F.lit(0)))


def typed(rows: DataFrame, values: str = "values", ids: str = "ids") -> DataFrame:
    """Samples in single precision and label ids as 32-bit integers, of whatever depth the arrays are."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (values, ids) if c in rows.columns}
    kinds = {c: "array<" * k.count("array<") + ("float" if c == values else "int") + ">" * k.count("array<") for c, k in kinds.items()}
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])


def setting(value: Column, default: int = 0) -> Column:
    """A configured value, or its default where it is missing."""
    return F.coalesce(value, F.lit(default))


def routed_epochs(metrics: DataFrame, test: bool, keys: Sequence[str] = ("fold",), by: str = "character_error_rate") -> DataFrame:
    """Rows of metrics(keys, epoch, metric, value) of each run's reported epoch: -1 of a test run, else the best one by a metric."""
    if test:
        return metrics.where("epoch = -1")
    best = metrics.where(F.col("metric") == by).groupBy(*keys).agg(F.min(F.struct("value", "epoch")).alias("b")).select(*keys, F.col("b.epoch").alias("epoch"))
    return metrics.join(best, [*keys, "epoch"]).select(*metrics.columns)


def annotated(annotations: DataFrame, signal: DataFrame, key: str = "filename") -> DataFrame:
    """Steps of recordings with their annotation; Spark broadcasts the annotations where they are small."""
    return signal.join(annotations, key)


def by_count(rows: DataFrame, count: str = "count", tie: str = "token") -> DataFrame:
    """All rows, the most frequent first, ties in order of `tie`."""
    return rows.orderBy(F.desc(count), F.col(tie))


def cached(rows: DataFrame) -> DataFrame:
    """Parsed and encoded rows kept for later epochs, in memory as far as they fit, else on disk."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)
