"""What the operators of this subpackage share: written tables and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    It is read from the session.  Only where the setting is missing on one
    machine, as in tests, a temporary folder is made and set; on a cluster a
    missing setting raises.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="seqengine-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


_scopes: list[list[DataFrame]] = []


@contextmanager
def intermediates() -> Iterator[None]:
    """Deletes, at the end, the tables that operators wrote inside it: collect or write their results before."""
    mine: list[DataFrame] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for table in mine:
            discard(table)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again.

    This cuts the lineage: what was written survives the loss of any executor,
    and the shuffle files behind it are freed at once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, free = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(free, "false")
    conf.set(free, "true")
    try:
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        conf.set(free, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    for scope in _scopes:
        scope.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def returned() -> None:
    """Give the memory that a task has freed back to the system; the worker process lives on and serves other steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of mapInArrow after whose last batch what it held is given back to the system."""

    def whole(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(stream)
        finally:
            returned()

    return whole


MARKS = 1 << 24


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose `key` may be in the one column of `ids`: none that is goes, and few that aren't stay.

    For a join that would shuffle wide rows: the ids' hashes are marked in
    `MARKS` bits, so what is broadcast is bounded however many ids there are.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    marks = ids.select(place(F.col(ids.columns[0])).alias("__place")).groupBy(F.expr("cast(__place >> 6 as int)").alias("__part")).agg(F.expr("bit_or(shiftleft(1L, cast(__place & 63 as int)))").alias("__bits"))
    placed = rows.withColumn("__part", F.shiftright(place(F.col(key)), 6).cast("int")).withColumn("__bit", (place(F.col(key)).bitwiseAND(63)).cast("int"))
    return placed.join(F.broadcast(marks), "__part").where(F.expr("(shiftright(__bits, __bit) & 1L) = 1L")).select(*rows.columns)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) as (id, component), component the smallest id.

    Alternating large-star and small-star passes; every pass is a partial
    minimum by node and an equi-join, and its result is written to the shared
    folder.  Ends when a pass changes nothing; raises if `rounds` don't suffice.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        after = written(small.where("a <> b").distinct(), "edges")
        discard(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)
