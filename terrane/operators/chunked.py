"""Running values along a position without putting a whole chromosome in one task.

Small inputs take a plain window by key. Larger ones are written to the shared folder first (they are read twice, and long chains of
operators would double their plans at every step); if they prove large there, rows are dealt out by (keys, chunk of positions): a
chunk's own running value is a window, and what the chunks before it add comes from a table of one row per chunk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Bytes, as Catalyst estimates them, up to which one window by key will do.
PLAIN_BYTES = 256 << 20
_COMBINE = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


#: The folder of the run that is going on, if there is one.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir; one of its own on a local master alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _local_dir()
    return named.rstrip("/")


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="terrane-")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the run's folder or, outside of runs, in the shared one."""
    return f"{_RUN.get() or shared_dir(spark) + '/terrane'}/{tag}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _files_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside remove their shuffle files; no other query reads those of a write."""
    before = spark.conf.get(_REMOVED, None)
    spark.conf.set(_REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REMOVED) if before is None else spark.conf.set(_REMOVED, before)


def settled(df: DataFrame, tag: str = "rows") -> DataFrame:
    """The same rows from a table in the shared folder: the plan starts anew there, and lost executors lose nothing."""
    path = new_path(df.sparkSession, tag)
    with _files_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidied(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, run at once: its result is written, and the folder that holds the tables it needed on the way is deleted, on errors too.

    Runs inside runs share the outer one's folder.
    """

    @wraps(f)
    def run(*args, **more) -> DataFrame:
        if _RUN.get():
            return f(*args, **more)
        spark = SparkSession.active()
        folder = new_path(spark, "run")
        token = _RUN.set(folder)
        try:
            result = f(*args, **more)
            _RUN.set(None)
            return settled(result, f.__name__)
        finally:
            _RUN.reset(token)
            delete(spark, folder)

    return run


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def placed(df: DataFrame, limit: int | None) -> tuple[DataFrame, bool]:
    """df, written if it seems large, and whether it is large: over `limit` bytes, or PLAIN_BYTES where that is None."""
    limit = PLAIN_BYTES if limit is None else limit
    if estimated_bytes(df) <= limit:
        return df, False
    df = settled(df)
    return df, estimated_bytes(df) > limit


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, kind: str, out: str, inclusive: bool = True, chunk: float = CHUNK, limit: int | None = None) -> DataFrame:
    """Add the running sum, max or min of `value` over rows with equal keys in the order given, whose first column is the position.

    Without `inclusive` a row's own value isn't part of its result, which is null on the first row.
    """
    fold, last = _FOLD[kind], 0 if inclusive else -1
    df, large = placed(df, limit)
    if not large:
        return df.withColumn(out, fold(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)))
    dealt = df.withColumn("_chunk", F.floor(F.col(order[0]) / chunk)).withColumn("_value", value)
    totals = dealt.groupBy(*keys, "_chunk").agg(fold("_value").alias("_total"))
    before = fold("_total").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, "_chunk", before.alias("_before"))
    own = fold("_value").over(Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, last))
    both = dealt.withColumn("_own", own).join(totals, [*keys, "_chunk"])
    result = F.when(F.col("_own").isNull(), F.col("_before")).when(F.col("_before").isNull(), F.col("_own")).otherwise(_COMBINE[kind](F.col("_own"), F.col("_before")))
    return both.withColumn(out, result).select(*df.columns, out)


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str], chunk: float = CHUNK, previous: bool = True, following: bool = True, limit: int | None = None) -> DataFrame:
    """Add `prev_<c>` and `next_<c>` of the rows before and behind in the order given; null at the ends of a key's rows."""
    along = list(dict.fromkeys([*order, *columns]))
    df, large = placed(df, limit)
    if not large:
        over = Window.partitionBy(*keys).orderBy(*along)
        return df.withColumns({**({f"prev_{c}": F.lag(c).over(over) for c in columns} if previous else {}), **({f"next_{c}": F.lead(c).over(over) for c in columns} if following else {})})
    dealt = df.withColumn("_chunk", F.floor(F.col(order[0]) / chunk))
    row = F.struct(*along)
    ends = dealt.groupBy(*keys, "_chunk").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_chunk")
    ends = ends.select(*keys, "_chunk", F.lag("_last").over(over).alias("_came"), F.lead("_first").over(over).alias("_comes"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*along)
    both = dealt.join(ends, [*keys, "_chunk"])
    first, last = F.row_number().over(inside) == 1, F.lead(F.lit(1)).over(inside).isNull()
    added = {}
    for c in columns:
        if previous:
            added[f"prev_{c}"] = F.when(first, F.col(f"_came.{c}")).otherwise(F.lag(c).over(inside))
        if following:
            added[f"next_{c}"] = F.when(last, F.col(f"_comes.{c}")).otherwise(F.lead(c).over(inside))
    return both.withColumns(added).select(*df.columns, *added)


def summed_overall(df: DataFrame, order: list[str], value: Column, out: str, total: str) -> DataFrame:
    """Add the sum of `value` over the rows before in one order over all rows, and the sum over all.

    Rows are dealt out by ranges of `order`, and rows equal in all of it by a number of their own, so no task holds all rows however
    many are alike; a row's sum is that within its range plus those of the ranges before, one row each.
    """
    own = df.withColumns({"_value": value, "_own": F.monotonically_increasing_id()})
    placed = settled(own.repartitionByRange(*order, "_own").withColumn("_range", F.spark_partition_id()))
    along = Window.orderBy("_range")  # over as many rows as there are ranges
    ranges = placed.groupBy("_range").agg(F.sum("_value").alias("_n"))
    ranges = ranges.select("_range", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias(total))
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order, "_own").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value")
    return placed.join(F.broadcast(ranges), "_range").withColumn(out, inside + F.col("_before")).select(*df.columns, out, total)


def ranked_overall(df: DataFrame, order: list[str], out: str, total: str = "_total") -> DataFrame:
    """Add the row number, from 1, in one order over all rows, and the number of rows."""
    return summed_overall(df, order, F.lit(1).cast("long"), out, total).withColumn(out, F.col(out) + 1)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, chunk: int = CHUNK) -> DataFrame:
    """Add `island`: how many rows up to this one start an island. `starts` may use columns of df only."""
    return running(df, keys, order, F.when(starts, 1).otherwise(0).cast("long"), "sum", "island", chunk=chunk)


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, chunk: int = CHUNK) -> DataFrame:
    """Add the row number, from 1, among rows with equal keys in the order given, whose first column is the position."""
    return running(df, keys, order, F.lit(1).cast("long"), "sum", out, chunk=chunk)
