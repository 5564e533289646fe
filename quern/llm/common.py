"""What the operators of this subpackage share: tables, lineage cuts, hot-group prefix sums, memos."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of a text, as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, as spark.checkpoint.dir names it.

    Only a session on one machine, as in tests, gets a folder of its own; on a cluster a missing one is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: What a broadcast may hold, as its values are counted.
BROADCAST_BYTES = 32 * 2**20


def width(field: T.StructField) -> Column:
    """About the bytes of a row's value; 32 for each member of an array that is not of numbers."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.size(field.name), F.lit(0)) * (8 if isinstance(field.dataType.elementType, T.NumericType) else 32) + 8
    return F.lit(8)


def small(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes. It is counted where it lies, so it should be cheap to read twice."""
    found = df.agg(F.count(F.lit(1)), F.sum(sum((width(f) for f in df.schema), F.lit(0)).cast("long"))).first()
    return found[0] <= rows and (found[1] or 0) <= size


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int) -> DataFrame:
    """left joined with right; right is broadcast only if it is counted to have at most so many rows and BROADCAST_BYTES, else both are shuffled."""
    return left.join(F.broadcast(right) if small(right, rows) else right, on, how)


def prefix_sums(df: DataFrame, group: str, bucket: str, order: list, value, out: str, narrow: DataFrame | None = None) -> DataFrame:
    """df with out: the sum of value over the rows of the same group that come before, by bucket and then by order.

    No task holds a group: rows are dealt by (group, bucket), summed up inside each bucket, and what the earlier
    buckets of the group hold is joined from the small table of bucket totals. group and bucket must not be null,
    and df should be cheap to read twice; else narrow gives the same groups, buckets and values.
    """
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df if narrow is None else narrow).groupBy(group, bucket).agg(F.sum(value).alias("_pre_total"))
    offsets = totals.select(group, bucket, F.coalesce(F.sum("_pre_total").over(before), F.lit(0)).alias("_pre_before"))
    rows = df.withColumn("_pre_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(offsets, [group, bucket]).withColumn(out, F.col("_pre_before") + F.col("_pre_inside")).drop("_pre_before", "_pre_inside")


def spread(spark: SparkSession) -> int:
    """How many buckets a hot group is split into: as many as the session shuffles to."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of whole texts that go to Python at once, on either side, where the session leaves that open.
ARROW_ROWS = 1000


def tuned(spark: SparkSession) -> SparkSession:
    """For entry points: the session with Arrow batches of ARROW_ROWS, if it has not chosen a number.

    Spark's default of 10,000 is meant for narrow rows, and the buffers of whole texts stay with the executor. Operators
    leave the session alone; they slice what they get.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


#: What each operator keeps in a Python worker: its name and how to let go of it.
_kept: list[tuple[str, Callable[[], None]]] = []
_owner: list[str] = []


def keep(owner: str, clear: Callable[[], None]) -> None:
    _kept.append((owner, clear))


#: Of the C library, where it has that.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep for later of the memory that is free."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def take_over(owner: str) -> None:
    """Before an operator works in a Python worker: lets go of what others keep there, as workers serve all of them in turn, and of free memory."""
    if _owner != [owner]:
        _owner[:] = [owner]
        for other, clear in _kept:
            if other != owner:
                clear()
    give_back()


class Memo(dict):
    """A dictionary that computes what it lacks and starts anew when full, so that its memory is bounded."""

    def __init__(self, owner: str, compute, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest
        keep(owner, self.clear)

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
