"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.shared import cut as cut


def spread(df: DataFrame) -> DataFrame:
    """Give a narrow scan (one small file) as many partitions as there are cores; a wide scan stays as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= cores else df.repartition(cores)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under names of our own, so that no extra column of the input can clash."""
    return df.select(*[F.col(f"`{c}`").alias(a) for a, c in cols.items()])


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply `fn` to every Arrow batch; batches that are empty are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, by: str, most: int) -> DataFrame:
    """Different values of `by` with the least hashes, at most `most` rows: a sample that depends on nothing but the values."""
    n = df.count()
    if n > most:
        df = df.filter(F.pmod(F.xxhash64(by), F.lit(10**9)) < -(-most * 11 * 10**8 // n))
    rest = [c for c in df.columns if c != by]
    one = df.groupBy(by).agg(F.min(F.struct(*rest)).alias("__rest")).select(*[F.col(c if c == by else f"__rest.{c}") for c in df.columns]) if rest else df.distinct()
    return one.orderBy(F.xxhash64(by), by).limit(most)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a string column as one UTF-32 array, and where each row begins (n + 1 offsets).

    The bytes of the whole batch are decoded at once; nulls count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, off_buf, data = texts.buffers()
    off = np.frombuffer(off_buf, np.int64, n + 1, texts.offset * 8)
    lo, hi = int(off[0]), int(off[-1])
    if hi == lo:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8, hi - lo, lo)
    starts = np.zeros(hi - lo + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return cps, starts[off - lo]


def to_strings(cps: np.ndarray, offsets: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The inverse of `code_points`."""
    raw = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = np.ones(len(cps), np.int64)
    width += cps > 0x7F
    width += cps > 0x7FF
    width += cps > 0xFFFF
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at[offsets].astype(np.int64).tobytes()), pa.py_buffer(raw))
    if nulls is not None and nulls.any():
        import pyarrow.compute as pc

        out = pc.if_else(pa.array(nulls), pa.scalar(None, pa.large_string()), out)
    return out.cast(pa.string())


def int_lists(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


def null_mask(a: pa.Array) -> np.ndarray:
    return np.asarray(a.is_null())


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `limit` bytes of text (one row at least), to bound numpy's working memory."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at, n = 0, len(texts)
    while at < n:
        done = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield at, to
        at = to


def join_skewed(rows: DataFrame, stats: DataFrame, key: str, weight: str, total: int, share: int = 10_000) -> DataFrame:
    """rows JOIN stats ON key, where a few keys may hold a large part of the rows.

    A key with more than total / share rows is *frequent*; there are fewer than `share` such keys, so their statistics
    are broadcast whatever the data's size. All other keys are joined by a shuffle in which none is large.
    """
    frequent = F.col(weight) > F.lit(max(1, total // share))
    few = F.broadcast(stats.filter(frequent))
    flagged = rows.join(few, key, "left").withColumn("__hit", F.col(weight).isNotNull())
    cols = [c for c in stats.columns if c != key]
    near = flagged.filter("__hit").drop("__hit")
    far = flagged.filter("not __hit").drop("__hit", *cols).join(stats.filter(~frequent), key)
    return near.unionByName(far)


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` within `group`, ordered by (bucket, *order).

    No group is sorted in one task: each (group, bucket) is summed on its own, and only the buckets' totals, one row
    each, are run up per group.
    """
    from pyspark.sql import Window

    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("__t"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(over), F.lit(0))).drop("__t")
    return df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, [*group, bucket]).withColumn(out, F.col("__before") + F.col("__in")).drop("__in", "__before")


def scattered_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per (group, value): n_below, n_same and n_all, the rows of the group below, at and in all; for groups of any size.

    Equal values are counted first; the counted values are range-partitioned by (group, value), so one group spreads
    over many tasks, and only one total per group and task is run up.
    """
    from pyspark.sql import Window

    counted = df.groupBy(*group, value).agg(F.count("*").alias("n_same"))
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = cut(counted.repartitionByRange(n, *group, value).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    totals = part.groupBy(*group, "__part").agg(F.sum("n_same").alias("__t"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(over), F.lit(0))).withColumn("n_all", F.sum("__t").over(whole)).drop("__t")
    ranked = part.withColumn("__in", F.coalesce(F.sum("n_same").over(inside), F.lit(0))).join(before, [*group, "__part"])
    return ranked.withColumn("n_below", F.col("__before") + F.col("__in")).select(*group, value, "n_below", "n_same", "n_all")
