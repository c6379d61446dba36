"""What several operators share: cutting lineage, and numbering rows without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names. Where none is named a local session (tests) gets a folder of its own;
    a cluster gets an error, as executors cannot read each other's local folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="lexmill-ckpt-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage and the plan are cut, and the rows survive a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered_rows(df: DataFrame, order: list[str], out: str, start: int = 1) -> DataFrame:
    """Adds `out`, dense from `start` in the order of `order`. Rows are range-partitioned, so each task numbers its own
    range; only one count a task is run up. Partitions are fixed by a checkpoint before they are counted."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(before), "__part").withColumn(out, (F.col("__before") + inside + (start - 1)).cast("long")).drop("__part", "__before")


def value_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per (group, value): n_below, n_same and n_all, the rows of the group below, at and in all; for groups of any size.

    Equal values are counted first; the counted values are range-partitioned by (group, value), so one group spreads
    over many tasks, and only one total per group and task is run up. Rows whose value is null are left out.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n_same"))
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = cut(counted.repartitionByRange(n, *group, value).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy(*group, "__part").agg(F.sum("n_same").alias("__t"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(over), F.lit(0))).withColumn("n_all", F.sum("__t").over(Window.partitionBy(*group))).drop("__t")
    right = before.select(F.struct(*group).alias("__g"), F.col("__part").alias("__p"), "__before", "n_all")
    ranked = part.withColumn("__in", F.coalesce(F.sum("n_same").over(inside), F.lit(0)))
    ranked = ranked.join(right, F.struct(*group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return ranked.withColumn("n_below", F.col("__before") + F.col("__in")).select(*group, value, "n_below", "n_same", "n_all")
