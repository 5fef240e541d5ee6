"""Where a loop of the driver cuts its plan: reliable checkpoints in the folder that the cluster shares."""

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(rows: DataFrame) -> DataFrame:
    """rows, computed and written to spark.checkpoint.dir; only a local session may do without that setting."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="murmur-levels-"))
    return rows.checkpoint(eager=True)


#: Rows that a task is meant to sort; more rows make more partitions than the usual number.
TASK_ROWS = 200_000


def dealt(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """rows dealt by keys to so many partitions that a task's memory does not grow with n_rows, what the tables of a join or window have."""
    parts = -(-n_rows // TASK_ROWS)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if parts > usual else rows


#: Rows that make a task worth its start.
LEAST_ROWS = 20_000


def fixed(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """rows dealt like ``dealt``, but small ones too: their number of partitions is theirs for good, so what is kept of them is joined where it is.

    Partitions that Spark may coalesce are dealt anew for each join.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(-(-n_rows // TASK_ROWS), min(usual, -(-n_rows // LEAST_ROWS)), 1), *keys)


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with ordinal: their place from 0 within their group, in the order given.

    Ranges of (group, order) are sorted on their own and counted, so a group that holds most rows is spread over tasks;
    the counts are a row a group and range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(rows.repartitionByRange(parts, group, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(group, "__range").agg(F.count("*").alias("__n")).select(F.col(group).alias("__group"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order))
    same = (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__group"))
    return ranges.withColumn("__place", place).join(counts, same).withColumn("ordinal", F.col("__place") + F.col("__before") - 1).drop("__place", "__before", "__range", "__r", "__group")
