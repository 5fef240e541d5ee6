"""Sales pipelines: totals by stage, shares, key figures, weighted value.

Stages are few (a pipeline's rungs), so windows over all of them hold a handful of rows; deals are aggregated first.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stage_totals(deals: DataFrame, stages: DataFrame) -> DataFrame:
    """Open deals by stage; stages without any are left out."""
    sums = deals.filter("status = 'open'").groupBy("stage_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("total"))
    rows = stages.join(sums, "stage_id", "left").fillna(0, ["n"]).withColumn("total", F.coalesce("total", F.lit(0)))
    return rows.filter("n > 0").select("stage_id", "position", "n", F.col("total").cast("double").alias("total"))


def donut_shares(deals: DataFrame, stages: DataFrame, least: float = 0.02) -> DataFrame:
    """Shares of the total with a floor, renormalised, and where each slice begins."""
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy(F.lit(1)).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    raised = stage_totals(deals, stages).withColumn("raw", F.greatest(F.col("total") / F.sum("total").over(everything), F.lit(least)))
    shares = raised.withColumn("share", F.col("raw") / F.sum("raw").over(everything))
    return shares.select("stage_id", F.round("share", 6).alias("share"), F.round(F.coalesce(F.sum("share").over(before), F.lit(0.0)), 6).alias("begins"))


def board(deals: DataFrame, stages: DataFrame) -> DataFrame:
    """Deals of every status by known stage: how many, their sum, the largest ids first seen."""
    return deals.join(stages, "stage_id").groupBy("stage_id", "position").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def pipeline_kpis(deals: DataFrame, as_of: str) -> DataFrame:
    """Deals that are not lost (those without status count), and what was won or lost in the month of as_of."""
    now = F.lit(as_of).cast("timestamp_ntz")
    live = ~F.col("status").eqNullSafe("lost")
    month = F.col("updated_at") >= F.date_trunc("MONTH", now)
    return deals.agg(
        F.count_if(live).alias("n"),
        F.coalesce(F.sum(F.when(live, F.col("value"))), F.lit(0)).cast("double").alias("total"),
        F.round(F.coalesce(F.avg(F.when(live, F.col("value").cast("double"))), F.lit(0.0)), 4).alias("average"),
        F.count_if((F.col("status") == "won") & month).alias("won_this_month"),
        F.count_if((F.col("status") == "lost") & month).alias("lost_this_month"),
    )


def stage_probability(stages: DataFrame) -> DataFrame:
    """0.1 to 0.9 in equal steps over all stages but the last, which has 1; a single stage has 1."""
    all_stages = Window.partitionBy(F.lit(1))
    place, n = F.row_number().over(all_stages.orderBy("position")) - 1, F.count("*").over(all_stages)
    rows = stages.withColumn("place", place).withColumn("stages", n)
    rising = 0.1 + 0.8 * F.col("place") / F.greatest(F.lit(1), F.col("stages") - 2)
    return rows.select("stage_id", "position", F.when(F.col("place") == F.col("stages") - 1, 1.0).otherwise(rising).alias("probability"))


def weighted_pipeline(deals: DataFrame, stages: DataFrame) -> DataFrame:
    sums = deals.filter("status = 'open'").groupBy("stage_id").agg(F.sum("value").cast("double").alias("open_value"))
    rows = sums.join(stage_probability(stages), "stage_id")
    return rows.select("stage_id", F.round("probability", 6).alias("probability"), "open_value", F.round(F.col("probability") * F.col("open_value"), 2).alias("weighted"))
