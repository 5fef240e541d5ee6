"""The delivery ladder pending < sent < delivered < read < replied, and failed from the first two rungs only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The ladder's rungs.
LEVELS = {"pending": 0, "sent": 1, "delivered": 2, "read": 3, "replied": 4}
NAMES = list(LEVELS)


def level_of(status):
    return F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[status]


def ladder(events: DataFrame) -> DataFrame:
    """(key, seq, at, status) -> (key, status, sent_at, delivered_at, read_at, n_accepted).

    Closed form of the fold: the first failure ends a key if nothing above sent came before it; else the highest
    level so far. Stamps are the times of accepted steps. Unknown statuses are ignored.
    """
    order = Window.partitionBy("key").orderBy("at", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("level", level_of(F.col("status"))).withColumn("reached", F.coalesce(F.max("level").over(before), F.lit(0)))
    fatal = (F.col("status") == "failed") & (F.col("reached") <= 1)
    rows = rows.withColumn("fatal", fatal).withColumn("over", F.coalesce(F.max(F.col("fatal").cast("int")).over(before), F.lit(0)) == 1)
    climbs = ~F.col("over") & (F.col("level") > F.col("reached"))
    stamp = lambda name: F.min(F.when(climbs & (F.col("status") == name), F.col("at")))
    dead = F.max((F.col("fatal") & ~F.col("over")).cast("int")) == 1
    top = F.coalesce(F.max(F.when(climbs, F.col("level"))), F.lit(0))
    return rows.groupBy("key").agg(
        F.when(dead, F.lit("failed")).otherwise(F.element_at(F.array(*map(F.lit, NAMES)), top + 1)).alias("status"),
        stamp("sent").alias("sent_at"), stamp("delivered").alias("delivered_at"), stamp("read").alias("read_at"),
        F.count_if(climbs | (F.col("fatal") & ~F.col("over"))).alias("n_accepted"),
    )


def fold_status(state: tuple[str, bool], status: str) -> tuple[str, bool]:
    """One step of the ladder: (current, over) -> the same after a status; for streams and as a check of the closed form."""
    current, over = state
    if over:
        return state
    if status == "failed":
        return ("failed", True) if LEVELS[current] <= 1 else state
    if status in LEVELS and LEVELS[status] > LEVELS[current]:
        return status, False
    return state


#: The counters that a status adds to.
COUNTED = {"sent": ("sent",), "delivered": ("sent", "delivered"), "read": ("sent", "delivered", "read"), "replied": ("sent", "delivered", "read", "replied"), "failed": ("failed",)}
COUNTERS = ("sent", "delivered", "read", "replied", "failed")


def counters_of(status):
    """array of the counters that a row of this status is in."""
    names = F.create_map(*[x for k, v in COUNTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(names[status], F.array().cast("array<string>"))


def broadcast_counts(recipients: DataFrame) -> DataFrame:
    """Cumulative counters of each broadcast: a recipient who read was sent to and delivered to as well."""
    counts = [F.count_if(F.array_contains(counters_of(F.col("status")), c)).alias(f"{c}_count") for c in COUNTERS]
    return recipients.groupBy("broadcast_id").agg(F.count("*").alias("total"), *counts)


def counter_deltas(changes: DataFrame) -> DataFrame:
    """(broadcast_id, old, new) -> +1 for each counter of the new status and -1 of the old, summed and not below zero."""
    gain = changes.select("broadcast_id", F.explode(counters_of(F.col("new"))).alias("counter"), F.lit(1).alias("d"))
    loss = changes.select("broadcast_id", F.explode(counters_of(F.col("old"))).alias("counter"), F.lit(-1).alias("d"))
    return gain.unionByName(loss).groupBy("broadcast_id", "counter").agg(F.greatest(F.lit(0), F.sum("d")).alias("n"))


def reply_attribution(recipients: DataFrame) -> DataFrame:
    """The latest recipient row of each contact that was sent to and has no reply yet: the one that a reply goes to."""
    latest = Window.partitionBy("contact_id").orderBy(F.col("created_at").desc(), F.col("broadcast_id").desc(), F.col("order_id").desc(), F.col("part_id").desc())
    rows = recipients.filter(F.col("status").isin("sent", "delivered", "read")).withColumn("turn", F.row_number().over(latest))
    return rows.filter("turn = 1").select("contact_id", "broadcast_id", "status", "created_at")


def merge_results(recipients: DataFrame, results: DataFrame) -> DataFrame:
    """recipients with a phone and results (phone, seq, accepted): the last result of a phone decides; without one a recipient is pending."""
    last = results.groupBy("phone").agg(F.max_by("accepted", "seq").alias("accepted"))
    merged = recipients.join(last, "phone", "left")
    return merged.withColumn("status", F.when(F.col("accepted"), "sent").when(F.col("accepted").isNull(), "pending").otherwise("failed"))


def outcomes(merged: DataFrame) -> DataFrame:
    """Totals of each broadcast; it failed if something failed and nothing was sent."""
    sent, failed = F.count_if(F.col("status") == "sent"), F.count_if(F.col("status") == "failed")
    final = F.when((sent == 0) & (failed > 0), "failed").otherwise("sent")
    return merged.groupBy("broadcast_id").agg(F.count("*").alias("total"), sent.alias("n_sent"), failed.alias("n_failed"), final.alias("status"))


def broadcasts_recounted(broadcasts: DataFrame, recipients: DataFrame) -> DataFrame:
    """broadcasts with their counters as the recipients have them now; one without recipients has none of each."""
    counts = broadcast_counts(recipients)
    names = [f"{c}_count" for c in COUNTERS]
    joined = broadcasts.drop(*names, "total").join(counts, "broadcast_id", "left")
    return joined.fillna(0, ["total", *names])
