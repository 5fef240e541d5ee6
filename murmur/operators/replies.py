"""Replies to broadcasts: each inbound message answers the latest recipient row of its contact that is still open.

Several replies of a contact answer several rows, and a row that is sent between two replies may be answered before an older
one: a stack for each contact, pushed by recipient rows and popped by messages. A stack needs no walk: with
running depths, a pop takes what was pushed last at the same depth. Depths are running sums that do not fall below
zero, S - min(0, running minimum of S); both are carried over ranges of a contact's rows, so a contact with most of the rows
is summed by many tasks. A pop that lowers the minimum found nothing open and answers nothing.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.operators.lineage import cut

OPEN = ("sent", "delivered", "read")


def answered_recipients(recipients: DataFrame, replies: DataFrame) -> DataFrame:
    """recipients (contact_id, created_at, status, order, payload: struct) and replies (contact_id, at, reply_id) -> reply_id, contact_id, at and the payload of the row that each answers.

    order sorts recipients of the same time; a recipient row of the time of a reply is there before it. Rows that are not open take no part.
    """
    pushes = recipients.filter(F.col("status").isin(*OPEN)).select("contact_id", F.col("created_at").alias("at"), F.lit(1).alias("d"), F.col("order").cast("string").alias("tie"), "payload", F.lit(None).cast(replies.schema["reply_id"].dataType).alias("reply_id"))
    pops = replies.select("contact_id", "at", F.lit(-1).alias("d"), F.lpad(F.col("reply_id").cast("string"), 20, "0").alias("tie"), F.lit(None).cast(recipients.schema["payload"].dataType).alias("payload"), "reply_id")
    rows = pushes.unionByName(pops).filter("contact_id IS NOT NULL").withColumn("first", -F.col("d"))
    order = ["at", "first", "tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(rows.repartitionByRange(parts, "contact_id", *order).withColumn("range", F.spark_partition_id()))
    local = Window.partitionBy("contact_id", "range").orderBy(*order, "reply_id")
    ranges = ranges.withColumn("s", F.sum("d").over(local.rowsBetween(Window.unboundedPreceding, 0))).withColumn("low", F.min("s").over(local.rowsBetween(Window.unboundedPreceding, 0))).withColumn("turn", F.row_number().over(local))
    before = Window.partitionBy("contact_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("contact_id", "range").agg(F.sum("d").alias("total"), F.min("s").alias("least"))
    sums = sums.withColumn("s0", F.coalesce(F.sum("total").over(before), F.lit(0))).withColumn("m0", F.coalesce(F.min(F.col("s0") + F.col("least")).over(before), F.lit(0))).select("contact_id", "range", "s0", "m0")
    all_ = ranges.join(sums, ["contact_id", "range"])
    floor = F.least(F.lit(0), "m0", F.col("s0") + F.col("low"))
    earlier = F.least(F.lit(0), "m0", F.col("s0") + F.coalesce(F.lag("low").over(local), F.lit(0)))
    # the first row of a range has no row of it before it: only what earlier ranges reached counts then
    earlier = F.when(F.col("turn") == 1, F.least(F.lit(0), "m0")).otherwise(earlier)
    all_ = all_.withColumns({"depth": F.col("s0") + F.col("s") - floor, "works": (F.col("d") == 1) | (floor == earlier)})
    level = F.when(F.col("d") == 1, F.col("depth")).otherwise(F.col("depth") + 1)
    stack = Window.partitionBy("contact_id", "level").orderBy(*order, "range", "turn")
    matched = all_.filter("works").withColumn("level", level).withColumn("taken", F.lag("payload").over(stack))
    return matched.filter("d = -1").select("reply_id", "contact_id", "at", F.col("taken").alias("payload"))


def recipients_after(recipients: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """recipients with status replied and replied_at where a reply took them; key is the field of the payload and the column that names a row."""
    taken = answered.select(F.col(f"payload.{key}").alias(key), F.col("at").alias("replied_at"))
    return recipients.join(taken, key, "left").withColumn("status", F.when(F.col("replied_at").isNotNull(), "replied").otherwise(F.col("status")))


def dispatch_fired(fired: DataFrame, automations: DataFrame, matches) -> DataFrame:
    """fired (id, user_id, place, trigger, text, ...) triggers of messages meet the active rules of their tenant that listen to the same one: a row a run.

    matches is a condition over both, for rules of keywords.
    """
    rules = automations.filter("is_active").select(F.col("id").alias("automation_id"), "user_id", "trigger", *[c for c in ("keywords", "match_type", "case_sensitive") if c in automations.columns])
    return fired.join(rules, ["user_id", "trigger"]).filter((F.col("trigger") != "keyword_match") | matches).select(*fired.columns, "automation_id")
