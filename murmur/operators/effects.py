"""What automation runs leave behind: the writes of many runs merged into the tables they hit.

Writes have a total order: the time of the run, its event and rule, and the place of the step in its tree. Runs of one
batch may write the same row; for each row and column the last write counts, and a tag is there if its last write
added it. Each merge is one aggregation by the written key with partial maxima, then one join with the table, so
neither the number of runs of a contact nor a contact with most of the runs gathers in one place.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.runs import WRITABLE

ORDER = ("at", "event_id", "automation_id", "place")
#: What all merges read of executed steps, besides what ``runs.execute`` always keeps.
WRITE = ("at", "user_id", "contact_id", "status")


def writes(executed: DataFrame, *kinds: str) -> DataFrame:
    """Steps of these kinds that wrote, with order: their place among all writes of the batch."""
    return executed.filter(F.col("kind").isin(*kinds) & (F.col("status") == "success")).withColumn("order", F.struct(*ORDER))


def _last(value: Column, where: Column) -> Column:
    """The value of the last write that meets the condition, in a struct, so that a written null differs from no write."""
    return F.max_by(F.when(where, F.struct(value.alias("x"))), F.when(where, F.col("order")))


def tags_after(executed: DataFrame, contact_tags: DataFrame) -> DataFrame:
    """(contact_id, tag) after the runs: the last write of a pair decides, pairs without one stay."""
    last = writes(executed, "add_tag", "remove_tag").groupBy("contact_id", "tag").agg(F.max_by("kind", "order").alias("__last"))
    both = contact_tags.select("contact_id", "tag").distinct().withColumn("__held", F.lit(True)).join(last, ["contact_id", "tag"], "full")
    return both.filter((F.col("__last") == "add_tag") | F.col("__last").isNull()).select("contact_id", "tag")


def contacts_after(executed: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts with the fields that steps set; updated_at is the time of the last write, or null.

    Fields are merged one by one: two runs that set different fields of a contact both show.
    """
    fields = [c for c in WRITABLE if c in contacts.columns]
    set_ = writes(executed, "update_contact_field").groupBy(F.col("contact_id").alias("id")).agg(*[_last(F.col("value"), F.col("field") == c).alias(f"__{c}") for c in fields], F.max("at").alias("__at"))
    rows = contacts.join(set_, "id", "left")
    changed = {c: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.x")).otherwise(F.col(c)) for c in fields}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in contacts.columns if c != "updated_at"], F.col("__at").alias("updated_at"))


def deals_created(executed: DataFrame) -> DataFrame:
    """The deals that steps made, one each, open and at their stage; the pair of event and step is their key."""
    rows = writes(executed, "create_deal")
    return rows.select("event_id", F.col("id").alias("step_id"), "user_id", "contact_id", F.col("stage").alias("stage_id"), F.col("body").alias("title"), F.coalesce("deal_value", F.lit(0)).cast("decimal(12,2)").alias("value"), F.lit("open").alias("status"), F.col("at").alias("created_at"))


def conversations_after(executed: DataFrame, conversations: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, user_id, contact_id, status, assigned_agent, ...) after the runs: every conversation of a contact with the rule's tenant is assigned and closed.

    A round-robin step takes an agent (user_id, agent) of the tenant, the first by name; one without an agent writes nothing.
    """
    pool = profiles.groupBy("user_id").agg(F.min("agent").alias("__first"))
    rows = writes(executed, "assign_conversation", "close_conversation").join(pool, "user_id", "left")
    agent = F.when(F.col("mode") == "round_robin", F.col("__first")).otherwise(F.nullif("agent", F.lit("")))
    assigns, closes = (F.col("kind") == "assign_conversation") & agent.isNotNull(), F.col("kind") == "close_conversation"
    last = rows.groupBy("user_id", "contact_id").agg(_last(agent, assigns).alias("__agent"), F.max(F.when(closes, F.col("at"))).alias("__closed"))
    joined = conversations.join(last, ["user_id", "contact_id"], "left")
    changed = {"assigned_agent": F.coalesce("__agent.x", "assigned_agent"), "status": F.when(F.col("__closed").isNotNull(), "closed").otherwise(F.col("status"))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in conversations.columns if c != "updated_at"], F.col("__closed").alias("updated_at"))
