"""What an agent's desk shows and may change: boards with their deals, tags and reactions of what is open, lookups of one row, stamped changes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.lineage import placed


def board_deals(deals: DataFrame, stages: DataFrame, contacts: DataFrame, profiles: DataFrame) -> DataFrame:
    """A row a deal on the board: its stage, place in the column (latest first), contact and assignee, each null where there is none.

    Deals of unknown stages are not on the board. Columns are numbered by ranges, so one with most of the deals is no single task.
    """
    who = contacts.select(F.col("id").alias("contact_id"), F.struct("name", "phone").alias("contact"))
    owner = profiles.select(F.col("user_id").alias("assigned_to"), F.col("agent").alias("assignee"))
    rows = deals.join(stages.select("stage_id", "position"), "stage_id").join(who, "contact_id", "left").join(owner, "assigned_to", "left")
    rows = rows.withColumn("__since", -F.unix_micros(F.col("created_at").cast("timestamp")))
    return placed(rows, "stage_id", "__since", "id").drop("__since")


def board_totals(deals: DataFrame, stages: DataFrame, colour: str = "#64748b") -> DataFrame:
    """Open deals by stage that has any, with the stage's colour or the usual one, and a row of the grand total over what is shown (stage null)."""
    sums = deals.filter("status = 'open'").groupBy("stage_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("total"))
    rows = sums.join(stages.select("stage_id", "colour"), "stage_id").withColumn("colour", F.coalesce("colour", F.lit(colour)))
    return rows.groupingSets([["stage_id", "colour"], []], "stage_id", "colour").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))


def tags_shown(contact_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(contact_id, tag, colour): tags that are known; a contact without any has no row."""
    return contact_tags.join(tags, "tag")


def reactions_by_message(reactions: DataFrame) -> DataFrame:
    """(message_id, actor_id, emoji, at) -> one array a message, in order of time; a message has one reaction an actor."""
    return reactions.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("at", "actor_id", "emoji"))).alias("reactions"))


def may_change(reactions: DataFrame, conversations: DataFrame, user_id: Column) -> DataFrame:
    """Reactions that the user may take back or swap: their own as an agent, in a conversation that is theirs."""
    own = conversations.select("conversation_id", F.col("user_id").alias("__owner")).distinct()
    mine = reactions.filter((F.col("actor_type") == "agent") & (F.col("actor_id") == user_id))
    return mine.join(own, (mine["conversation_id"] == own["conversation_id"]) & (mine["actor_id"] == own["__owner"]), "left_semi")


def looked_up_once(wanted: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """wanted with the one row's value, n (how many there are) and problem: a lookup of exactly one fails on none and on several, of at most one on several."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min(value)).alias(value))
    out = wanted.join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("problem", F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "several"))


def stamped(rows: DataFrame, changes: DataFrame, keys: list[str], clock: Column) -> DataFrame:
    """The rows after an update by unique keys, with updated_at set to the clock on every row that was updated, whether or not a value differs."""
    new = [c for c in changes.columns if c not in keys]
    joined = rows.join(changes.select(*keys, F.struct(*new).alias("__new")), keys, "left")
    touched = F.col("__new").isNotNull()
    values = {c: F.when(touched, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in new} | {"updated_at": F.when(touched, clock).otherwise(F.col("updated_at"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in rows.columns])


def profiles_of(accounts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user_id, full_name, email) profiles that new accounts bring: none for accounts that have one, and none, silently, for those that can't have one."""
    fresh = accounts.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.min("email").alias("email"), F.min("full_name").alias("full_name"))
    return fresh.join(profiles.select("user_id"), "user_id", "left_anti").select("user_id", F.coalesce("full_name", F.lit("")).alias("full_name"), "email")
