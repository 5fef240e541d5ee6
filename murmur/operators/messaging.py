"""Messages and conversations: response times, daily series, sessions, unread counts, search.

messages: (id, conversation_id, created_at, sender_type, content_text). All windows are partitioned by conversation.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions.dates import day_spine, monday_index
from murmur.functions.text import contains_text

def in_order():
    return Window.partitionBy("conversation_id").orderBy("created_at", "id")


def response_pairs(messages: DataFrame) -> DataFrame:
    """The first message of each unanswered run of a customer with the next message of someone else.

    Only rows where the side changes are kept, so the answer to a row is simply the next one: no frame looks further.
    """
    inbound = F.col("sender_type") == "customer"
    before = F.lag(inbound).over(in_order())
    turns = messages.withColumn("inbound", inbound).withColumn("before", before).filter(~F.col("inbound").eqNullSafe(F.col("before")))
    paired = turns.withColumn("replied_at", F.lead("created_at").over(in_order())).filter(F.col("inbound") & F.col("replied_at").isNotNull())
    minutes = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("replied_at")) / 60000000.0
    return paired.select("conversation_id", F.col("created_at").alias("asked_at"), "replied_at", minutes.alias("minutes"))


def response_time_by_weekday(messages: DataFrame) -> DataFrame:
    """Average minutes by the weekday of the customer's message; all seven days, Monday first."""
    found = response_pairs(messages).groupBy(monday_index(F.col("asked_at")).alias("weekday")).agg(F.round(F.avg("minutes"), 6).alias("avg_minutes"), F.count("*").alias("samples"))
    week = messages.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return week.join(found, "weekday", "left").select("weekday", "avg_minutes", F.coalesce("samples", F.lit(0)).alias("samples"))


def response_time_week_compare(messages: DataFrame, as_of: str) -> DataFrame:
    """Average minutes of this week and the last; weeks begin on Monday."""
    now = F.lit(as_of).cast("timestamp_ntz")
    this_week = F.date_trunc("WEEK", now)
    last_week = this_week - F.expr("INTERVAL 7 DAYS")
    at = F.col("asked_at")
    return response_pairs(messages).agg(F.round(F.avg(F.when(at >= this_week, F.col("minutes"))), 6).alias("this_week"), F.round(F.avg(F.when((at >= last_week) & (at < this_week), F.col("minutes"))), 6).alias("last_week"))


def daily_series(messages: DataFrame, last_day: str, days: int) -> DataFrame:
    """Incoming and outgoing messages of each day, zero where there are none."""
    inbound = F.col("sender_type") == "customer"
    begin = F.date_sub(F.to_date(F.lit(last_day)), days - 1)
    counted = messages.filter((F.to_date("created_at") >= begin) & (F.to_date("created_at") <= F.to_date(F.lit(last_day)))).groupBy(F.to_date("created_at").alias("day")).agg(F.count_if(inbound).alias("incoming"), F.count_if(~inbound).alias("outgoing"))
    return day_spine(messages.sparkSession, last_day, days).join(counted, "day", "left").select("day", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row a conversation: its times, last text, and the customer's messages after the last answer."""
    latest = F.struct("created_at", "id")
    answered = F.max(F.when(F.col("sender_type") != "customer", F.col("created_at"))).over(Window.partitionBy("conversation_id"))
    unread = (F.col("sender_type") == "customer") & (F.col("answered").isNull() | (F.col("created_at") > F.col("answered")))
    status = F.element_at(F.array(F.lit("open"), F.lit("pending"), F.lit("closed")), (F.col("conversation_id") % 3 + 1).cast("int"))
    rows = messages.withColumn("answered", answered).groupBy("conversation_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("last_message_at"), F.max_by("content_text", latest).alias("last_message_text"), F.count_if(unread).alias("unread_count"))
    return rows.withColumn("status", status)


def inbox(conversations: DataFrame, contacts: DataFrame, term: str = "", status: str = "all") -> DataFrame:
    """Conversations with their contact, filtered by status and a literal term over name, phone and last text."""
    c = contacts.select(F.col("id").alias("conversation_id"), "name", "phone")
    rows = conversations.join(c, "conversation_id", "left")
    if status != "all":
        rows = rows.filter(F.col("status") == status)
    if term.strip():
        rows = rows.filter(contains_text(F.col("name"), F.lit(term)) | contains_text(F.col("phone"), F.lit(term)) | contains_text(F.col("last_message_text"), F.lit(term)))
    return rows.orderBy(F.col("last_message_at").desc_nulls_first(), "conversation_id")


def session_state(messages: DataFrame, as_of: str) -> DataFrame:
    """Whether the 24 hours after the customer's last message are over; never a customer message: over."""
    last = F.max(F.when(F.col("sender_type") == "customer", F.col("created_at")))
    hours = F.timestamp_diff("SECOND", F.col("last_inbound"), F.lit(as_of).cast("timestamp_ntz")) / 3600
    rows = messages.groupBy("conversation_id").agg(last.alias("last_inbound")).withColumn("hours", F.floor(hours))
    return rows.select("conversation_id", "last_inbound", (F.col("last_inbound").isNull() | (F.col("hours") >= 24)).alias("expired"), F.when(F.col("hours") < 24, 24 - F.col("hours")).alias("hours_left"))


def day_groups(messages: DataFrame) -> DataFrame:
    """Number of each message's run of equal days within its conversation, from 1, and whether it opens the run."""
    day = F.to_date("created_at")
    opens = ~day.eqNullSafe(F.lag(day).over(in_order()))
    running = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("opens_day", opens).select("id", "conversation_id", day.alias("day"), "opens_day", F.sum(F.col("opens_day").cast("long")).over(running).alias("day_group"))


def first_inbound(messages: DataFrame) -> DataFrame:
    """The first customer message of each conversation."""
    rows = messages.filter(F.col("sender_type") == "customer").withColumn("turn", F.row_number().over(in_order()))
    return rows.filter("turn = 1").select("conversation_id", "id", "created_at")


def unread_gauge(conversations: DataFrame) -> DataFrame:
    unread = F.coalesce("unread_count", F.lit(0))
    return conversations.agg(F.count_if(unread > 0).alias("unread_conversations"), F.sum(unread).alias("unread_messages"))


def trigger_fanout(messages: DataFrame, keyword: Column) -> DataFrame:
    """The triggers that each inbound message fires, in their order."""
    first = F.row_number().over(in_order()) == 1
    rows = messages.filter(F.col("sender_type") == "customer").withColumn("first", first)
    fired = F.array(F.when(F.col("first"), F.lit("first_inbound_message")), F.lit("new_message_received"), F.when(keyword, F.lit("keyword_match")))
    return rows.select("id", "conversation_id", F.posexplode(F.filter(fired, lambda x: x.isNotNull())).alias("place", "trigger"))


def reply_pairs(thread: DataFrame) -> DataFrame:
    """Each turn with the one it answers: a self join on the turn before."""
    parent = thread.select("conversation_id", (F.col("turn") + 1).alias("turn"), F.col("sender_type").alias("parent_sender"), F.col("content_text").alias("parent_text"))
    who = lambda c: F.when(c.isin("agent", "bot"), F.lit("You")).when(c.isNotNull(), F.lit("Customer"))
    joined = thread.join(parent, ["conversation_id", "turn"], "left")
    return joined.select("conversation_id", "turn", who(F.col("sender_type")).alias("author"), who(F.col("parent_sender")).alias("parent_author"), F.length("parent_text").cast("long").alias("parent_chars"))


def latest_reactions(events: DataFrame) -> DataFrame:
    """(message_id, actor_id, emoji, at, seq) -> each actor's last reaction; an empty emoji takes it back."""
    last = F.max_by(F.struct("emoji", "at"), F.struct("at", "seq")).alias("r")
    return events.groupBy("message_id", "actor_id").agg(last).select("message_id", "actor_id", "r.emoji", "r.at").filter("emoji != ''")


def reaction_groups(reactions: DataFrame, me: int) -> DataFrame:
    return reactions.groupBy("message_id", "emoji").agg(F.count("*").alias("n"), F.bool_or(F.col("actor_id") == me).alias("mine"), F.min("at").alias("first_at"))


def rate_limited(calls: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """(key, at, seq) -> allowed: a window opens with the first call after the last one's end; refused calls extend nothing.

    The fold is sequential for each key. It takes calls in Arrow batches of a group in order and keeps two numbers
    between batches, so a key with very many calls needs no more memory than one batch.
    """
    import pyarrow as pa

    def fold(batches):
        opened, used, key = None, 0, None
        for batch in batches:
            keys, at = batch.column("key").to_pylist(), batch.column("at_ms").to_pylist()
            allowed = []
            for k, t in zip(keys, at):
                if k != key or opened is None or t - opened >= window_ms:
                    opened, used, key = t, 0, k
                used += 1
                allowed.append(used <= limit)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), pa.array(allowed, pa.bool_())], names=["key", "seq", "allowed"])

    timed = calls.select("key", "seq", (F.unix_micros(F.col("at").cast("timestamp")) / 1000).alias("at_ms"))
    return timed.repartition("key").sortWithinPartitions("key", "at_ms", "seq").mapInArrow(fold, "key long, seq long, allowed boolean")
