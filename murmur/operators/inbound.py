"""Inbound messages as one plan a table: contacts and conversations they need, rows to insert, previews, triggers, reactions.

Input is the frame "messages" of ``explode_webhook`` for one tenant. A number belongs to the contact of the smallest id
whose last eight digits are the same; an unknown number makes one contact, whose name is that of its first message. A
conversation has the id of its contact. New ids are hashes of the number, so a repeated batch makes the same rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions.phone import digits, match_key
from murmur.operators.contacts import match_phones


def resolved(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """messages with phone, contact_id and was_created (true on the first message of an unknown number)."""
    m = match_phones(messages.withColumn("phone", digits(F.col("sender"))), contacts.select("id", "phone")).withColumnRenamed("contact_id", "known")
    key = F.coalesce(match_key(F.col("phone")), F.col("phone"))
    first = F.row_number().over(Window.partitionBy("contact_id").orderBy("sent_at", "id")) == 1
    return m.withColumn("contact_id", F.coalesce("known", -F.abs(F.xxhash64(key)))).withColumn("was_created", F.col("known").isNull() & first)


def new_contacts(rows: DataFrame) -> DataFrame:
    return rows.filter("was_created").select(F.col("contact_id").alias("id"), "phone", F.coalesce("contact_name", F.col("phone")).alias("name"))


def inserts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages to insert, with the stored or new message they answer (null if it is not in their conversation) and first_inbound.

    stored: (id, conversation_id, sender_type). Reactions are no messages.
    """
    m = rows.filter("kind != 'reaction'").withColumn("conversation_id", F.col("contact_id"))
    heard = stored.filter("sender_type = 'customer'").select("conversation_id").distinct().withColumn("heard", F.lit(True))
    turn = F.row_number().over(Window.partitionBy("conversation_id").orderBy("sent_at", "id"))
    m = m.join(heard, "conversation_id", "left").withColumn("first_inbound", F.col("heard").isNull() & (turn == 1))
    parents = stored.select("conversation_id", F.col("id").alias("reply_to")).unionByName(m.select("conversation_id", F.col("id").alias("reply_to"))).distinct().withColumn("there", F.lit(True))
    m = m.join(parents, ["conversation_id", "reply_to"], "left")
    return m.select("id", "conversation_id", F.lit("customer").alias("sender_type"), "kind", "content", "sent_at", F.when(F.col("there"), F.col("reply_to")).alias("reply_to"), "first_inbound", "was_created")


def previews(inserted: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, last_message_text, last_message_at, unread_count) of the conversations that inserted messages touch."""
    shown = F.coalesce(F.nullif("content", F.lit("")), F.concat(F.lit("["), "kind", F.lit("]")))
    new = inserted.groupBy("conversation_id").agg(F.max_by(shown, F.struct("sent_at", "id")).alias("last_message_text"), F.max("sent_at").alias("last_message_at"), F.count("*").alias("n"))
    old = conversations.select("conversation_id", F.col("unread_count").alias("old"))
    return new.join(old, "conversation_id", "left").select("conversation_id", "last_message_text", "last_message_at", (F.coalesce("old", F.lit(0)) + F.col("n")).alias("unread_count"))


def triggers(inserted: DataFrame, keyword: Column) -> DataFrame:
    """(id, place, trigger): what each message fires, in order; was_created fires on the message that made its contact."""
    fired = F.array(F.when(F.col("first_inbound"), F.lit("first_inbound_message")), F.when(F.col("was_created"), F.lit("new_contact_created")), F.lit("new_message_received"), F.when(keyword, F.lit("keyword_match")))
    return inserted.select("id", F.posexplode(F.filter(fired, lambda x: x.isNotNull())).alias("place", "trigger"))


def reactions(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The last reaction of each contact to each stored message of its conversation; empty takes it back, unknown messages drop it."""
    r = rows.filter("kind = 'reaction'").select(F.col("contact_id").alias("conversation_id"), F.col("reacted_to").alias("message_id"), F.coalesce("content", F.lit("")).alias("emoji"), "sent_at", "id")
    there = stored.select("conversation_id", F.col("id").alias("message_id")).distinct()
    last = r.join(there, ["conversation_id", "message_id"], "left_semi").groupBy("message_id", "conversation_id").agg(F.max_by("emoji", F.struct("sent_at", "id")).alias("emoji"), F.max("sent_at").alias("at"))
    return last.filter("emoji != ''").withColumnRenamed("conversation_id", "actor_id")
