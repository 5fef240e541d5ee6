"""Outbound sends: numbers that heal themselves, chunked inserts that fail, and a broadcast from its audience to its outcome.

What the delivery service answers is an input: a table by phone, or by batch. Nothing here calls it.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.phone import digits, is_e164, is_not_allowed_error, variants
from murmur.operators.lineage import cut, placed

#: Rows of an insert of recipients and of an import, recipients of one call of the service.
INSERT, IMPORT, CALL = 200, 50, 10


# --- numbers that heal ---


@dataclass
class Sends:
    """attempts: a row a call of the service; messages: what was sent; failures: (send_id, error); contacts and conversations: the tables after."""

    attempts: DataFrame
    messages: DataFrame
    failures: DataFrame
    contacts: DataFrame
    conversations: DataFrame


def send(outgoing: DataFrame, contacts: DataFrame, answers: DataFrame, conversations: DataFrame) -> Sends:
    """outgoing (send_id, user_id, contact_id, conversation_id, kind, text, template, at), answers (phone, accepted, error).

    The number of a contact is tried first, then its variants with and without a trunk zero, in their order. The first that is
    accepted wins and becomes the contact's number; a refusal because the recipient is not allowed goes on to the next
    variant, any other one ends the send. What a number leads to is found once for each contact and not for each send:
    the first send of a contact makes all the calls, later ones begin with the healed number, or fail as it did.
    A number without an answer is refused as not allowed.
    """
    here = outgoing.select("user_id", F.col("contact_id").alias("id")).distinct()
    number = digits(F.col("phone"))
    owned = here.join(contacts.select("id", "user_id", "phone"), ["user_id", "id"], "left").withColumn("number", number)
    problem = F.when(number == "", "contact not found for this tenant").when(~is_e164(F.col("number")), "the contact's number is not valid")
    owned = owned.withColumn("problem", problem)
    calls = owned.filter("problem IS NULL").select("user_id", "id", "number", F.posexplode(variants(F.col("number"))).alias("place", "to"))
    told = answers.groupBy(F.col("phone").alias("to")).agg(F.bool_or("accepted").alias("accepted"), F.min("error").alias("error"))
    calls = calls.join(told, "to", "left").withColumns({"accepted": F.coalesce("accepted", F.lit(False)), "error": F.coalesce("error", F.lit("not in allowed list"))})
    last = F.col("accepted") | ~is_not_allowed_error(F.col("error"))
    # at most seven calls a contact
    each = calls.groupBy("user_id", "id", "number").agg(F.array_sort(F.collect_list(F.struct("place", "to", "accepted", F.when(~F.col("accepted"), F.col("error")).alias("error"), last.alias("last")))).alias("calls"))
    ends = F.array_position(F.transform("calls", lambda c: c["last"]), True)
    made = F.when(ends > 0, F.slice("calls", F.lit(1), F.greatest(ends, F.lit(1)).cast("int"))).otherwise(F.col("calls"))
    each = each.withColumn("calls", made).withColumn("final", F.element_at("calls", -1))
    known = cut(owned.select("user_id", "id", "problem").join(each, ["user_id", "id"], "left"))

    rows = outgoing.join(known.withColumnRenamed("id", "contact_id"), ["user_id", "contact_id"])
    order = F.struct("at", "send_id")
    first = outgoing.groupBy("user_id", "contact_id").agg(F.min_by("send_id", order).alias("__first"))
    rows = rows.join(first, ["user_id", "contact_id"])
    healed = F.when((F.col("send_id") != F.col("__first")) & F.col("final.accepted"), F.array(F.col("final").withField("place", F.lit(0)))).otherwise(F.col("calls"))
    attempts = rows.select("send_id", "contact_id", F.explode(healed).alias("c")).select("send_id", "contact_id", "c.place", "c.to", "c.accepted", "c.error")

    sent = rows.filter("final.accepted")
    template = F.col("kind") == "template"
    messages = sent.select("send_id", "conversation_id", F.lit("bot").alias("sender_type"), F.when(template, "template").otherwise("text").alias("content_type"), F.when(~template, F.col("text")).alias("content_text"), F.when(template, F.col("template")).alias("template_name"), F.concat(F.lit("sent-"), F.col("send_id").cast("string")).alias("message_id"), F.lit("sent").alias("status"), F.col("final.to").alias("to"), "at")
    failures = rows.filter(F.col("problem").isNotNull() | ~F.col("final.accepted")).select("send_id", F.coalesce("problem", "final.error").alias("error"))
    won = known.filter("final.accepted AND final.to != number").select("user_id", "id", F.col("final.to").alias("__to"))
    after = contacts.join(won, ["user_id", "id"], "left").withColumn("phone", F.coalesce("__to", "phone")).select(*contacts.columns)
    shown = F.when(template, F.concat(F.lit("[template:"), "template", F.lit("]"))).otherwise(F.col("text"))
    preview = sent.groupBy(F.col("conversation_id").alias("id")).agg(F.max_by(shown, order).alias("__text"), F.max("at").alias("__at"))
    talks = conversations.join(preview, "id", "left")
    changed = {"last_message_text": F.when(F.col("__at").isNotNull(), F.col("__text")).otherwise(F.col("last_message_text")), "last_message_at": F.coalesce("__at", "last_message_at")}
    return Sends(attempts, messages, failures, after, talks.select(*[changed.get(c, F.col(c)).alias(c) for c in conversations.columns]))


# --- chunked inserts ---


def insert_in_chunks(rows: DataFrame, group: str, good: Column, *order: str, size: int = INSERT) -> DataFrame:
    """rows with ordinal, chunk and written: chunks of a group are inserted in order, and none from the first that fails on.

    A chunk fails whole if one of its rows does. The first failing chunk is a minimum by group.
    """
    judged = placed(rows.withColumn("__good", F.coalesce(good, F.lit(False))), group, *order).withColumn("chunk", F.floor(F.col("ordinal") / size))
    broken = judged.filter(~F.col("__good")).groupBy(F.col(group).alias("__group")).agg(F.min("chunk").alias("__broken"))
    rows = judged.join(broken, F.col(group).eqNullSafe(F.col("__group")), "left")
    return rows.withColumn("written", F.coalesce(F.col("chunk") < F.col("__broken"), F.lit(True))).drop("__good", "__broken", "__group")


def insert_outcomes(inserted: DataFrame, group: str) -> DataFrame:
    """One row a group: total and inserted rows; a group with a chunk that failed is failed, with all its rows as failed_count."""
    n, done = F.count("*"), F.count_if("written")
    return inserted.groupBy(group).agg(n.alias("total"), done.alias("inserted"), F.when(n == done, "sending").otherwise("failed").alias("status"), F.when(n == done, 0).otherwise(n).cast("long").alias("failed_count"))


def import_in_chunks(rows: DataFrame, group: str, good: Column, *order: str, size: int = IMPORT) -> DataFrame:
    """One row a chunk of a group's file: imported, failed, and whether it was inserted row by row, because as a whole it failed.

    Row by row, each good row goes in, so a bad one costs its own row only.
    """
    judged = placed(rows.withColumn("__good", F.coalesce(good, F.lit(False))), group, *order).withColumn("chunk", F.floor(F.col("ordinal") / size))
    bad = F.count_if(~F.col("__good"))
    return judged.groupBy(group, "chunk").agg(F.count_if("__good").alias("imported"), bad.alias("failed"), (bad > 0).alias("row_by_row"))


# --- a broadcast ---


def broadcast(recipients: DataFrame, answers: DataFrame, refused: DataFrame, insertable: Column, size: int = CALL, chunk: int = INSERT) -> DataFrame:
    """recipients (broadcast_id, recipient_id, phone) -> a row a recipient that was inserted: ordinal, batch, status and error.

    Recipients are inserted in chunks; a broadcast whose insert failed sends nothing, and what was inserted stays pending. Others
    are sent in batches: a batch without any number is skipped and stays pending; a batch that the service refuses
    (refused: broadcast_id, batch, error) fails whole; else each recipient has the answer (phone, accepted, error) for its
    number, or fails for want of one.
    """
    rows = insert_in_chunks(recipients, "broadcast_id", insertable, "recipient_id", size=chunk)
    started = insert_outcomes(rows, "broadcast_id").select("broadcast_id", (F.col("status") == "sending").alias("__sends"))
    rows = rows.filter("written").withColumn("batch", F.floor(F.col("ordinal") / size)).join(started, "broadcast_id")
    numbered = rows.filter(F.coalesce("phone", F.lit("")) != "").select("broadcast_id", "batch").distinct().withColumn("__called", F.lit(True))
    told = answers.groupBy("phone").agg(F.max_by("accepted", "seq").alias("accepted"), F.max_by("error", "seq").alias("error"))
    rows = rows.join(numbered, ["broadcast_id", "batch"], "left").join(refused.select("broadcast_id", "batch", F.col("error").alias("__refused")), ["broadcast_id", "batch"], "left").join(told, "phone", "left")
    called = F.col("__sends") & F.coalesce("__called", F.lit(False))
    error = F.when(F.col("__refused").isNotNull(), F.col("__refused")).when(F.col("accepted").isNull(), "no phone number on the contact").when(~F.col("accepted"), F.coalesce("error", F.lit("unknown error")))
    status = F.when(~called, "pending").when(error.isNotNull(), "failed").otherwise("sent")
    return rows.select("broadcast_id", "recipient_id", "ordinal", "batch", status.alias("status"), F.when(called, error).alias("error"))


def broadcast_outcomes(sent: DataFrame, inserted: DataFrame) -> DataFrame:
    """(broadcast) rows of ``broadcast`` and of ``insert_outcomes`` -> one row a broadcast, failed if its insert failed or if every recipient did."""
    counts = sent.groupBy("broadcast_id").agg(F.count_if(F.col("status") == "sent").alias("n_sent"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "pending").alias("n_pending"))
    rows = inserted.select("broadcast_id", "total", F.col("status").alias("begun")).join(counts, "broadcast_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    failed = (F.col("begun") == "failed") | (F.coalesce("n_failed", F.lit(0)) == F.col("total"))
    return rows.select("broadcast_id", "total", zero("n_sent"), zero("n_failed"), zero("n_pending"), F.when(failed, "failed").otherwise("sent").alias("status"))
