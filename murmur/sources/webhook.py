"""Webhook bodies: entry -> changes -> statuses and messages, each message with its contact."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MEDIA = "struct<id:string,mime_type:string,caption:string,filename:string>"
SCHEMA = (
    "entry array<struct<id:string,changes:array<struct<value:struct<metadata:struct<phone_number_id:string>,"
    "contacts:array<struct<profile:struct<name:string>,wa_id:string>>,"
    f"messages:array<struct<id:string,`from`:string,timestamp:string,type:string,text:struct<body:string>,image:{_MEDIA},video:{_MEDIA},document:{_MEDIA},audio:{_MEDIA},sticker:{_MEDIA},"
    "location:struct<latitude:double,longitude:double,name:string,address:string>,reaction:struct<message_id:string,emoji:string>,context:struct<id:string>>>,"
    "statuses:array<struct<id:string,status:string,timestamp:string,recipient_id:string>>>>>>>"
)


def explode_webhook(bodies: DataFrame) -> dict[str, DataFrame]:
    """(body) -> frames "messages" and "statuses". A change without messages or contacts has no messages.

    The i-th message belongs to the i-th contact, or to the first.
    """
    parsed = bodies.select(F.from_json("body", SCHEMA).alias("b"))
    value = parsed.select(F.explode("b.entry").alias("e")).select(F.explode("e.changes").alias("c")).select("c.value.*")
    seconds = lambda c: F.timestamp_seconds(c.cast("long"))
    states = value.select(F.explode("statuses").alias("s")).select("s.id", "s.status", seconds(F.col("s.timestamp")).alias("at"), "s.recipient_id")
    both = value.filter(F.col("messages").isNotNull() & F.col("contacts").isNotNull())
    rows = both.select("contacts", F.col("metadata.phone_number_id").alias("phone_number_id"), F.posexplode("messages").alias("i", "m"))
    person = F.coalesce(F.get("contacts", F.col("i")), F.get("contacts", F.lit(0)))
    kind = F.col("m.type")
    place = F.concat_ws(" - ", F.nullif(F.col("m.location.name"), F.lit("")), F.nullif(F.col("m.location.address"), F.lit("")), F.concat_ws(", ", F.col("m.location.latitude").cast("string"), F.col("m.location.longitude").cast("string")))
    content = F.when(kind == "text", F.col("m.text.body")).when(kind == "location", place).when(kind == "image", F.col("m.image.caption")).when(kind == "video", F.col("m.video.caption")).when(kind == "document", F.coalesce("m.document.caption", "m.document.filename")).when(kind == "reaction", F.col("m.reaction.emoji"))
    shown = F.when(kind == "sticker", "image").when(kind.isin("text", "image", "video", "document", "audio", "location", "reaction"), kind).otherwise("text")
    messages = rows.select(F.col("m.id").alias("id"), F.col("m.from").alias("sender"), shown.alias("kind"), content.alias("content"), seconds(F.col("m.timestamp")).alias("sent_at"), F.col("m.context.id").alias("reply_to"), F.col("m.reaction.message_id").alias("reacted_to"), person["profile"]["name"].alias("contact_name"), "phone_number_id")
    return {"messages": messages, "statuses": states}
