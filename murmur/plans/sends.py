"""Queries of outbound sends, chunked inserts and broadcasts, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import sends
from murmur.plans.queries import query
from murmur.sources import views

# --- a bot's answers to events ---


def _contacts(spark, sf_dir: str) -> DataFrame:
    """Numbers of three kinds: with a trunk zero, without, and some that are no numbers."""
    key = F.col("c_custkey")
    phone = F.when(key % 10 == 9, "none").when(key % 3 == 0, F.concat(F.lit("+3706"), (1000000 + key).cast("string"))).otherwise(F.concat(F.lit("37006"), (1000000 + key).cast("string")))
    return views.table(spark, sf_dir, "customer").select(key.alias("id"), (key % 50).alias("user_id"), phone.alias("phone"))


def _answers(spark, sf_dir: str) -> DataFrame:
    """The service knows numbers with a trunk zero of every second contact, without one of the others, and refuses some for another reason."""
    key = F.col("c_custkey")
    number = (1000000 + key).cast("string")
    known = F.when(key % 2 == 0, F.concat(F.lit("37006"), number)).otherwise(F.concat(F.lit("3706"), number))
    base = views.table(spark, sf_dir, "customer").filter(key % 7 != 3).select(known.alias("phone"), (key % 11 != 5).alias("accepted"), F.when(key % 11 == 5, "(#100) invalid parameter").alias("error"))
    return base


def _sends(spark, sf_dir: str) -> sends.Sends:
    i, user = F.col("event_id"), F.col("user_id")
    out = views.table(spark, sf_dir, "events").select(i.alias("send_id"), (user % 50 + F.when(i % 40 == 7, 1).otherwise(0)).alias("user_id"), user.alias("contact_id"), (user * 2 + i % 2).alias("conversation_id"), F.when(i % 4 == 0, "template").otherwise("text").alias("kind"), F.col("props").alias("text"), F.concat(F.lit("t"), (i % 3).cast("string")).alias("template"), F.col("ts").alias("at"))
    talks = views.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("last_message_text"), F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").alias("last_message_at"))
    return sends.send(out, _contacts(spark, sf_dir), _answers(spark, sf_dir), talks)


_SENT_SQL = """WITH people AS (SELECT c_custkey AS id, c_custkey % 50 AS user_id, CASE WHEN c_custkey % 10 = 9 THEN 'none' WHEN c_custkey % 3 = 0 THEN '+3706' || (1000000 + c_custkey) ELSE '37006' || (1000000 + c_custkey) END AS phone FROM customer),
  answers AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN '37006' ELSE '3706' END || (1000000 + c_custkey) AS phone, c_custkey % 11 <> 5 AS accepted, CASE WHEN c_custkey % 11 = 5 THEN '(#100) invalid parameter' END AS error FROM customer WHERE c_custkey % 7 <> 3),
  out AS (SELECT event_id AS send_id, user_id % 50 + (event_id % 40 = 7)::INTEGER AS user_id, user_id AS contact_id, user_id * 2 + event_id % 2 AS conversation_id, CASE WHEN event_id % 4 = 0 THEN 'template' ELSE 'text' END AS kind, props AS text, 't' || event_id % 3 AS template, ts AS "at" FROM events),
  owned AS (SELECT o.user_id, o.contact_id, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS number FROM (SELECT DISTINCT user_id, contact_id FROM out) o LEFT JOIN people p ON p.id = o.contact_id AND p.user_id = o.user_id),
  tries AS (SELECT user_id, contact_id, number, unnest([0, 1, 2, 3, 4, 5, 6]) AS place, unnest([number,
    CASE WHEN number[2] <> '0' THEN number[:1] || '0' || number[2:] END, CASE WHEN number[3] <> '0' THEN number[:2] || '0' || number[3:] END, CASE WHEN number[4] <> '0' THEN number[:3] || '0' || number[4:] END,
    CASE WHEN number[2] = '0' THEN number[:1] || number[3:] END, CASE WHEN number[3] = '0' THEN number[:2] || number[4:] END, CASE WHEN number[4] = '0' THEN number[:3] || number[5:] END]) AS phone FROM owned WHERE number <> ''),
  once AS (SELECT user_id, contact_id, number, phone, min(place) AS slot FROM tries WHERE phone IS NOT NULL GROUP BY ALL),
  told AS (SELECT *, row_number() OVER (PARTITION BY user_id, contact_id ORDER BY slot) - 1 AS place, coalesce(accepted, false) AS ok, CASE WHEN accepted THEN NULL ELSE coalesce(error, 'not in allowed list') END AS why FROM once LEFT JOIN answers USING (phone)),
  made AS (SELECT * FROM (SELECT *, coalesce(min(CASE WHEN ok OR why LIKE '%invalid%' THEN place END) OVER (PARTITION BY user_id, contact_id), 99) AS stop FROM told) WHERE place <= stop),
  ends AS (SELECT user_id, contact_id, number, arg_max({'to': phone, 'ok': ok, 'why': why}, place) AS e FROM made GROUP BY ALL),
  firsts AS (SELECT user_id, contact_id, arg_min(send_id, ("at", send_id)) AS first FROM out GROUP BY ALL)"""


@query(
    f"""{_SENT_SQL} SELECT send_id, contact_id, place, phone AS to, ok AS accepted, why AS error FROM out JOIN firsts USING (user_id, contact_id) JOIN made USING (user_id, contact_id) JOIN (SELECT user_id, contact_id, e FROM ends) USING (user_id, contact_id) WHERE send_id = first OR NOT e.ok
    UNION ALL SELECT send_id, contact_id, 0, e.to, true, NULL FROM out JOIN firsts USING (user_id, contact_id) JOIN ends USING (user_id, contact_id) WHERE send_id <> first AND e.ok"""
)
def send_attempts(spark, sf_dir: str) -> DataFrame:
    return _sends(spark, sf_dir).attempts.withColumn("place", F.col("place").cast("long"))


@query(f"""{_SENT_SQL} SELECT send_id, conversation_id, 'bot' AS sender_type, kind AS content_type, CASE WHEN kind = 'text' THEN text END AS content_text, CASE WHEN kind = 'template' THEN template END AS template_name, 'sent-' || send_id AS message_id, 'sent' AS status, e.to AS to, "at" FROM out JOIN ends USING (user_id, contact_id) WHERE e.ok""")
def sent_messages(spark, sf_dir: str) -> DataFrame:
    return _sends(spark, sf_dir).messages


@query(f"{_SENT_SQL} SELECT send_id, CASE WHEN number = '' THEN 'contact not found for this tenant' ELSE e.why END AS error FROM out JOIN owned USING (user_id, contact_id) LEFT JOIN (SELECT user_id, contact_id, e FROM ends) USING (user_id, contact_id) WHERE number = '' OR NOT e.ok")
def failed_sends(spark, sf_dir: str) -> DataFrame:
    return _sends(spark, sf_dir).failures


@query(f"{_SENT_SQL} SELECT id, p.user_id, coalesce(CASE WHEN e.ok AND e.to <> number THEN e.to END, phone) AS phone FROM people p LEFT JOIN ends ON ends.contact_id = id AND ends.user_id = p.user_id")
def healed_contacts(spark, sf_dir: str) -> DataFrame:
    return _sends(spark, sf_dir).contacts


@query(
    f"""{_SENT_SQL}, last AS (SELECT conversation_id AS id, arg_max(CASE WHEN kind = 'template' THEN '[template:' || template || ']' ELSE text END, ("at", send_id)) AS t, max("at") AS a FROM out JOIN ends USING (user_id, contact_id) WHERE e.ok GROUP BY 1)
    SELECT c_custkey * 2 AS id, CASE WHEN a IS NULL THEN c_name ELSE t END AS last_message_text, coalesce(a, TIMESTAMP '2023-12-31') AS last_message_at FROM customer LEFT JOIN last ON id = c_custkey * 2"""
)
def conversations_after_sends(spark, sf_dir: str) -> DataFrame:
    return _sends(spark, sf_dir).conversations


# --- broadcasts in chunks and batches ---


def _recipients(spark, sf_dir: str) -> DataFrame:
    """Seven broadcasts over the orders' customers; a stretch of orders has no number, and one row in 1,777 can't be inserted."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    phone = F.when(F.floor(key / 200) % 4 != 0, F.concat(F.lit("3706"), (1000000 + who).cast("string")))
    return views.table(spark, sf_dir, "orders").select((who % 7).alias("broadcast_id"), key.alias("recipient_id"), phone.alias("phone"), ((key % 1777 != 5) | (who % 7 < 4)).alias("fits"))


_CHUNKS_SQL = """WITH people AS (SELECT o_custkey % 7 AS broadcast_id, o_orderkey AS recipient_id, CASE WHEN o_orderkey // 200 % 4 <> 0 THEN '3706' || (1000000 + o_custkey) END AS phone, o_custkey AS who, o_orderkey % 1777 <> 5 OR o_custkey % 7 < 4 AS fits, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS ordinal FROM orders),
  rows AS (SELECT *, ordinal // 200 < coalesce(min(CASE WHEN NOT fits THEN ordinal // 200 END) OVER (PARTITION BY broadcast_id), 1000000000) AS written FROM people),
  inserted AS (SELECT broadcast_id, count(*) AS total, count(*) FILTER (written) AS inserted, CASE WHEN bool_and(written) THEN 'sending' ELSE 'failed' END AS status, CASE WHEN bool_and(written) THEN 0 ELSE count(*) END AS failed_count FROM rows GROUP BY 1),
  asked AS (SELECT *, ordinal // 10 AS batch, bool_or(phone IS NOT NULL) OVER (PARTITION BY broadcast_id, ordinal // 10) AS called FROM rows WHERE written),
  sent AS (SELECT broadcast_id, recipient_id, ordinal, batch, called AND s.status = 'sending' AS goes, CASE WHEN batch % 13 = 12 AND broadcast_id <> 2 OR broadcast_id = 1 THEN 'too many requests' WHEN phone IS NULL THEN 'no phone number on the contact' WHEN who % 9 = 4 THEN 'blocked' END AS why FROM asked JOIN (SELECT broadcast_id, status FROM inserted) s USING (broadcast_id)),
  told AS (SELECT broadcast_id, recipient_id, ordinal, batch, CASE WHEN NOT goes THEN 'pending' WHEN why IS NULL THEN 'sent' ELSE 'failed' END AS status, CASE WHEN goes THEN why END AS error FROM sent)"""


@query(f"{_CHUNKS_SQL} SELECT * FROM inserted")
def broadcast_inserts(spark, sf_dir: str) -> DataFrame:
    """Recipients in chunks of 200: what goes in before the first chunk that fails."""
    return sends.insert_outcomes(sends.insert_in_chunks(_recipients(spark, sf_dir), "broadcast_id", F.col("fits"), "recipient_id"), "broadcast_id")


def _broadcast(spark, sf_dir: str) -> DataFrame:
    people = _recipients(spark, sf_dir)
    who = F.col("o_custkey")
    answers = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("3706"), (1000000 + who).cast("string")).alias("phone"), (who % 9 != 4).alias("accepted"), F.when(who % 9 == 4, "blocked").alias("error"), F.col("o_orderkey").alias("seq"))
    # broadcast 1 has every batch refused, the others but one have a batch in 13 refused
    batches = views.table(spark, sf_dir, "orders").select((who % 7).alias("broadcast_id")).groupBy("broadcast_id").count()
    batches = batches.select("broadcast_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("count") / 10))).alias("batch"))
    refused = batches.filter("broadcast_id = 1 OR (batch % 13 = 12 AND broadcast_id != 2)").withColumn("error", F.lit("too many requests"))
    return sends.broadcast(people, answers, refused, F.col("fits"))


@query(f"{_CHUNKS_SQL} SELECT * FROM told")
def broadcast_recipients_sent(spark, sf_dir: str) -> DataFrame:
    return _broadcast(spark, sf_dir)


@query(
    f"""{_CHUNKS_SQL} SELECT broadcast_id, total, count(*) FILTER (t.status = 'sent') AS n_sent, count(*) FILTER (t.status = 'failed') AS n_failed, count(*) FILTER (t.status = 'pending') AS n_pending,
    CASE WHEN i.status = 'failed' OR count(*) FILTER (t.status = 'failed') = total THEN 'failed' ELSE 'sent' END AS status FROM inserted i LEFT JOIN told t USING (broadcast_id) GROUP BY broadcast_id, total, i.status"""
)
def broadcast_outcomes(spark, sf_dir: str) -> DataFrame:
    return sends.broadcast_outcomes(_broadcast(spark, sf_dir), broadcast_inserts(spark, sf_dir))


@query(
    """SELECT c_nationkey AS user_id, chunk, count(*) FILTER (good) AS imported, count(*) FILTER (NOT good) AS failed, NOT bool_and(good) AS row_by_row
    FROM (SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 AS chunk, c_acctbal > -990 AS good FROM customer) GROUP BY ALL"""
)
def import_chunks(spark, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("user_id"), "c_custkey", "c_acctbal")
    return sends.import_in_chunks(rows, "user_id", F.col("c_acctbal") > -990, "c_custkey")
