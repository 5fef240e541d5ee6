"""Queries of change feeds as batches, with DuckDB SQL; the streams of the same folds are held against them in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.plans.queries import NOW, query
from murmur.sources import views
from murmur.streaming import feeds

#: What an event of each type is in a feed of messages, and which columns it carries.
OPS = {"signup": "INSERT", "purchase": "INSERT", "error": "DELETE", "click": "UPDATE", "view": "UPDATE"}


def message_changes(spark, sf_dir: str) -> DataFrame:
    """A feed over 2,000 ids: inserts, some of them replayed, partial updates of one or two columns, deletes, provisional ids."""
    i = F.col("event_id")
    op = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])[F.col("event_type")]
    number = (i * 7 % 2000).cast("string")
    changed = F.when(i % 3 == 0, F.array(F.lit("status"))).when(i % 3 == 1, F.array(F.lit("body"))).otherwise(F.array(F.lit("status"), F.lit("body")))
    status = F.when(i % 11 != 0, F.concat(F.lit("s"), (i % 5).cast("string")))
    return views.table(spark, sf_dir, "events").select(F.concat(F.when(i % 17 == 0, "temp-").otherwise("m"), number).alias("id"), op.alias("op"), F.col("ts").alias("at"), i.alias("seq"), changed.alias("changed"), status.alias("status"), F.col("props").alias("body"), F.col("user_id").alias("conversation_id"))


@query(
    """WITH feed AS (SELECT CASE WHEN event_id % 17 = 0 THEN 'temp-' ELSE 'm' END || event_id * 7 % 2000 AS id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op, (ts, event_id) AS o, event_id % 3 AS r,
      CASE WHEN event_id % 11 <> 0 THEN 's' || event_id % 5 END AS status, props AS body, user_id AS conversation_id FROM events),
    born AS (SELECT id, min(o) AS o, arg_min({'status': status, 'body': body, 'c': conversation_id}, o) AS f FROM feed WHERE op = 'INSERT' AND id NOT LIKE 'temp-%' GROUP BY id),
    later AS (SELECT id, arg_max({'x': status}, feed.o) FILTER (r <> 1) AS s, arg_max({'x': body}, feed.o) FILTER (r <> 0) AS b FROM feed JOIN born USING (id) WHERE op = 'UPDATE' AND feed.o > born.o GROUP BY id)
    SELECT id, CASE WHEN s IS NULL THEN f.status ELSE s.x END AS status, CASE WHEN b IS NULL THEN f.body ELSE b.x END AS body, f.c AS conversation_id FROM born LEFT JOIN later USING (id)"""
)
def merged_messages(spark, sf_dir: str) -> DataFrame:
    return feeds.merged_feed(message_changes(spark, sf_dir), "id", ["status", "body", "conversation_id"])


def reaction_requests(spark, sf_dir: str) -> DataFrame:
    """Reactions that a client shows before the server answers: an event is an ask, one in three is confirmed a minute later, one in four rejected, others never answered."""
    i = F.col("event_id")
    e = views.table(spark, sf_dir, "events").select((i % 400).alias("message_id"), (F.col("user_id") % 3).alias("actor_id"), i.cast("string").alias("request"), F.when(i % 9 == 0, "").otherwise(F.col("event_type")).alias("value"), F.col("ts").alias("at"), i.alias("seq"))
    later = e.withColumn("kind", F.when(F.col("seq") % 3 == 0, "confirm").when(F.col("seq") % 4 == 0, "reject")).filter("kind IS NOT NULL")
    later = later.withColumns({"at": F.col("at") + F.expr("INTERVAL 1 MINUTE"), "seq": F.col("seq") + F.lit(10_000_000)})
    return e.withColumn("kind", F.lit("ask")).unionByName(later)


@query(
    f"""WITH asks AS (SELECT event_id, event_id % 400 AS message_id, user_id % 3 AS actor_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS value, ts FROM events),
    last AS (SELECT message_id, actor_id, arg_max({{'i': event_id, 'v': value, 't': ts}}, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) FILTER (event_id % 3 = 0) AS settled FROM asks GROUP BY ALL),
    open AS (SELECT *, a.i % 3 <> 0 AND a.i % 4 <> 0 AND a.t + INTERVAL 2 DAY > TIMESTAMP '{NOW}' AS pending FROM last)
    SELECT message_id, actor_id, CASE WHEN pending THEN a.v ELSE coalesce(settled, '') END AS shown, pending FROM open"""
)
def optimistic_reactions(spark, sf_dir: str) -> DataFrame:
    return feeds.optimistic(reaction_requests(spark, sf_dir), ["message_id", "actor_id"], F.lit(NOW).cast("timestamp_ntz"), "2 DAY")
