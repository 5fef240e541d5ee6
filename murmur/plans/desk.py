"""Queries of replies, the inbound batch up to its runs, boards, lookups, forms and labels, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import dates, numbers, text
from murmur.operators import desk, inbound, messaging, replies, rules, status, templates
from murmur.plans import changes as c
from murmur.plans.queries import NOW, query
from murmur.sources import views

# --- replies ---


def _recipients(spark, sf_dir: str) -> DataFrame:
    """Recipients of broadcasts of the contact's own tenant; rows have no key of their own, so equal ones are numbered."""
    from pyspark.sql.window import Window

    supplier = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("broadcast_id"), (F.col("s_suppkey") % 5).alias("tenant"))
    r = views.recipients(spark, sf_dir).join(supplier, "broadcast_id").filter(F.col("contact_id") % 5 == F.col("tenant"))
    name = F.concat_ws("-", F.lpad(F.col("order_id").cast("string"), 12, "0"), F.lpad(F.col("part_id").cast("string"), 12, "0"), F.lpad(F.col("broadcast_id").cast("string"), 12, "0"), "status")
    r = r.withColumn("name", name)
    twice = F.row_number().over(Window.partitionBy("name", "created_at").orderBy("contact_id"))
    return r.withColumn("name", F.concat_ws("-", "name", F.date_format("created_at", "yyyyMMdd"), F.lpad(twice.cast("string"), 3, "0")))


def _answered(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = _recipients(spark, sf_dir)
    messages = views.table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("contact_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("reply_id"))
    found = replies.answered_recipients(r.select("contact_id", "created_at", "status", F.col("name").alias("order"), F.struct("name", "broadcast_id", "status").alias("payload")), messages)
    return r, found


_STACK_SQL = """WITH named AS (SELECT contact_id, created_at, broadcast_id, status, lpad(order_id::VARCHAR, 12, '0') || '-' || lpad(part_id::VARCHAR, 12, '0') || '-' || lpad(broadcast_id::VARCHAR, 12, '0') || '-' || status AS n FROM recipients JOIN supplier ON s_suppkey = broadcast_id WHERE contact_id % 5 = s_suppkey % 5),
  people AS (SELECT *, n || '-' || strftime(created_at, '%Y%m%d') || '-' || lpad((row_number() OVER (PARTITION BY n, created_at ORDER BY contact_id))::VARCHAR, 3, '0') AS name FROM named),
  moves AS (SELECT contact_id, created_at AS t, 1 AS d, name AS tie, name, broadcast_id, status, NULL AS reply_id FROM people WHERE status IN ('sent', 'delivered', 'read') UNION ALL SELECT o_custkey, o_orderdate, -1, lpad(o_orderkey::VARCHAR, 20, '0'), NULL, NULL, NULL, o_orderkey FROM orders WHERE o_orderkey % 2 = 0),
  sums AS (SELECT *, sum(d) OVER w AS s FROM moves WINDOW w AS (PARTITION BY contact_id ORDER BY t, d DESC, tie ROWS UNBOUNDED PRECEDING)),
  lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY contact_id ORDER BY t, d DESC, tie ROWS UNBOUNDED PRECEDING)) AS low FROM sums),
  works AS (SELECT *, s - low + (d = -1)::INTEGER AS level, d = 1 OR low = coalesce(lag(low) OVER (PARTITION BY contact_id ORDER BY t, d DESC, tie), 0) AS ok FROM lows),
  taken AS (SELECT reply_id, contact_id, t, d, lag({'name': name, 'b': broadcast_id, 's': status}) OVER (PARTITION BY contact_id, level ORDER BY t, d DESC, tie) AS p FROM works WHERE ok),
  answered AS (SELECT reply_id, contact_id, t AS "at", p FROM taken WHERE d = -1)"""


def _with(sql: str) -> str:
    return sql.replace("WITH ", f"WITH recipients AS ({views.SQL['recipients']}), ", 1)


@query(_with(f'{_STACK_SQL} SELECT reply_id, contact_id, "at", p.name AS recipient, p.b AS broadcast_id FROM answered'))
def answered_broadcasts(spark, sf_dir: str) -> DataFrame:
    """Several replies of a contact to several recipient rows."""
    return _answered(spark, sf_dir)[1].select("reply_id", "contact_id", "at", F.col("payload.name").alias("recipient"), "payload.broadcast_id")


@query(_with(f"{_STACK_SQL} SELECT name, broadcast_id, contact_id, CASE WHEN a.at IS NOT NULL THEN 'replied' ELSE status END AS status, a.at AS replied_at FROM people LEFT JOIN (SELECT p.name AS name, \"at\" FROM answered) a USING (name)"))
def recipients_after_replies(spark, sf_dir: str) -> DataFrame:
    r, found = _answered(spark, sf_dir)
    return replies.recipients_after(r, found, "name").select("name", "broadcast_id", "contact_id", "status", "replied_at")


_COUNTED = "CASE {0} WHEN 'sent' THEN ['sent'] WHEN 'delivered' THEN ['sent', 'delivered'] WHEN 'read' THEN ['sent', 'delivered', 'read'] ELSE ['sent', 'delivered', 'read', 'replied'] END"


@query(_with(f"{_STACK_SQL} SELECT broadcast_id, counter, greatest(0, sum(d))::BIGINT AS n FROM (SELECT p.b AS broadcast_id, unnest({_COUNTED.format(chr(39) + 'replied' + chr(39))}) AS counter, 1 AS d FROM answered UNION ALL SELECT p.b, unnest({_COUNTED.format('p.s')}), -1 FROM answered) GROUP BY ALL"))
def reply_counter_deltas(spark, sf_dir: str) -> DataFrame:
    """What the replies add to the counters of their broadcasts."""
    found = _answered(spark, sf_dir)[1]
    return status.counter_deltas(found.select("payload.broadcast_id", F.col("payload.status").alias("old"), F.lit("replied").alias("new")))


# --- from inbound messages to runs ---

TRIGGERS = ("first_inbound_message", "new_contact_created", "new_message_received", "keyword_match")


@query(
    f"""{c._ARRIVED_SQL}, fired AS (SELECT id, unnest([CASE WHEN first_inbound THEN 'first_inbound_message' END, CASE WHEN was_created THEN 'new_contact_created' END, 'new_message_received', 'keyword_match']) AS trigger, content FROM ins),
    rules AS (SELECT c_custkey AS automation_id, ['first_inbound_message', 'new_contact_created', 'new_message_received', 'keyword_match'][c_custkey % 4 + 1] AS trigger, '"k": ' || c_custkey % 10 AS word FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey < 100)
    SELECT id, automation_id, trigger FROM fired JOIN rules USING (trigger) WHERE trigger <> 'keyword_match' OR content <> '' AND contains(lower(content), word)""",
    "contacts",
)
def inbound_runs(spark, sf_dir: str) -> DataFrame:
    """Messages fire up to four triggers, and each meets the rules that listen to it; keywords are those of the rule."""
    key = F.col("c_custkey")
    listens = views.table(spark, sf_dir, "customer").filter("c_custkey < 100").select(key.alias("id"), F.lit(1).alias("user_id"), F.element_at(F.array(*map(F.lit, TRIGGERS)), (key % 4 + 1).cast("int")).alias("trigger"), F.array(F.concat(F.lit('"K": '), (key % 10).cast("string"))).alias("keywords"), F.lit("contains").alias("match_type"), F.lit(False).alias("case_sensitive"), (key % 5 != 0).alias("is_active"))
    made = inbound.inserts(*c._arrived(spark, sf_dir))
    fired = inbound.triggers(made, F.lit(True)).join(made.select("id", F.col("content").alias("text")), "id").withColumn("user_id", F.lit(1))
    matches = rules.rule_matches(F.col("text"), F.col("keywords"), F.col("match_type"), F.col("case_sensitive"))
    return replies.dispatch_fired(fired, listens, matches).select("id", "automation_id", "trigger")


# --- boards, tags, reactions ---


def _deals(spark, sf_dir: str) -> DataFrame:
    d = views.deals(spark, sf_dir)
    return d.withColumns({"assigned_to": F.when(F.col("id") % 3 != 0, F.col("id") % 40), "created_at": F.col("updated_at"), "contact_id": F.when(F.col("id") % 7 != 0, F.col("contact_id"))})


@query(
    """SELECT d.id, stage_id, (row_number() OVER (PARTITION BY stage_id ORDER BY updated_at DESC, d.id) - 1) AS place, c.name AS contact, CASE WHEN d.id % 3 <> 0 AND d.id % 40 % 5 <> 1 THEN 'p' || d.id % 40 END AS assignee
    FROM deals d LEFT JOIN contacts c ON c.id = CASE WHEN d.id % 7 <> 0 THEN d.contact_id END WHERE stage_id <> '5-LOW'""",
    "deals", "contacts",
)
def board_deals(spark, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    agents = views.table(spark, sf_dir, "customer").filter("c_custkey < 40 AND c_custkey % 5 != 1").select(key.alias("user_id"), F.concat(F.lit("p"), key.cast("string")).alias("agent"))
    rows = desk.board_deals(_deals(spark, sf_dir), views.stages(spark, sf_dir).filter("stage_id != '5-LOW'"), views.contacts(spark, sf_dir), agents)
    return rows.select("id", "stage_id", F.col("ordinal").alias("place"), F.col("contact.name").alias("contact"), "assignee")


@query(
    """WITH sums AS (SELECT stage_id, CASE WHEN position % 2 = 0 THEN '#00aa00' ELSE '#64748b' END AS colour, count(*) AS n, sum(coalesce(value, 0))::DOUBLE AS total FROM deals JOIN stages USING (stage_id) WHERE status = 'open' GROUP BY ALL)
    SELECT * FROM sums UNION ALL SELECT NULL, NULL, sum(n)::BIGINT, sum(total) FROM sums""".replace("WITH ", "WITH deals AS (" + views.SQL["deals"] + "), stages AS (" + views.SQL["stages"] + "), ", 1)
)
def board_totals(spark, sf_dir: str) -> DataFrame:
    stages = views.stages(spark, sf_dir).withColumn("colour", F.when(F.col("position") % 2 == 0, "#00aa00"))
    return desk.board_totals(views.deals(spark, sf_dir), stages)


@query("SELECT contact_id, tag, 'c' || substring(tag, 1, 1) AS colour FROM contact_tags WHERE tag <> '3-MEDIUM'", "contact_tags")
def sidebar_tags(spark, sf_dir: str) -> DataFrame:
    known = views.stages(spark, sf_dir).filter("stage_id != '3-MEDIUM'").select(F.col("stage_id").alias("tag"), F.concat(F.lit("c"), F.substring("stage_id", 1, 1)).alias("colour"))
    return desk.tags_shown(views.contact_tags(spark, sf_dir), known)


def _reactions(spark, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    last = e.select(F.floor(F.col("event_id") / 7).alias("message_id"), (F.col("user_id") % 30).alias("actor_id"), F.col("event_type").alias("emoji"), F.col("ts").alias("at"), F.col("event_id").alias("seq")).groupBy("message_id", "actor_id").agg(F.max_by("emoji", F.struct("at", "seq")).alias("emoji"), F.max("at").alias("at"))
    return last.withColumns({"actor_type": F.when(F.col("message_id") % 2 == 0, "agent").otherwise("customer"), "conversation_id": F.col("message_id") % 50})


_LAST = """last AS (SELECT event_id // 7 AS message_id, user_id % 30 AS actor_id, arg_max(event_type, (ts, event_id)) AS emoji, max(ts) AS "at" FROM events GROUP BY ALL)"""


@query(f"""WITH {_LAST} SELECT message_id, string_agg(actor_id || ':' || emoji, ',' ORDER BY "at", actor_id) AS reactions FROM last GROUP BY 1""")
def reactions_by_message(spark, sf_dir: str) -> DataFrame:
    rows = desk.reactions_by_message(_reactions(spark, sf_dir))
    return rows.select("message_id", F.array_join(F.transform("reactions", lambda r: F.concat_ws(":", r["actor_id"].cast("string"), r["emoji"])), ",").alias("reactions"))


@query(f"""WITH {_LAST} SELECT message_id, actor_id, emoji FROM last WHERE message_id % 2 = 0 AND actor_id = 12 AND message_id % 50 IN (SELECT c_custkey FROM customer WHERE c_custkey < 50 AND c_custkey % 4 <> 3)""")
def own_reactions(spark, sf_dir: str) -> DataFrame:
    owned = views.table(spark, sf_dir, "customer").filter("c_custkey < 50").select(F.col("c_custkey").alias("conversation_id"), F.when(F.col("c_custkey") % 4 != 3, 12).otherwise(13).alias("user_id"))
    return desk.may_change(_reactions(spark, sf_dir), owned, F.lit(12)).select("message_id", "actor_id", "emoji")


# --- lookups, stamped changes, new profiles ---


@query(
    """SELECT c_custkey AS contact_id, CASE WHEN n = 1 THEN first END AS id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' END AS problem FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1) USING (c_custkey)"""
)
def single_conversation(spark, sf_dir: str) -> DataFrame:
    talks = views.table(spark, sf_dir, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("contact_id"), F.col("o_orderkey").alias("id"))
    return desk.looked_up_once(views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contact_id")), talks, ["contact_id"], "id")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE o_orderdate END AS updated_at FROM orders")
def stamped_changes(spark, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    new = o.filter("o_custkey % 2 = 0 AND o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("P").alias("status"))
    return desk.stamped(rows, new, ["id"], F.lit(NOW).cast("timestamp_ntz"))


@query("SELECT o_custkey AS user_id, coalesce(min(c_name), '') AS full_name, min(o_orderpriority || '@x') AS email FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey WHERE o_custkey % 4 <> 0 GROUP BY 1")
def new_profiles(spark, sf_dir: str) -> DataFrame:
    c_ = views.table(spark, sf_dir, "customer")
    accounts = views.table(spark, sf_dir, "orders").join(c_.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    accounts = accounts.select(F.col("o_custkey").alias("user_id"), F.col("c_name").alias("full_name"), F.concat("o_orderpriority", F.lit("@x")).alias("email"))
    return desk.profiles_of(accounts, c_.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id")))


# --- forms and labels ---


@query(
    """SELECT o_orderkey AS id, nullif(trim(CASE WHEN o_orderkey % 5 = 0 THEN '   ' ELSE ' ' || o_orderpriority || ' ' END), '') AS notes, coalesce(TRY_CAST(regexp_extract(ltrim(CASE o_orderkey % 6 WHEN 0 THEN o_totalprice::VARCHAR || ' EUR' WHEN 1 THEN 'EUR 5' WHEN 2 THEN '  -' || o_orderkey WHEN 3 THEN '.5e1x' WHEN 4 THEN '1,000' ELSE '' END), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?', 0) AS DOUBLE), 0) AS value,
    starts_with(o_orderpriority, '1-') AS urgent, CASE WHEN o_orderkey % 60 > 20 THEN '5,10,20,50' WHEN o_orderkey % 60 > 10 THEN '5,10,20' WHEN o_orderkey % 60 > 5 THEN '5,10' ELSE '5' END AS sizes FROM orders"""
)
def deal_forms(spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    written = F.when(key % 6 == 0, F.concat(F.format_string("%.2f", "o_totalprice"), F.lit(" EUR"))).when(key % 6 == 1, "EUR 5").when(key % 6 == 2, F.concat(F.lit("  -"), key.cast("string"))).when(key % 6 == 3, ".5e1x").when(key % 6 == 4, "1,000").otherwise("")
    notes = F.when(key % 5 == 0, "   ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return views.table(spark, sf_dir, "orders").select(key.alias("id"), F.nullif(F.trim(notes), F.lit("")).alias("notes"), numbers.parsed(written).alias("value"), F.startswith("o_orderpriority", F.lit("1-")).alias("urgent"), F.array_join(numbers.useful_sizes(key % 60, [5, 10, 20, 50]), ",").alias("sizes"))


@query(
    f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'never' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS since,
    CASE WHEN value < 1 THEN floor(value * 60 + 0.5)::BIGINT || 's' WHEN value < 60 THEN floor(value + 0.5)::BIGINT || 'm' ELSE (floor(value / 6 + 0.5) / 10)::DECIMAL(18,1) || 'h' END AS duration, '$' || floor(value + 0.5)::BIGINT AS currency, strftime(ts, '%Y-%m-%d') AS day,
    CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN '[Image]' ELSE '[Message]' END AS preview, CASE WHEN user_id % 2 = 0 THEN 'UX' ELSE 'U' END AS initials, 'file-' || user_id || '-a_b-' AS slug, '"' || replace(props, '"', '""') || '"' AS field
    FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) + 500000) // 1000000 AS s FROM events)"""
)
def message_labels(spark, sf_dir: str) -> DataFrame:
    """Labels of messages: ages, spans, amounts, previews, initials, file names and quoted fields."""
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    return views.table(spark, sf_dir, "events").select(
        i, dates.since(F.when(i % 5 != 0, F.col("ts")), F.lit(NOW).cast("timestamp_ntz")).alias("since"), dates.duration(F.col("value")).alias("duration"), F.replace(numbers.currency(F.col("value")), F.lit(","), F.lit("")).alias("currency"), dates.day_key(F.col("ts")).alias("day"),
        text.preview(F.when(i % 3 == 1, "image").otherwise("odd"), F.when(i % 3 == 0, F.col("props"))).alias("preview"), text.initials(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" user  x"), user, F.lit(" y"))).otherwise(F.concat(F.lit("u"), user))).alias("initials"),
        text.slug(F.concat(F.lit("File ("), user, F.lit(")a_b!?"))).alias("slug"), text.csv_field(F.col("props")).alias("field"),
    )


@query("SELECT id, day, day_group, CASE day WHEN DATE '2024-01-30' THEN 'Today' WHEN DATE '2024-01-29' THEN 'Yesterday' ELSE strftime(day, '%B %-d, %Y') END AS label FROM (SELECT id, created_at::DATE AS day, dense_rank() OVER (PARTITION BY conversation_id ORDER BY created_at::DATE) AS day_group FROM messages)", "messages")
def day_labels(spark, sf_dir: str) -> DataFrame:
    groups = messaging.day_groups(views.messages(spark, sf_dir))
    return groups.select("id", "day", "day_group", dates.day_label(F.col("day"), F.lit("2024-01-30").cast("date")).alias("label"))


@query("SELECT s_suppkey AS broadcast_id, s_name AS name, count(status) AS total, count(*) FILTER (status IN ('sent', 'delivered', 'read', 'replied')) AS sent_count, count(*) FILTER (status IN ('delivered', 'read', 'replied')) AS delivered_count, count(*) FILTER (status IN ('read', 'replied')) AS read_count, count(*) FILTER (status = 'replied') AS replied_count, count(*) FILTER (status = 'failed') AS failed_count FROM supplier LEFT JOIN (SELECT * FROM recipients WHERE broadcast_id % 7 <> 3) ON broadcast_id = s_suppkey GROUP BY 1, 2", "recipients")
def broadcasts_recounted(spark, sf_dir: str) -> DataFrame:
    b = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("broadcast_id"), F.col("s_name").alias("name"), F.lit(9).alias("sent_count"))
    return status.broadcasts_recounted(b, views.recipients(spark, sf_dir).filter("broadcast_id % 7 != 3"))


@query(
    """SELECT id, replace(replace(replace('Hi {{1}}, {{2}} owes {{10}} or {{3}}', '{{1}}', CASE WHEN id % 4 = 0 THEN '{{1}}' ELSE name END), '{{10}}', CASE WHEN id % 3 = 0 THEN '$5 {{10}} {{2}}' ELSE '{{10}}' END), '{{2}}', CASE WHEN id % 2 = 0 THEN 'x{{3}}' ELSE company END) AS preview FROM contacts""",
    "contacts",
)
def broadcast_previews(spark, sf_dir: str) -> DataFrame:
    i = F.col("id")
    pair = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    variables = F.map_from_arrays(
        F.array(F.lit("1"), F.lit("2"), F.lit("10"), F.lit("3")),
        F.array(pair("field", F.when(i % 4 == 0, "shoe").otherwise("name")), F.when(i % 2 == 0, pair("static", F.lit("x{{3}}"))).otherwise(pair("custom_field", F.lit("segment"))), pair("static", F.when(i % 3 == 0, "$$5 $& {{2}}").otherwise("")), pair("custom_field", F.lit("none"))),
    )
    rows = views.contacts(spark, sf_dir)
    body = F.lit("Hi {{1}}, {{2}} owes {{10}} or {{3}}")
    return rows.select(i, templates.broadcast_preview(body, variables, F.create_map(F.lit("name"), F.col("name")), F.create_map(F.lit("segment"), F.col("company"))).alias("preview"))
