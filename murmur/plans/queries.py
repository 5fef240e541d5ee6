"""Every query over the CRM model by name, with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions import dates, numbers, phone, security, text
from murmur.operators import audience, contacts, deals, messaging, rules, runs, status
from murmur.operators.lineage import dealt
from murmur.sources import views
from murmur.sources.webhook import explode_webhook
from murmur.sources.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: The clock of the events and of the orders.
NOW, ORDERS_NOW = "2024-01-31 00:00:00", "2001-08-02 00:00:00"
RECENT = "created_at >= TIMESTAMP_NTZ '2024-01-18 00:00:00'"


def query(sql: str | None = None, *names: str):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return register


_PAIRS = """turns AS (SELECT *, lag(sender_type) OVER w AS prev,
    min(CASE WHEN sender_type <> 'customer' THEN created_at END) OVER (PARTITION BY conversation_id ORDER BY created_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS replied_at
  FROM messages WHERE created_at >= TIMESTAMP '2024-01-18' WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, id)),
  pairs AS (SELECT conversation_id, created_at AS asked_at, replied_at, date_diff('microsecond', created_at, replied_at) / 60000000.0::DOUBLE AS minutes
  FROM turns WHERE sender_type = 'customer' AND (prev IS NULL OR prev <> 'customer') AND replied_at IS NOT NULL)"""
_PAIRED = lambda tail: f"WITH messages AS ({views.SQL['messages']}), {_PAIRS} {tail}"


@query(_PAIRED("SELECT d.weekday::INTEGER AS weekday, round(avg(minutes), 6) AS avg_minutes, count(minutes) AS samples FROM range(7) d(weekday) LEFT JOIN pairs ON isodow(asked_at) - 1 = d.weekday GROUP BY d.weekday"))
def response_time_by_weekday(spark, sf_dir: str) -> DataFrame:
    return messaging.response_time_by_weekday(views.messages(spark, sf_dir).filter(RECENT))


@query(_PAIRED("SELECT conversation_id, asked_at, replied_at, round(minutes, 6) AS minutes FROM pairs"))
def response_time_pairs(spark, sf_dir: str) -> DataFrame:
    return messaging.response_pairs(views.messages(spark, sf_dir).filter(RECENT)).withColumn("minutes", F.round("minutes", 6))


@query(_PAIRED("SELECT round(avg(minutes) FILTER (asked_at >= TIMESTAMP '2024-01-29'), 6) AS this_week, round(avg(minutes) FILTER (asked_at >= TIMESTAMP '2024-01-22' AND asked_at < TIMESTAMP '2024-01-29'), 6) AS last_week FROM pairs"))
def response_time_week_compare(spark, sf_dir: str) -> DataFrame:
    return messaging.response_time_week_compare(views.messages(spark, sf_dir).filter(RECENT), NOW)


@query(
    """SELECT 'agent_messages' AS metric, count(*) FILTER (created_at >= TIMESTAMP '2024-01-30')::DOUBLE AS current, count(*) FILTER (created_at < TIMESTAMP '2024-01-30')::DOUBLE AS previous FROM messages WHERE sender_type = 'agent' AND created_at >= TIMESTAMP '2024-01-29'
    UNION ALL SELECT 'new_conversations', count(*) FILTER (started >= TIMESTAMP '2024-01-02')::DOUBLE, count(*) FILTER (started >= TIMESTAMP '2024-01-01' AND started < TIMESTAMP '2024-01-02')::DOUBLE FROM (SELECT min(created_at) AS started FROM messages GROUP BY conversation_id)
    UNION ALL SELECT 'open_deals', count(*)::DOUBLE, NULL FROM deals WHERE status = 'open'
    UNION ALL SELECT 'open_value', coalesce(sum(value), 0)::DOUBLE, NULL FROM deals WHERE status = 'open'
    UNION ALL SELECT 'contacts', count(*)::DOUBLE, NULL FROM contacts""",
    "messages", "deals", "contacts",
)
def kpi_bundle(spark, sf_dir: str) -> DataFrame:
    """One row a figure; each is an aggregate of its own table, so nothing is joined."""
    m, d = views.messages(spark, sf_dir), views.deals(spark, sf_dir).filter("status = 'open'")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    at, started = F.col("created_at"), m.groupBy("conversation_id").agg(F.min("created_at").alias("started"))
    row = lambda df, name, now, before=None: df.agg(now.alias("current"), (F.lit(None) if before is None else before).cast("double").alias("previous")).select(F.lit(name).alias("metric"), F.col("current").cast("double").alias("current"), "previous")
    parts = [
        row(m.filter((F.col("sender_type") == "agent") & (at >= day("2024-01-29"))), "agent_messages", F.count_if(at >= day("2024-01-30")), F.count_if(at < day("2024-01-30"))),
        row(started, "new_conversations", F.count_if(F.col("started") >= day("2024-01-02")), F.count_if((F.col("started") >= day("2024-01-01")) & (F.col("started") < day("2024-01-02")))),
        row(d, "open_deals", F.count("*")),
        row(d, "open_value", F.coalesce(F.sum("value"), F.lit(0))),
        row(views.contacts(spark, sf_dir), "contacts", F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _series(days: int) -> None:
    sql = f"""SELECT d.day::DATE AS day, count(*) FILTER (sender_type = 'customer') AS incoming, count(*) FILTER (sender_type <> 'customer') AS outgoing
      FROM range(DATE '2024-01-30' - {days - 1}, DATE '2024-01-31', INTERVAL 1 DAY) d(day) LEFT JOIN messages ON created_at::DATE = d.day GROUP BY d.day"""

    def series(spark, sf_dir: str) -> DataFrame:
        return messaging.daily_series(views.messages(spark, sf_dir), "2024-01-30", days)

    series.__name__ = f"daily_message_series_{days}"
    query(sql, "messages")(series)


for _days in (7, 30, 90):
    _series(_days)


@query("SELECT stage_id, position, count(id) AS n, sum(value)::DOUBLE AS total FROM stages JOIN deals USING (stage_id) WHERE status = 'open' GROUP BY ALL", "stages", "deals")
def pipeline_donut(spark, sf_dir: str) -> DataFrame:
    return deals.stage_totals(views.deals(spark, sf_dir), views.stages(spark, sf_dir))


@query(
    """SELECT stage_id, round(share, 6) AS share, round(coalesce(sum(share) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS begins FROM
    (SELECT *, raw / sum(raw) OVER () AS share FROM (SELECT stage_id, position, greatest(sum(value)::DOUBLE / sum(sum(value)::DOUBLE) OVER (), 0.02::DOUBLE) AS raw FROM stages JOIN deals USING (stage_id) WHERE status = 'open' GROUP BY ALL))""",
    "stages", "deals",
)
def donut_shares(spark, sf_dir: str) -> DataFrame:
    return deals.donut_shares(views.deals(spark, sf_dir), views.stages(spark, sf_dir))


@query("SELECT stage_id, position, count(*) AS n, sum(value)::DOUBLE AS total, min(id) AS first_id, max(id) AS last_id FROM deals JOIN stages USING (stage_id) GROUP BY ALL", "stages", "deals")
def board_columns(spark, sf_dir: str) -> DataFrame:
    return deals.board(views.deals(spark, sf_dir), views.stages(spark, sf_dir))


@query(
    """SELECT count(*) FILTER (status IS DISTINCT FROM 'lost') AS n, coalesce(sum(value) FILTER (status IS DISTINCT FROM 'lost'), 0)::DOUBLE AS total, round(coalesce(avg(value::DOUBLE) FILTER (status IS DISTINCT FROM 'lost'), 0), 4) AS average,
    count(*) FILTER (status = 'won' AND updated_at >= TIMESTAMP '2001-08-01') AS won_this_month, count(*) FILTER (status = 'lost' AND updated_at >= TIMESTAMP '2001-08-01') AS lost_this_month FROM deals""",
    "deals",
)
def pipeline_kpis(spark, sf_dir: str) -> DataFrame:
    return deals.pipeline_kpis(views.deals(spark, sf_dir), ORDERS_NOW)


@query(
    """SELECT stage_id, round(probability, 6) AS probability, open_value, round(probability * open_value, 2) AS weighted FROM
    (SELECT stage_id, CASE WHEN row_number() OVER (ORDER BY position) = count(*) OVER () THEN 1.0::DOUBLE ELSE 0.1::DOUBLE + 0.8::DOUBLE * (row_number() OVER (ORDER BY position) - 1) / greatest(1, count(*) OVER () - 2) END AS probability FROM stages)
    JOIN (SELECT stage_id, sum(value)::DOUBLE AS open_value FROM deals WHERE status = 'open' GROUP BY 1) USING (stage_id)""",
    "stages", "deals",
)
def weighted_pipeline(spark, sf_dir: str) -> DataFrame:
    return deals.weighted_pipeline(views.deals(spark, sf_dir), views.stages(spark, sf_dir))


_COUNTS = """count(*) AS total, count(*) FILTER (status IN ('sent','delivered','read','replied')) AS sent_count, count(*) FILTER (status IN ('delivered','read','replied')) AS delivered_count,
  count(*) FILTER (status IN ('read','replied')) AS read_count, count(*) FILTER (status = 'replied') AS replied_count, count(*) FILTER (status = 'failed') AS failed_count"""


@query(f"SELECT *, CASE WHEN sent_count > 0 THEN floor(100.0::DOUBLE * read_count / sent_count + 0.5) ELSE 0 END::BIGINT AS read_percent FROM (SELECT broadcast_id, {_COUNTS} FROM recipients GROUP BY 1)", "recipients")
def broadcast_funnel(spark, sf_dir: str) -> DataFrame:
    return status.broadcast_counts(views.recipients(spark, sf_dir)).withColumn("read_percent", numbers.percent(F.col("read_count"), F.col("sent_count")))


@query(
    """SELECT broadcast_id, counter, sum(n)::BIGINT AS n FROM (SELECT broadcast_id, unnest(['sent','delivered','read','replied','failed']) AS counter, unnest([(status IN ('sent','delivered','read','replied'))::INTEGER, (status IN ('delivered','read','replied'))::INTEGER, (status IN ('read','replied'))::INTEGER, (status = 'replied')::INTEGER, (status = 'failed')::INTEGER]) AS n FROM recipients)
    GROUP BY ALL HAVING sum(n) > 0""",
    "recipients",
)
def broadcast_counters_incremental(spark, sf_dir: str) -> DataFrame:
    """Every recipient moves from pending over sent to its status; the deltas add up to the final counts."""
    r = views.recipients(spark, sf_dir)
    inserted = r.select("broadcast_id", F.lit("pending").alias("old"), F.lit("sent").alias("new"))
    moved = r.select("broadcast_id", F.lit("sent").alias("old"), F.col("status").alias("new"))
    return status.counter_deltas(inserted.unionByName(moved)).filter("n > 0")


@query(
    """SELECT key, CASE WHEN max(fatal::INTEGER) = 1 THEN 'failed' ELSE ['pending','sent','delivered','read','replied'][coalesce(max(level) FILTER (NOT ended), 0) + 1] END AS status,
      min("at") FILTER (NOT ended AND level > reached AND status = 'sent') AS sent_at, min("at") FILTER (NOT ended AND level > reached AND status = 'delivered') AS delivered_at, min("at") FILTER (NOT ended AND level > reached AND status = 'read') AS read_at,
      count(*) FILTER (NOT ended AND (level > reached OR fatal)) AS n_accepted
    FROM (SELECT *, coalesce(max(fatal::INTEGER) OVER b, 0) = 1 AS ended FROM (SELECT *, status = 'failed' AND reached <= 1 AS fatal FROM
      (SELECT *, coalesce(max(level) OVER b, 0) AS reached FROM (SELECT *, CASE status WHEN 'sent' THEN 1 WHEN 'delivered' THEN 2 WHEN 'read' THEN 3 WHEN 'replied' THEN 4 END AS level FROM status_events)
       WINDOW b AS (PARTITION BY key ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
      WINDOW b AS (PARTITION BY key ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY key""",
    "status_events",
)
def recipient_status_ladder(spark, sf_dir: str) -> DataFrame:
    return status.ladder(views.status_events(spark, sf_dir))


@query("SELECT contact_id, broadcast_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY created_at DESC, broadcast_id DESC, order_id DESC, part_id DESC) AS turn FROM recipients WHERE status IN ('sent','delivered','read')) WHERE turn = 1", "recipients")
def reply_attribution(spark, sf_dir: str) -> DataFrame:
    return status.reply_attribution(views.recipients(spark, sf_dir))


_C = "SELECT id, user_id, name, company, phone FROM contacts c WHERE "


@query(_C + "NOT EXISTS (SELECT 1 FROM contact_tags t WHERE t.contact_id = c.id AND tag IN ('1-URGENT', '2-HIGH'))", "contacts", "contact_tags")
def audience_all_minus_tags(spark, sf_dir: str) -> DataFrame:
    return audience.without_tags(views.contacts(spark, sf_dir), views.contact_tags(spark, sf_dir), ["1-URGENT", "2-HIGH"])


@query(_C + "EXISTS (SELECT 1 FROM contact_tags t WHERE t.contact_id = c.id AND tag IN ('1-URGENT', '5-LOW'))", "contacts", "contact_tags")
def audience_tags(spark, sf_dir: str) -> DataFrame:
    return audience.with_any_tag(views.contacts(spark, sf_dir), views.contact_tags(spark, sf_dir), ["1-URGENT", "5-LOW"])


def _custom(operator: str, field: str, value: str, test: str) -> None:
    def custom(spark, sf_dir: str) -> DataFrame:
        return audience.by_field(views.contacts(spark, sf_dir), views.custom_values(spark, sf_dir), field, operator, value)

    custom.__name__ = f"audience_custom_{operator}"
    query(_C + f"EXISTS (SELECT 1 FROM custom_values v WHERE v.contact_id = c.id AND field = '{field}' AND value {test})", "contacts", "custom_values")(custom)


_custom("is", "segment", "BUILDING", "= 'BUILDING'")
_custom("is_not", "segment", "BUILDING", "<> 'BUILDING'")
_custom("contains", "nation", "nation_1", "ILIKE '%nation_1%'")


@query(
    """SELECT greatest(0, (SELECT count(*) FROM contacts) - (SELECT count(DISTINCT contact_id) FROM contact_tags WHERE tag = '1-URGENT')) AS all_estimate,
    (SELECT count(*) FROM (SELECT contact_id FROM contact_tags WHERE tag = '5-LOW' EXCEPT SELECT contact_id FROM contact_tags WHERE tag = '1-URGENT')) AS tags_estimate,
    (SELECT count(DISTINCT contact_id) FROM contact_tags WHERE tag = '5-LOW') AS tags_reach""",
    "contacts", "contact_tags",
)
def audience_estimate(spark, sf_dir: str) -> DataFrame:
    return audience.estimates(views.contacts(spark, sf_dir), views.contact_tags(spark, sf_dir), ["5-LOW"], ["1-URGENT"])


@query(
    """SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS phone, concat_ws('|', coalesce(name, ''), 'Hello', coalesce(n.value, '')) AS params, regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^\\+?[1-9][0-9]{6,14}$') AS valid,
    ((row_number() OVER (ORDER BY id) - 1) // 10)::BIGINT AS batch FROM contacts LEFT JOIN (SELECT contact_id, value FROM custom_values WHERE field = 'nation') n ON n.contact_id = id""",
    "contacts", "custom_values",
)
def broadcast_payload(spark, sf_dir: str) -> DataFrame:
    variables = {"10": ("custom_field", "nation"), "1": ("field", "name"), "2": ("static", "Hello")}
    return audience.payloads(views.contacts(spark, sf_dir), views.custom_values(spark, sf_dir), variables)


@query("SELECT id, user_id, name, company, phone FROM contacts WHERE name ILIKE '%00001%' OR phone ILIKE '%00001%' OR company ILIKE '%00001%' ORDER BY name, id LIMIT 25 OFFSET 5", "contacts")
def contact_search_page(spark, sf_dir: str) -> DataFrame:
    found = contacts.search_page(views.contacts(spark, sf_dir), " 00001 ", 0, 30)
    return found.orderBy("name", "id").offset(5)


@query("SELECT c.id, c.user_id, c.name, c.company, c.phone, coalesce(array_to_string(t.tags, ','), '') AS tags FROM contacts c LEFT JOIN (SELECT contact_id, list_sort(list(tag)) AS tags FROM contact_tags GROUP BY 1) t ON t.contact_id = c.id", "contacts", "contact_tags")
def contacts_with_tags(spark, sf_dir: str) -> DataFrame:
    return contacts.with_tags(views.contacts(spark, sf_dir), views.contact_tags(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


_INBOX = """talks AS (SELECT conversation_id, min(created_at) AS created_at, max(created_at) AS last_message_at, arg_max(content_text, (created_at, id)) AS last_message_text,
  count(*) FILTER (sender_type = 'customer' AND (answered IS NULL OR created_at > answered)) AS unread_count, CASE conversation_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'pending' ELSE 'closed' END AS status
  FROM (SELECT *, max(CASE WHEN sender_type <> 'customer' THEN created_at END) OVER (PARTITION BY conversation_id) AS answered FROM messages) GROUP BY conversation_id)"""
_TALKS = lambda tail: f"WITH messages AS ({views.SQL['messages']}), contacts AS ({views.SQL['contacts']}), {_INBOX} {tail}"
_ROW = "t.conversation_id, t.created_at, last_message_at, last_message_text, unread_count, status, name, phone"


@query(_TALKS(f"SELECT {_ROW} FROM talks t LEFT JOIN contacts c ON c.id = t.conversation_id"))
def inbox_list(spark, sf_dir: str) -> DataFrame:
    return messaging.inbox(messaging.conversations(views.messages(spark, sf_dir)), views.contacts(spark, sf_dir))


@query(_TALKS(f"SELECT {_ROW} FROM talks t LEFT JOIN contacts c ON c.id = t.conversation_id WHERE status = 'open' AND (contains(lower(coalesce(name, '')), '370') OR contains(lower(coalesce(phone, '')), '370') OR contains(lower(coalesce(last_message_text, '')), '370'))"))
def inbox_search(spark, sf_dir: str) -> DataFrame:
    return messaging.inbox(messaging.conversations(views.messages(spark, sf_dir)), views.contacts(spark, sf_dir), "370", "open")


@query(_TALKS("SELECT count(*) FILTER (unread_count > 0) AS unread_conversations, sum(unread_count)::BIGINT AS unread_messages FROM talks"))
def unread_gauge(spark, sf_dir: str) -> DataFrame:
    return messaging.unread_gauge(messaging.conversations(views.messages(spark, sf_dir)))


@query(
    """SELECT kind, ref, what, "at" FROM (
      (SELECT 'message' AS kind, id AS ref, 'New message from ' || coalesce(nullif(c.name, ''), nullif(c.phone, ''), 'Unknown') AS what, m.created_at AS "at" FROM (SELECT * FROM messages WHERE sender_type = 'customer' ORDER BY created_at DESC, id DESC LIMIT 10) m LEFT JOIN (SELECT id AS cid, name, phone FROM contacts) c ON cid = conversation_id)
      UNION ALL (SELECT 'deal', id, 'Deal in ' || stage_id, updated_at FROM deals ORDER BY updated_at DESC, id DESC LIMIT 10)
      UNION ALL (SELECT 'broadcast', broadcast_id, 'Broadcast sent', max(created_at) FROM recipients GROUP BY broadcast_id ORDER BY max(created_at) DESC, broadcast_id DESC LIMIT 5))
    ORDER BY "at" DESC, kind, ref LIMIT 20""",
    "messages", "contacts", "deals", "recipients",
)
def activity_feed(spark, sf_dir: str) -> DataFrame:
    """The last of each source, then the last of all: each branch is cut before the union."""
    c = views.contacts(spark, sf_dir).select(F.col("id").alias("conversation_id"), "name", "phone")
    inbound = views.messages(spark, sf_dir).filter("sender_type = 'customer'").orderBy(F.desc("created_at"), F.desc("id")).limit(10)
    who = F.coalesce(text.first_filled(F.col("name"), F.col("phone")), F.lit("Unknown"))
    m = inbound.join(c, "conversation_id", "left").select(F.lit("message").alias("kind"), F.col("id").alias("ref"), F.concat(F.lit("New message from "), who).alias("what"), F.col("created_at").alias("at"))
    d = views.deals(spark, sf_dir).orderBy(F.desc("updated_at"), F.desc("id")).limit(10).select(F.lit("deal").alias("kind"), F.col("id").alias("ref"), F.concat(F.lit("Deal in "), F.col("stage_id")).alias("what"), F.col("updated_at").alias("at"))
    b = views.recipients(spark, sf_dir).groupBy("broadcast_id").agg(F.max("created_at").alias("at")).orderBy(F.desc("at"), F.desc("broadcast_id")).limit(5)
    b = b.select(F.lit("broadcast").alias("kind"), F.col("broadcast_id").alias("ref"), F.lit("Broadcast sent").alias("what"), "at")
    return m.unionByName(d).unionByName(b).orderBy(F.desc("at"), "kind", "ref").limit(20)


@query(
    """SELECT conversation_id, last_inbound, last_inbound IS NULL OR hours >= 24 AS expired, CASE WHEN hours < 24 THEN 24 - hours END AS hours_left FROM
    (SELECT *, floor(date_sub('second', last_inbound, TIMESTAMP '2024-01-31') / 3600)::BIGINT AS hours FROM (SELECT conversation_id, max(created_at) FILTER (sender_type = 'customer') AS last_inbound FROM messages GROUP BY 1))""",
    "messages",
)
def session_24h_state(spark, sf_dir: str) -> DataFrame:
    return messaging.session_state(views.messages(spark, sf_dir), NOW)


@query(
    """SELECT id, conversation_id, day, opens_day, sum(opens_day::INTEGER) OVER (PARTITION BY conversation_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS day_group FROM
    (SELECT *, created_at::DATE AS day, created_at::DATE IS DISTINCT FROM lag(created_at::DATE) OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS opens_day FROM messages)""",
    "messages",
)
def thread_day_groups(spark, sf_dir: str) -> DataFrame:
    return messaging.day_groups(views.messages(spark, sf_dir))


_WHO = "CASE WHEN {0} IN ('agent','bot') THEN 'You' WHEN {0} IS NOT NULL THEN 'Customer' END"


@query(f"SELECT t.conversation_id, t.turn, {_WHO.format('t.sender_type')} AS author, {_WHO.format('p.sender_type')} AS parent_author, length(p.content_text) AS parent_chars FROM thread t LEFT JOIN thread p ON p.conversation_id = t.conversation_id AND p.turn + 1 = t.turn", "thread")
def thread_replies(spark, sf_dir: str) -> DataFrame:
    return messaging.reply_pairs(views.thread(spark, sf_dir))


_REACTED = '''reactions AS (SELECT message_id, actor_id, arg_max(emoji, ("at", seq)) AS emoji, max("at") AS "at" FROM (SELECT event_id // 5 AS message_id, user_id % 4 AS actor_id, CASE event_type WHEN 'click' THEN '+1' WHEN 'view' THEN 'heart' WHEN 'error' THEN '' ELSE 'smile' END AS emoji, ts AS "at", event_id AS seq FROM events) GROUP BY ALL HAVING arg_max(emoji, ("at", seq)) <> '')'''


def _reactions(spark, sf_dir: str) -> DataFrame:
    emoji = F.when(F.col("event_type") == "click", "+1").when(F.col("event_type") == "view", "heart").when(F.col("event_type") == "error", "").otherwise("smile")
    e = views.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("message_id"), (F.col("user_id") % 4).alias("actor_id"), emoji.alias("emoji"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return messaging.latest_reactions(e)


@query(f"WITH {_REACTED} SELECT * FROM reactions")
def reaction_state(spark, sf_dir: str) -> DataFrame:
    return _reactions(spark, sf_dir)


@query(f'WITH {_REACTED} SELECT message_id, emoji, count(*) AS n, bool_or(actor_id = 1) AS mine, min("at") AS first_at FROM reactions GROUP BY ALL')
def reaction_groups(spark, sf_dir: str) -> DataFrame:
    return messaging.reaction_groups(_reactions(spark, sf_dir), 1)


@query("SELECT conversation_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS turn FROM messages WHERE sender_type = 'customer') WHERE turn = 1", "messages")
def first_inbound_flag(spark, sf_dir: str) -> DataFrame:
    return messaging.first_inbound(views.messages(spark, sf_dir))


@query("SELECT conversation_id, turn, contains(lower(content_text), 'tion') OR contains(lower(content_text), 'der') AS matched, trim(lower(content_text)) = 'stop' AS stopped FROM thread WHERE sender_type = 'customer'", "thread")
def keyword_match(spark, sf_dir: str) -> DataFrame:
    t = views.thread(spark, sf_dir).filter("sender_type = 'customer'")
    return t.select("conversation_id", "turn", rules.keyword_matches(F.col("content_text"), ["tion", "Der"]).alias("matched"), rules.keyword_matches(F.col("content_text"), ["stop"], exact=True).alias("stopped"))


@query(
    """SELECT id, EXISTS (SELECT 1 FROM contact_tags t WHERE t.contact_id = m.conversation_id AND tag = '1-URGENT') AS tagged, contains(lower(content_text), '"k": 1') AS contains_text, hour(created_at) * 60 + minute(created_at) >= 1320 OR hour(created_at) * 60 + minute(created_at) < 390 AS at_night,
    coalesce((SELECT company FROM contacts c WHERE c.id = m.conversation_id) = 'BUILDING', false) AS field_is FROM messages m""",
    "messages", "contact_tags", "contacts",
)
def conditions_eval(spark, sf_dir: str) -> DataFrame:
    m = views.messages(spark, sf_dir)
    tagged = views.contact_tags(spark, sf_dir).filter("tag = '1-URGENT'").select(F.col("contact_id").alias("conversation_id"), F.lit(True).alias("t"))
    company = views.contacts(spark, sf_dir).select(F.col("id").alias("conversation_id"), "company")
    joined = m.join(tagged, "conversation_id", "left").join(company, "conversation_id", "left")
    return joined.select("id", F.coalesce("t", F.lit(False)).alias("tagged"), text.contains_text(F.col("content_text"), F.lit('"k": 1')).alias("contains_text"), dates.within_day(F.col("created_at"), "22:00-06:30").alias("at_night"), F.coalesce(F.col("company") == "BUILDING", F.lit(False)).alias("field_is"))


@query(
    """SELECT id, conversation_id, (row_number() OVER (PARTITION BY id ORDER BY place) - 1)::INTEGER AS place, trigger FROM
    (SELECT id, conversation_id, unnest([0, 1, 2]) AS place, unnest([CASE WHEN turn = 1 THEN 'first_inbound_message' END, 'new_message_received', CASE WHEN contains(lower(content_text), '"k": 7') THEN 'keyword_match' END]) AS trigger
     FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS turn FROM messages WHERE sender_type = 'customer')) WHERE trigger IS NOT NULL""",
    "messages",
)
def trigger_fanout(spark, sf_dir: str) -> DataFrame:
    return messaging.trigger_fanout(views.messages(spark, sf_dir), rules.keyword_matches(F.col("content_text"), ['"k": 7']))


@query("SELECT event_type AS automation_id, count(*) AS executions, max(ts) AS last_executed_at FROM events GROUP BY 1")
def rule_execution_counts(spark, sf_dir: str) -> DataFrame:
    return rules.execution_counts(views.table(spark, sf_dir, "events").select(F.col("event_type").alias("automation_id"), F.col("ts").alias("at")))


_UNIT = "CASE event_id % 3 WHEN 0 THEN 'minutes' WHEN 1 THEN 'hours' ELSE 'days' END"


@query("SELECT event_id, run_at FROM (SELECT event_id, ts + to_milliseconds(greatest(1000, user_id % 10 * CASE event_id % 3 WHEN 0 THEN 60000 WHEN 1 THEN 3600000 ELSE 86400000 END)) AS run_at FROM events) WHERE run_at <= TIMESTAMP '2024-01-15' ORDER BY run_at, event_id LIMIT 50")
def due_timers(spark, sf_dir: str) -> DataFrame:
    waits = dates.wait_ms(F.col("user_id") % 10, F.expr(_UNIT))
    e = views.table(spark, sf_dir, "events").withColumn("w", waits).select("event_id", F.expr("ts + make_dt_interval(0, 0, 0, cast(w / 1000 as decimal(18,6)))").alias("run_at"))
    return e.filter(F.col("run_at") <= F.lit("2024-01-15").cast("timestamp_ntz")).orderBy("run_at", "event_id").limit(50)


@query("SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS digits, regexp_matches(phone, '^\\+?[1-9][0-9]{6,14}$') AS valid, regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^[1-9][0-9]{6,14}$') AS valid_digits FROM contacts", "contacts")
def phone_normalize(spark, sf_dir: str) -> DataFrame:
    p = F.col("phone")
    return views.contacts(spark, sf_dir).select("id", phone.digits(p).alias("digits"), phone.is_e164(p).alias("valid"), phone.is_e164(phone.digits(p)).alias("valid_digits"))


_RULE = "CASE WHEN length(d) > {0} AND d[{1}] <> '0' THEN d[:{0}] || '0' || d[{1}:] END"
_DROP = "CASE WHEN length(d) > {1} AND d[{1}] = '0' THEN d[:{0}] || d[{2}:] END"


@query("SELECT id, array_to_string(list_sort(list_distinct(list_filter([d, " + ", ".join([_RULE.format(c, c + 1) for c in (1, 2, 3)] + [_DROP.format(c, c + 1, c + 2) for c in (1, 2, 3)]) + "], lambda x: x IS NOT NULL))), ',') AS variants FROM (SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM contacts)", "contacts")
def phone_variants(spark, sf_dir: str) -> DataFrame:
    return views.contacts(spark, sf_dir).select("id", F.array_join(F.array_sort(phone.variants(phone.digits(F.col("phone")))), ",").alias("variants"))


@query(
    """SELECT a.id AS inbound_id, min(c.id) AS contact_id, count(c.id) AS candidates FROM (SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM contacts) a
    LEFT JOIN (SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM contacts) c ON a.d = c.d OR (length(a.d) >= 8 AND length(c.d) >= 8 AND right(a.d, 8) = right(c.d, 8)) GROUP BY a.id""",
    "contacts",
)
def phone_match_join(spark, sf_dir: str) -> DataFrame:
    c = views.contacts(spark, sf_dir)
    found = contacts.match_phones(c.select(F.col("id").alias("inbound_id"), "phone"), c)
    return found.select("inbound_id", "contact_id", F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query(
    """SELECT phone, min(ord) AS ord, arg_max(name, ord) AS name FROM (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN '+370 ' || (60000000 + o_custkey % 1000) ELSE '+1 ' || (o_custkey % 5000) END AS phone, 'row ' || o_orderkey AS name FROM orders)
    WHERE phone NOT IN (SELECT phone FROM contacts) GROUP BY phone""",
    "contacts",
)
def csv_upsert_contacts(spark, sf_dir: str) -> DataFrame:
    key, n = F.col("o_orderkey"), F.col("o_custkey")
    number = F.when(key % 2 == 0, F.concat(F.lit("+370 "), (60000000 + n % 1000).cast("string"))).otherwise(F.concat(F.lit("+1 "), (n % 5000).cast("string")))
    rows = views.table(spark, sf_dir, "orders").select(key.alias("ord"), number.alias("phone"), F.concat(F.lit("row "), key.cast("string")).alias("name"))
    return contacts.csv_upsert(views.contacts(spark, sf_dir), rows)


@query("SELECT id, 'Hi ' || name || ', your segment ' || company || ' {{4}} ' || name AS rendered, '1,2,4' AS numbers FROM contacts", "contacts")
def template_render(spark, sf_dir: str) -> DataFrame:
    body = F.lit("Hi {{1}}, your segment {{2}} {{4}} {{1}}")
    return views.contacts(spark, sf_dir).select("id", text.render(body, F.array("name", "company")).alias("rendered"), F.array_join(text.placeholders(body).cast("array<string>"), ",").alias("numbers"))


@query(
    """SELECT s.p_partkey AS id, CASE WHEN o.p_partkey IS NULL THEN 'insert' WHEN o.p_size = s.p_size THEN 'keep' ELSE 'update' END AS action FROM part s
    LEFT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END AS p_size FROM part WHERE p_partkey % 5 <> 0) o ON o.p_partkey = s.p_partkey"""
)
def template_sync_actions(spark, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    old = p.filter("id % 5 <> 0").withColumn("size", F.when(F.col("id") % 2 == 0, F.col("size")).otherwise(F.col("size") + 1))
    return contacts.sync_actions(old, p, ["id"], ["size"]).select("id", "action")


@query(
    """WITH RECURSIVE calls AS (SELECT user_id AS key, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
    fold AS (SELECT key, seq, turn, ts AS opened, 1 AS used FROM calls WHERE turn = 1
      UNION ALL SELECT c.key, c.seq, c.turn, CASE WHEN c.ts >= opened + INTERVAL 6 HOUR THEN c.ts ELSE opened END, CASE WHEN c.ts >= opened + INTERVAL 6 HOUR THEN 1 ELSE used + 1 END FROM fold f JOIN calls c ON c.key = f.key AND c.turn = f.turn + 1)
    SELECT key, seq, used <= 3 AS allowed FROM fold"""
)
def rate_limiter(spark, sf_dir: str) -> DataFrame:
    calls = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return messaging.rate_limited(calls, 3, 6 * 3600 * 1000)


@query("SELECT o_custkey AS contact_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS order_id, max(o_orderdate) AS \"at\" FROM orders GROUP BY 1")
def upsert_latest_per_key(spark, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contact_id"), F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("at"))
    return contacts.latest_per_key(o, ["contact_id"], [F.desc("at"), F.desc("order_id")])


@query("SELECT o_orderkey AS id, o_custkey AS contact_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def cascade_delete(spark, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contact_id"))
    return contacts.cascade_delete(o, views.table(spark, sf_dir, "customer").filter("c_acctbal >= 0"), "contact_id", "c_custkey").select("id", "contact_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN o_custkey END AS contact_id FROM orders")
def set_null_delete(spark, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contact_id"))
    return contacts.set_null_delete(o, views.table(spark, sf_dir, "customer").filter("c_acctbal >= 0"), "contact_id", "c_custkey")


@query("SELECT contact_id, tag FROM contact_tags WHERE contact_id IN (SELECT id FROM contacts WHERE user_id = 7)", "contacts", "contact_tags")
def tenant_semi_join(spark, sf_dir: str) -> DataFrame:
    return contacts.for_tenant(views.contact_tags(spark, sf_dir), views.contacts(spark, sf_dir), "contact_id", "id", 7).select("contact_id", "tag")


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS ago,
    CASE WHEN d > 0 THEN '+' || d || ' vs yesterday' WHEN d = 0 THEN 'No change' ELSE d || ' vs yesterday' END AS delta, CASE WHEN value <= 0 THEN 4.0::DOUBLE ELSE p * CASE WHEN value / p <= 1 THEN 1 WHEN value / p <= 2 THEN 2 WHEN value / p <= 5 THEN 5 ELSE 10 END END AS ceiling
    FROM (SELECT event_id, value, user_id - 8 AS d, greatest(1, date_diff('microsecond', ts, TIMESTAMP '2024-01-31') // 1000000 + CASE WHEN date_diff('microsecond', ts, TIMESTAMP '2024-01-31') % 1000000 >= 500000 THEN 1 ELSE 0 END) AS s, CASE WHEN value > 0 THEN pow(10.0::DOUBLE, floor(log10(value))) END AS p FROM events)"""
)
def format_labels(spark, sf_dir: str) -> DataFrame:
    seconds = F.timestamp_diff("MICROSECOND", F.col("ts"), F.lit(NOW).cast("timestamp_ntz")) / 1000000.0
    return views.table(spark, sf_dir, "events").select("event_id", dates.ago(seconds).alias("ago"), numbers.delta_label(F.col("user_id") - 8, "vs yesterday").alias("delta"), numbers.nice_ceil(F.col("value")).alias("ceiling"))


@query("SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS sender, 'text' AS kind, props AS content, to_timestamp(epoch(date_trunc('second', ts)))::TIMESTAMP AS sent_at, 'user ' || user_id AS contact_name FROM events")
def webhook_explode(spark, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    message = F.struct(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("from"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), F.lit("text").alias("type"), F.struct(F.col("props").alias("body")).alias("text"))
    person = F.struct(F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name")).alias("profile"))
    value = F.struct(F.array(person).alias("contacts"), F.array(message).alias("messages"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(value.alias("value"))).alias("changes"))).alias("entry")))
    found = explode_webhook(e.select(body.alias("body")))["messages"]
    return found.select("id", "sender", "kind", "content", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"), "contact_name")


_PAD = lambda byte: "".join(f"{c ^ byte:02x}" for c in b"test-secret".ljust(64, b"\0"))


_SIGNED = f"sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(props))))"


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN sha256(props) ELSE {_SIGNED} END = {_SIGNED} AS holds FROM events")
def hmac_check(spark, sf_dir: str) -> DataFrame:
    """Two thirds of the bodies are signed rightly, the others with a plain digest."""
    right = F.concat(F.lit("sha256="), security.hmac_sha256(F.col("props"), "test-secret"))
    header = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("sha256="), F.sha2("props", 256))).otherwise(right)
    return views.table(spark, sf_dir, "events").select("event_id", security.signature_holds(F.col("props"), header, "test-secret").alias("holds"))


@query(f"SELECT event_id, {_SIGNED} AS signature FROM events")
def hmac_signature(spark, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", security.hmac_sha256(F.col("props"), "test-secret").alias("signature"))


@query("SELECT event_id, props AS plain, true AS three_parts FROM events")
def aes_roundtrip(spark, sf_dir: str) -> DataFrame:
    key = "00" * 32
    e = views.table(spark, sf_dir, "events").withColumn("token", security.encrypt_token(F.col("props"), key))
    return e.select("event_id", security.decrypt_token(F.col("token"), key).alias("plain"), (F.size(F.split("token", ":")) == 3).alias("three_parts"))


#: Rules and their step trees over the test tables: a rule a customer, whose orders are the steps; those of the first order's branches hang on it.
KINDS = ("send_message", "add_tag", "remove_tag", "wait", "update_contact_field", "create_deal", "send_webhook", "close_conversation", "condition")


def _automations(spark, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    trigger = F.when(key % 2 == 0, "new_message_received").otherwise("keyword_match")
    return views.table(spark, sf_dir, "customer").select(key.alias("id"), key.alias("user_id"), trigger.alias("trigger"), F.lit('"K": 7').alias("keyword"), (key % 5 != 0).alias("is_active"))


def _steps(spark, sf_dir: str) -> DataFrame:
    key, first = F.col("o_orderkey"), F.col("first")
    o = views.table(spark, sf_dir, "orders")
    o = dealt(o, o.count(), "o_custkey").withColumn("first", F.min("o_orderkey").over(Window.partitionBy("o_custkey")))
    below = (key % 3 == 0) & (first % 2 == 0) & (key != first)
    root = (key == first) & (first % 2 == 0)
    o = o.select(
        key.alias("id"), F.col("o_custkey").alias("automation_id"), F.when(below, first).otherwise(-1).cast("long").alias("parent_id"), F.when(below, F.when(key % 2 == 0, "yes").otherwise("no")).otherwise("").alias("branch"),
        F.when(root, "condition").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (key % 9 + 1).cast("int"))).alias("kind"),
        F.when(root, F.concat(F.lit('"k": '), (key % 10).cast("string"))).when(key % 4 == 0, "  ").otherwise(F.concat(F.lit("Got {{ message.text }} #"), key.cast("string"))).alias("text_of_step"),
        F.col("o_orderpriority").alias("tag"), (key % 5).alias("amount"), F.when(key % 2 == 0, "hours").otherwise("days").alias("unit"), F.element_at(F.array(F.lit("name"), F.lit("email"), F.lit("phone")), (key % 3 + 1).cast("int")).alias("field"), F.when(key % 7 != 0, F.col("o_orderpriority")).alias("stage"),
    )
    return o.withColumn("position", F.row_number().over(Window.partitionBy("automation_id", "parent_id", "branch").orderBy("id")) - 1)


def _runs(spark, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("at"), F.col("props").alias("text"))
    return runs.dispatch(e, _automations(spark, sf_dir))


def _executed(spark, sf_dir: str, *keep: str) -> DataFrame:
    return runs.execute(_runs(spark, sf_dir), _steps(spark, sf_dir), keep=keep)


def _level(name: str, source: str) -> str:
    return f"""{name}_all AS (SELECT r.*, s.* EXCLUDE (automation_id, parent_id, branch),
      CASE WHEN kind IN ('send_message', 'create_deal') THEN replace(text_of_step, '{{{{ message.text }}}}', text) WHEN kind = 'send_webhook' THEN '{{"event_id":' || event_id || ',"automation_id":' || s.automation_id || ',"message":' || to_json(text) || '}}' END AS body,
      CASE WHEN kind = 'condition' THEN CASE WHEN contains(lower(text), lower(text_of_step)) THEN 'yes' ELSE 'no' END END AS chosen,
      CASE WHEN kind = 'wait' THEN "at" + to_milliseconds(greatest(1000, amount * CASE unit WHEN 'hours' THEN 3600000 ELSE 86400000 END)) END AS run_at
      FROM ({source}) r JOIN steps s ON r.automation_id = s.automation_id AND r.parent_id = s.parent_id AND r.branch = s.branch),
    {name}_judged AS (SELECT *, CASE WHEN kind = 'send_message' AND trim(body) = '' OR kind = 'create_deal' AND stage IS NULL THEN 'failed' WHEN kind = 'wait' THEN 'partial' WHEN kind = 'update_contact_field' AND field NOT IN ('name', 'email', 'company') THEN 'skipped' ELSE 'success' END AS status FROM {name}_all),
    {name} AS (SELECT * EXCLUDE (stop) FROM (SELECT *, min(CASE WHEN status IN ('failed', 'partial') THEN position END) OVER (PARTITION BY event_id, automation_id, parent_id, branch) AS stop FROM {name}_judged) WHERE stop IS NULL OR position <= stop)"""


_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_RUNS_SQL = """runs AS (SELECT event_id, user_id AS automation_id, user_id, ts AS "at", props AS text, CASE WHEN user_id % 2 = 0 THEN 'new_message_received' ELSE 'keyword_match' END AS trigger
  FROM events JOIN customer ON user_id = c_custkey WHERE user_id % 5 <> 0 AND (user_id % 2 = 0 OR contains(lower(props), '"k": 7')))"""
_EXECUTED_SQL = f"""WITH {_RUNS_SQL},
  placed AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders),
  hung AS (SELECT *, o_orderkey % 3 = 0 AND first % 2 = 0 AND o_orderkey <> first AS below, o_orderkey = first AND first % 2 = 0 AS root FROM placed),
  steps0 AS (SELECT o_orderkey AS id, o_custkey AS automation_id, CASE WHEN below THEN first ELSE -1 END AS parent_id, CASE WHEN below THEN CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END ELSE '' END AS branch,
    CASE WHEN root THEN 'condition' ELSE {_KIND_LIST}[o_orderkey % 9 + 1] END AS kind, CASE WHEN root THEN '"k": ' || o_orderkey % 10 WHEN o_orderkey % 4 = 0 THEN '  ' ELSE 'Got {{{{ message.text }}}} #' || o_orderkey END AS text_of_step,
    o_orderpriority AS tag, o_orderkey % 5 AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'hours' ELSE 'days' END AS unit, ['name', 'email', 'phone'][o_orderkey % 3 + 1] AS field, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS stage FROM hung),
  steps AS (SELECT *, row_number() OVER (PARTITION BY automation_id, parent_id, branch ORDER BY id) - 1 AS position FROM steps0),
  {_level("top", "SELECT *, -1 AS parent_id, '' AS branch FROM runs")},
  {_level("under", "SELECT event_id, automation_id, user_id, \"at\", text, trigger, id AS parent_id, chosen AS branch FROM top WHERE kind = 'condition'")},
  executed AS (SELECT * FROM top UNION ALL BY NAME SELECT * FROM under)"""


@query(f'WITH {_RUNS_SQL} SELECT event_id, automation_id, trigger, "at" FROM runs')
def rule_dispatch(spark, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("event_id", "automation_id", "trigger", "at")


@query(f"{_EXECUTED_SQL} SELECT event_id, id AS step_id, kind, position::INTEGER AS position, branch, status, chosen FROM executed")
def step_log(spark, sf_dir: str) -> DataFrame:
    return _executed(spark, sf_dir, "position", "branch", "status").select("event_id", F.col("id").alias("step_id"), "kind", "position", "branch", "status", "chosen")


@query(f"{_EXECUTED_SQL} SELECT event_id, id AS step_id, kind, body FROM executed WHERE kind IN ('send_message', 'send_webhook') AND status = 'success'")
def step_outbox(spark, sf_dir: str) -> DataFrame:
    return runs.outbox(_executed(spark, sf_dir, "status", "body"))


@query(f"{_EXECUTED_SQL} SELECT event_id, automation_id, parent_id, branch, (position + 1)::INTEGER AS next_position, run_at FROM executed WHERE status = 'partial'")
def parked_steps(spark, sf_dir: str) -> DataFrame:
    return runs.parked(_executed(spark, sf_dir, *runs.OF_PARKED)).drop("way", "above")


@query(f"{_EXECUTED_SQL} SELECT event_id, automation_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'success' END AS status, count(*) AS n_steps, string_agg(id || ':' || status, ',' ORDER BY parent_id, branch, position) AS steps FROM executed GROUP BY ALL")
def run_log(spark, sf_dir: str) -> DataFrame:
    return runs.run_log(_executed(spark, sf_dir, "parent_id", "branch", "position", "status"))


@query(f"{_EXECUTED_SQL} SELECT DISTINCT user_id AS contact_id, tag FROM executed WHERE kind = 'add_tag' AND status = 'success' AND (user_id, tag) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)")
def engine_added_tags(spark, sf_dir: str) -> DataFrame:
    held = views.table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("contact_id"), F.col("o_orderpriority").alias("tag")).distinct()
    return runs.added_tags(_executed(spark, sf_dir, "contact_id", "tag", "status"), held)


_STEPS_SQL = _EXECUTED_SQL[_EXECUTED_SQL.index("placed AS (SELECT *, min"):_EXECUTED_SQL.index("  top_all AS")].rstrip().rstrip(",")
_PATHS_SQL = f"""WITH {_STEPS_SQL},
  roots AS (SELECT *, 'steps[' || position || ']' AS path, 0 AS depth FROM steps WHERE parent_id = -1),
  paths AS (SELECT * FROM roots UNION ALL SELECT s.*, r.path || '.' || s.branch || '.steps[' || s.position || ']', 1 FROM steps s JOIN roots r ON s.automation_id = r.automation_id AND s.parent_id = r.id)"""


@query(f"{_PATHS_SQL} SELECT id, automation_id, path, depth FROM paths")
def automation_paths(spark, sf_dir: str) -> DataFrame:
    return rules.tree_paths(_steps(spark, sf_dir), 2).select("id", "automation_id", "path", "depth")


@query(
    f"""{_PATHS_SQL}, checked AS (SELECT automation_id, path, unnest([
      CASE WHEN kind = 'send_message' AND trim(text_of_step) = '' THEN '.text|needs a text' END, CASE WHEN kind = 'wait' AND NOT amount > 0 THEN '.amount|needs a positive amount' END,
      CASE WHEN kind = 'send_webhook' AND id % 3 = 2 THEN '.url|needs an address' END, CASE WHEN kind = 'send_webhook' AND id % 3 = 1 THEN '.url|needs http or https' END]) AS issue FROM paths)
    SELECT automation_id, path || split_part(issue, '|', 1) AS path, split_part(issue, '|', 2) AS message FROM checked WHERE issue IS NOT NULL"""
)
def automation_issues(spark, sf_dir: str) -> DataFrame:
    url = F.when(F.col("id") % 3 == 0, "https://hooks.example.com/in").when(F.col("id") % 3 == 1, "ftp://hooks.example.com/in")
    steps = rules.tree_paths(_steps(spark, sf_dir), 2).withColumn("url", url).withColumn("text", F.col("text_of_step"))
    return rules.step_issues(steps, "automation_id")


@query(f"""WITH {_RUNS_SQL} SELECT automation_id, count(*) AS executions, max("at") AS last_executed_at FROM runs GROUP BY 1""")
def dispatched_counts(spark, sf_dir: str) -> DataFrame:
    return rules.execution_counts(_runs(spark, sf_dir))


_RESULTS_SQL = """results AS (SELECT phone, event_id AS seq, event_id % 4 <> 0 AS accepted FROM events JOIN contacts ON events.user_id = contacts.id),
  merged AS (SELECT c.id AS contact_id, c.user_id AS broadcast_id, arg_max(accepted, seq) AS accepted FROM contacts c LEFT JOIN results r ON c.phone = r.phone GROUP BY 1, 2)"""


def _merged(spark, sf_dir: str) -> DataFrame:
    """Contacts as recipients of a broadcast a tenant, and the answers of the delivery service by phone, in order."""
    c = views.contacts(spark, sf_dir)
    answers = views.table(spark, sf_dir, "events").join(c.select("id", "phone"), F.col("user_id") == F.col("id")).select("phone", F.col("event_id").alias("seq"), (F.col("event_id") % 4 != 0).alias("accepted"))
    return status.merge_results(c.select(F.col("id").alias("contact_id"), F.col("user_id").alias("broadcast_id"), "phone"), answers)


@query(with_views("", "contacts").rstrip() + f", {_RESULTS_SQL} SELECT contact_id, broadcast_id, CASE WHEN accepted THEN 'sent' WHEN accepted IS NULL THEN 'pending' ELSE 'failed' END AS status FROM merged")
def send_result_merge(spark, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("contact_id", "broadcast_id", "status")


@query(
    with_views("", "contacts").rstrip() + f""", {_RESULTS_SQL} SELECT broadcast_id, count(*) AS total, count(*) FILTER (accepted) AS n_sent, count(*) FILTER (NOT accepted) AS n_failed,
    CASE WHEN count(*) FILTER (accepted) = 0 AND count(*) FILTER (NOT accepted) > 0 THEN 'failed' ELSE 'sent' END AS status FROM merged GROUP BY 1"""
)
def send_outcomes(spark, sf_dir: str) -> DataFrame:
    return status.outcomes(_merged(spark, sf_dir))


@query(
    """SELECT id, name, phone, total, pages FROM (SELECT *, count(*) OVER () AS total, ceil(count(*) OVER () / 25.0)::BIGINT AS pages, row_number() OVER (ORDER BY id DESC) AS place FROM contacts
    WHERE contains(lower(name), '1') OR contains(lower(phone), '00') OR contains(lower(name || '@example.com'), '9@')) WHERE place BETWEEN 26 AND 50""",
    "contacts",
)
def search_page_with_total(spark, sf_dir: str) -> DataFrame:
    c = views.contacts(spark, sf_dir).withColumn("email", F.concat("name", F.lit("@example.com")))
    found = text.contains_text(F.col("name"), F.lit("1")) | text.contains_text(F.col("phone"), F.lit("00")) | text.contains_text(F.col("email"), F.lit("9@"))
    return contacts.page_with_total(c.filter(found), [F.desc("id")], 2, 25).select("id", "name", "phone", "total", "pages")
