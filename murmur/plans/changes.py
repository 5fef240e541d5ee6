"""Queries of keyed changes, inbound messages, templates, resumed runs and the dashboard; they join those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions import security
from murmur.operators import audience, changes, dashboard, inbound, messaging, rules, runs, status, templates
from murmur.plans import queries as q
from murmur.plans.queries import ORACLE_SQL, QUERIES, query  # noqa: F401
from murmur.sources import views
from murmur.sources.webhook import explode_webhook
from murmur.streaming import folds

#: The default stages of a tenant's first pipeline; a fixture, as the colours and names are data.
STAGES = [("New", "blue"), ("Qualified", "green"), ("Proposal", "amber"), ("Won", "violet"), ("Lost", "red")]
TODAY = "2024-01-02"


# --- keyed changes ---


@query("SELECT id, contact_id, CASE WHEN id % 7 = 0 THEN '1-URGENT' ELSE stage_id END AS stage_id, CASE WHEN id % 7 = 0 THEN NULL ELSE status END AS status FROM deals", "deals")
def deals_moved(spark, sf_dir: str) -> DataFrame:
    d = views.deals(spark, sf_dir).select("id", "contact_id", "stage_id", "status")
    moved = views.table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), F.lit("1-URGENT").alias("stage_id"), F.lit(None).cast("string").alias("status"))
    return changes.update_by_key(d, moved, ["id"])


@query("SELECT d.id, d.contact_id, CASE WHEN c_acctbal < 0 THEN 'lost' ELSE status END AS status FROM deals d LEFT JOIN customer ON contact_id = c_custkey", "deals")
def deals_of_contacts_closed(spark, sf_dir: str) -> DataFrame:
    """A key that is not unique among the rows: every deal of a contact."""
    d = views.deals(spark, sf_dir).select("id", "contact_id", "status")
    gone = views.table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("contact_id"), F.lit("lost").alias("status"))
    return changes.update_by_key(d, gone, ["contact_id"])


@query("SELECT event_id, user_id, 'running' AS status FROM events WHERE event_id % 3 = 0 AND event_type <> 'error' AND ts <= TIMESTAMP '2024-01-20'")
def claimed_timers(spark, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    pending = e.select("event_id", "user_id", F.when(F.col("event_type") == "error", "running").otherwise("pending").alias("status"))
    due = e.filter("event_id % 3 = 0 AND ts <= TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("event_id")
    return changes.claim(pending, due, "event_id")


@query("SELECT contact_id, field, value FROM custom_values WHERE contact_id % 4 <> 0 UNION ALL SELECT c_custkey, 'nation', upper(c_name) FROM customer WHERE c_custkey % 8 = 0", "custom_values")
def custom_values_replaced(spark, sf_dir: str) -> DataFrame:
    """Contacts whose form was saved: their old values go; blank ones are not written."""
    c = views.table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("contact_id"), F.when(F.col("c_custkey") % 8 == 0, F.upper("c_name")).otherwise("  ").alias("value"))
    new = c.filter(F.trim("value") != "").select("contact_id", F.lit("nation").alias("field"), "value")
    return changes.replace_children(views.custom_values(spark, sf_dir), c, new, "contact_id")


@query("SELECT n_nationkey AS user_id, (s.position - 1)::INTEGER AS position, " + str([n for n, _ in STAGES]) + "[s.position] AS name, " + str([c for _, c in STAGES]) + "[s.position] AS colour FROM nation, range(1, 6) s(position) WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def seeded_stages(spark, sf_dir: str) -> DataFrame:
    tenants = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"))
    owned = views.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("user_id"))
    return changes.seed_if_empty(tenants, owned, STAGES)


@query(q._TALKS("SELECT conversation_id, CASE WHEN conversation_id % 2 = 0 THEN 0 ELSE unread_count END AS unread_count, conversation_id % 2 = 0 AND unread_count > 0 AS touched FROM talks"))
def threads_marked_read(spark, sf_dir: str) -> DataFrame:
    c = messaging.conversations(views.messages(spark, sf_dir)).select("conversation_id", "unread_count")
    return changes.mark_read(c, c.filter("conversation_id % 2 = 0"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'O' END AS status, o_orderstatus IN ('O', 'F') AS accepted FROM orders")
def status_normalized(spark, sf_dir: str) -> DataFrame:
    """Values outside the list are marked, then become the first state."""
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return changes.split_by_enum(rows, "status", ["O", "F"]).withColumn("status", F.when(F.col("accepted"), F.coalesce("status", F.lit("O"))).otherwise("O"))


@query("SELECT count(*) FILTER (length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 8) AS imported, count(*) FILTER (length(regexp_replace(phone, '[^0-9]', '', 'g')) < 8) AS failed FROM contacts", "contacts")
def import_counts(spark, sf_dir: str) -> DataFrame:
    return changes.import_outcome(views.contacts(spark, sf_dir), F.length(F.regexp_replace("phone", "[^0-9]", "")) >= 8)


_PLACED = "SELECT o_orderkey AS id, o_custkey AS pipeline_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders"


@query(
    f"""SELECT id, pipeline_id, (row_number() OVER (PARTITION BY pipeline_id ORDER BY CASE WHEN position = f THEN t + CASE WHEN t > f THEN 0.5 ELSE -0.5 END ELSE position END, id) - 1)::INTEGER AS position
    FROM (SELECT *, CASE WHEN pipeline_id % 2 = 0 THEN 0 WHEN pipeline_id % 3 = 0 THEN 2 END AS f, CASE WHEN pipeline_id % 2 = 0 THEN 2 WHEN pipeline_id % 3 = 0 THEN 1 END AS t FROM ({_PLACED}))"""
)
def stages_reordered(spark, sf_dir: str) -> DataFrame:
    """In even pipelines the first item moves to the third place; in others that three divides, the third moves up one."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("pipeline_id"))
    o = o.withColumn("position", F.row_number().over(Window.partitionBy("pipeline_id").orderBy("id")) - 1)
    even = F.col("c_custkey") % 2 == 0
    moves = views.table(spark, sf_dir, "customer").filter(even | (F.col("c_custkey") % 3 == 0)).select(F.col("c_custkey").alias("pipeline_id"), F.when(even, 0).otherwise(2).alias("from_position"), F.when(even, 2).otherwise(1).alias("to_position"))
    return changes.move_item(o, "pipeline_id", "id", moves)


@query(f"WITH {q._STEPS_SQL} SELECT id + 1000000000 * (automation_id + 1) AS id, -automation_id - 1 AS automation_id, CASE WHEN parent_id = -1 THEN -1 ELSE parent_id + 1000000000 * (automation_id + 1) END AS parent_id, branch, position::INTEGER AS position, kind FROM steps WHERE automation_id % 2 = 0")
def rules_duplicated(spark, sf_dir: str) -> DataFrame:
    copies = q._automations(spark, sf_dir).filter("id % 2 = 0").select(F.col("id").alias("automation_id"), (-F.col("id") - 1).alias("copy_id"))
    copied = changes.copy_trees(q._steps(spark, sf_dir), copies, lambda old, copy: old - F.lit(1_000_000_000) * copy)
    return copied.select("id", "automation_id", "parent_id", "branch", "position", "kind")


# --- resumed runs and activation ---

_RESUMED_SQL = f"""{q._EXECUTED_SQL}, again AS (SELECT r.* EXCLUDE (parent_id, branch), s.* EXCLUDE (automation_id), CASE WHEN kind IN ('send_message', 'create_deal') THEN replace(text_of_step, '{{{{ message.text }}}}', r.text) END AS body
      FROM (SELECT event_id, automation_id, parent_id, branch, text, position + 1 AS next FROM executed WHERE status = 'partial' AND run_at <= TIMESTAMP '2024-01-31') r JOIN steps s ON s.automation_id = r.automation_id AND s.parent_id = r.parent_id AND s.branch = r.branch AND s.position >= r.next),
    judged AS (SELECT *, CASE WHEN kind = 'send_message' AND trim(body) = '' OR kind = 'create_deal' AND stage IS NULL THEN 'failed' WHEN kind = 'wait' THEN 'partial' WHEN kind = 'update_contact_field' AND field NOT IN ('name', 'email', 'company') THEN 'skipped' ELSE 'success' END AS status FROM again),
    stopped AS (SELECT *, min(CASE WHEN status IN ('failed', 'partial') THEN position END) OVER (PARTITION BY event_id, automation_id, parent_id, branch) AS stop FROM judged)
    SELECT event_id, id AS step_id, kind, position::INTEGER AS position, status FROM stopped WHERE stop IS NULL OR position <= stop"""


@query(_RESUMED_SQL)
def resumed_step_log(spark, sf_dir: str) -> DataFrame:
    """Parked runs that are due go on behind their waiting step."""
    r, s = q._runs(spark, sf_dir), q._steps(spark, sf_dir)
    due = runs.parked(runs.execute(r, s, keep=runs.OF_PARKED)).filter("run_at <= TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    return runs.execute(r, s, parked=due, keep=("position", "status")).select("event_id", F.col("id").alias("step_id"), "kind", "position", "status")


def _triggers(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("keyword_match", "time_based", "tag_added", "new_message_received"))), (k % 4 + 1).cast("int"))
    words = F.when(k % 16 == 0, F.array().cast("array<string>")).when(k % 16 == 4, F.array(F.lit("price"), F.lit(" "))).when(k % 16 == 8, F.array(F.lit("price")))
    return views.table(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("trigger"), words.alias("keywords"), F.when(k % 3 == 0, "exact").when(k % 3 == 1, "begins").alias("match_type"), F.when(k % 8 == 1, "09:00").otherwise(" ").alias("schedule"), F.when(k % 8 == 2, F.col("c_mktsegment")).alias("tag"), (k % 5 != 0).alias("is_active"))


_ISSUES_SQL = """issues AS (SELECT id, issue.path AS path, issue.message AS message FROM (SELECT c_custkey AS id, unnest([
    CASE WHEN c_custkey % 16 IN (0, 12) THEN {'path': 'trigger.keywords', 'message': 'at least one keyword is required'} END,
    CASE WHEN c_custkey % 16 = 4 THEN {'path': 'trigger.keywords', 'message': 'keywords cannot be empty strings'} END,
    CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN {'path': 'trigger.match_type', 'message': 'match type must be "exact" or "contains"'} END,
    CASE WHEN c_custkey % 4 = 1 AND c_custkey % 8 <> 1 THEN {'path': 'trigger.schedule', 'message': 'schedule is required'} END,
    CASE WHEN c_custkey % 4 = 2 AND (c_custkey % 8 <> 2 OR c_mktsegment IS NULL) THEN {'path': 'trigger.tag_id', 'message': 'tag is required'} END]) AS issue FROM customer) WHERE issue IS NOT NULL)"""


@query(f"WITH {_ISSUES_SQL} SELECT * FROM issues")
def trigger_issues(spark, sf_dir: str) -> DataFrame:
    return rules.trigger_issues(_triggers(spark, sf_dir))


@query(f"WITH {_ISSUES_SQL} SELECT c_custkey AS id, count(path) AS n_issues, c_custkey % 5 <> 0 AND count(path) = 0 AS is_active FROM customer LEFT JOIN issues ON id = c_custkey GROUP BY c_custkey")
def activation_gate(spark, sf_dir: str) -> DataFrame:
    r = _triggers(spark, sf_dir)
    return rules.may_activate(r, rules.trigger_issues(r)).select("id", "n_issues", "is_active")


# --- templates ---

_RAW = ("IN_APPEAL", "approved", "PAUSED", "OTHER", "REJECTED")


def _pages(spark, sf_dir: str) -> DataFrame:
    """Parts as a provider's templates, 100 a page; two parts in a hundred repeat a name."""
    k = F.col("p_partkey")
    part = lambda kind, words, fmt=None: F.struct(F.lit(kind).alias("type"), F.lit(fmt).cast("string").alias("format"), words.alias("text"))
    body = part("BODY", F.concat(F.lit("Hi {{2}}, "), F.col("p_name"), F.lit(" {{10}} {{2}}")))
    parts = F.when(k % 3 == 0, F.array(part("FOOTER", F.col("p_brand")), part("HEADER", F.col("p_type"), "TEXT"), body)).when(k % 3 == 1, F.array(body)).otherwise(F.array(part("FOOTER", F.col("p_brand"))))
    t = F.struct(F.concat(F.lit("t"), (k - F.when(k % 50 == 1, 1).otherwise(0)).cast("string")).alias("name"), F.lit("en").alias("language"), F.when(k % 2 == 0, "utility").otherwise("NEWS").alias("category"), F.element_at(F.array(*map(F.lit, _RAW)), (k % 5 + 1).cast("int")).alias("status"), parts.alias("components"))
    rows = views.table(spark, sf_dir, "part").select((F.floor(k / 100) + 1).alias("page"), k.alias("k"), t.alias("t"))
    data = F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"])
    return rows.groupBy("page").agg(F.to_json(F.struct(data.alias("data"))).alias("body"))


_PARSED_SQL = """parsed AS (SELECT p_partkey AS k, 't' || (p_partkey - (p_partkey % 50 = 1)::INTEGER) AS name, 'en' AS language, CASE WHEN p_partkey % 2 = 0 THEN 'Utility' ELSE 'Marketing' END AS category,
    ['Pending', 'Approved', 'Rejected', 'Draft', 'Rejected'][p_partkey % 5 + 1] AS status, CASE WHEN p_partkey % 3 = 0 THEN 'text' END AS header_type, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS header_content,
    CASE WHEN p_partkey % 3 < 2 THEN 'Hi {{2}}, ' || p_name || ' {{10}} {{2}}' ELSE '' END AS body_text, CASE WHEN p_partkey % 3 <> 1 THEN p_brand END AS footer_text FROM part WHERE p_partkey < 2000)"""


@query(f"WITH {_PARSED_SQL} SELECT k // 100 + 1 AS page, (k % 100)::INTEGER AS place, * EXCLUDE (k) FROM parsed")
def template_rows(spark, sf_dir: str) -> DataFrame:
    return templates.parse_pages(_pages(spark, sf_dir))


@query(
    f"""WITH {_PARSED_SQL}, once AS (SELECT name, count(*) AS times FROM parsed GROUP BY 1), stored AS (SELECT 't' || p_partkey AS name, 1 + (p_partkey % 9 = 0)::INTEGER AS n FROM part WHERE p_partkey % 3 = 0)
    SELECT sum(times)::BIGINT AS total, count(*) FILTER (n IS NULL) AS inserted, (coalesce(sum(times - 1) FILTER (n IS NULL), 0) + coalesce(sum(times) FILTER (n = 1), 0))::BIGINT AS updated, coalesce(sum(times) FILTER (n > 1), 0)::BIGINT AS errors FROM once LEFT JOIN stored USING (name)"""
)
def template_sync_totals(spark, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("name"), F.lit("en").alias("language"))
    return templates.sync_totals(templates.parse_pages(_pages(spark, sf_dir)), p.unionByName(p.filter("p_partkey % 9 = 0")))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '{{10}}' ELSE '{{10}},{{2}}' END AS unmapped,
    replace(replace('{{2}} and {{1}}, ' || p_name || ' {{10}}', '{{1}}', p_brand), '{{2}}', CASE WHEN p_partkey % 2 = 0 THEN 'see {{10}}' ELSE ' ' END) AS preview FROM part"""
)
def template_drafts(spark, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("{{2}} and {{1}}, "), F.col("p_name"), F.lit(" {{10}}"))
    variables = F.create_map(F.lit("1"), F.col("p_brand"), F.lit("2"), F.when(F.col("p_partkey") % 2 == 0, "see {{10}}").otherwise(" "))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(templates.unmapped(body, variables), ",").alias("unmapped"), templates.draft_preview(body, variables).alias("preview"))


# --- inbound messages ---

_CUT = "2024-01-16 00:00:00"


def _sent(spark, sf_dir: str) -> DataFrame:
    """Events as webhook bodies: a third comes from unknown numbers; texts, images, stickers, places, reactions and replies."""
    e, i = views.table(spark, sf_dir, "events"), F.col("event_id")
    c = views.contacts(spark, sf_dir).select(F.col("id").alias("user_id"), "phone")
    e = e.withColumn("prior", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).join(c, "user_id")
    user, r = F.col("user_id").cast("string"), i % 11
    phone = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("99900"), F.lpad(user, 6, "0"))).otherwise(F.col("phone"))
    kind = F.when(r == 0, "reaction").when(r == 1, "image").when(r == 2, "sticker").when(r == 3, "location").otherwise("text")
    prior = F.col("prior").cast("string")
    message = F.struct(
        i.cast("string").alias("id"), phone.alias("from"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), kind.alias("type"), F.when(r > 3, F.struct(F.col("props").alias("body"))).alias("text"), F.when(r == 1, F.struct(i.cast("string").alias("id"))).alias("image"),
        F.when(r == 3, F.struct(F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"), F.lit("Office").alias("name"))).alias("location"), F.when(r == 0, F.struct(prior.alias("message_id"), F.when(i % 2 == 0, "").otherwise("heart").alias("emoji"))).alias("reaction"), F.when(i % 5 == 0, F.struct(prior.alias("id"))).alias("context"),
    )
    value = F.struct(F.array(F.struct(F.struct(F.concat(F.lit("user "), user).alias("name")).alias("profile"))).alias("contacts"), F.array(message).alias("messages"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(value.alias("value"))).alias("changes"))).alias("entry")))
    return explode_webhook(e.select(body.alias("body")))["messages"].withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


def _arrived(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What came since the cut, resolved, and the stored messages of known contacts from before it."""
    m, c = _sent(spark, sf_dir), views.contacts(spark, sf_dir)
    cut = F.lit(_CUT).cast("timestamp_ntz")
    before = inbound.resolved(m.filter(F.col("sent_at") < cut), c).filter("known IS NOT NULL AND kind != 'reaction'")
    return inbound.resolved(m.filter(F.col("sent_at") >= cut), c), before.select("id", F.col("contact_id").alias("conversation_id"), F.lit("customer").alias("sender_type"))


_KEY = "CASE WHEN length({0}) >= 8 THEN right({0}, 8) ELSE {0} END"
_ARRIVED_SQL = f""", keyed AS (SELECT {_KEY.format("d")} AS k, min(id) AS known FROM (SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM contacts) GROUP BY 1),
  sent AS (SELECT event_id, event_id::VARCHAR AS id, event_id % 11 AS r, date_trunc('second', ts) AS sent_at, props, 'user ' || user_id AS name, CASE WHEN user_id % 3 = 0 THEN '99900' || lpad(user_id::VARCHAR, 6, '0') ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS phone,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)::VARCHAR AS prior FROM events JOIN (SELECT id AS cid, phone FROM contacts) ON cid = user_id),
  came AS (SELECT s.*, known, coalesce(known::VARCHAR, 'new ' || k) AS contact FROM (SELECT *, {_KEY.format("phone")} AS k FROM sent) s LEFT JOIN keyed USING (k)),
  stored AS (SELECT id, contact FROM came WHERE sent_at < TIMESTAMP '{_CUT}' AND known IS NOT NULL AND r <> 0),
  new AS (SELECT *, known IS NULL AND row_number() OVER (PARTITION BY contact ORDER BY sent_at, id) = 1 AS was_created FROM came WHERE sent_at >= TIMESTAMP '{_CUT}'),
  said AS (SELECT *, CASE WHEN r IN (1, 2) THEN 'image' WHEN r = 3 THEN 'location' ELSE 'text' END AS kind, CASE WHEN r = 3 THEN 'Office - 1.5, 2.5' WHEN r > 3 THEN props END AS content,
    contact NOT IN (SELECT contact FROM stored) AND row_number() OVER (PARTITION BY contact ORDER BY sent_at, id) = 1 AS first_inbound FROM new WHERE r <> 0),
  there AS (SELECT id AS reply_to, contact FROM stored UNION SELECT id, contact FROM said),
  ins AS (SELECT s.*, t.reply_to FROM said s LEFT JOIN there t ON t.contact = s.contact AND t.reply_to = s.prior AND s.event_id % 5 = 0)"""


def _known(column: str):
    """New ids are hashes, which SQL has no word for: -1 in their place."""
    return F.greatest(F.col(column), F.lit(-1))


@query(f"{_ARRIVED_SQL} SELECT phone, name FROM new WHERE was_created", "contacts")
def inbound_new_contacts(spark, sf_dir: str) -> DataFrame:
    return inbound.new_contacts(_arrived(spark, sf_dir)[0]).select("phone", "name")


@query(f"{_ARRIVED_SQL} SELECT id, coalesce(known, -1) AS conversation_id, kind, content, sent_at, reply_to, first_inbound, was_created FROM ins", "contacts")
def inbound_inserts(spark, sf_dir: str) -> DataFrame:
    return inbound.inserts(*_arrived(spark, sf_dir)).select("id", _known("conversation_id").alias("conversation_id"), "kind", "content", "sent_at", "reply_to", "first_inbound", "was_created")


@query(
    f"""{_ARRIVED_SQL} SELECT coalesce(any_value(known), -1) AS conversation_id, arg_max(coalesce(nullif(content, ''), '[' || kind || ']'), (sent_at, id)) AS last_message_text, max(sent_at) AS last_message_at,
    count(*) + coalesce(any_value(CASE WHEN contact IN (SELECT contact FROM stored) THEN known % 4 END), 0) AS unread_count FROM ins GROUP BY contact""",
    "contacts",
)
def inbound_previews(spark, sf_dir: str) -> DataFrame:
    rows, stored = _arrived(spark, sf_dir)
    talks = stored.select("conversation_id").distinct().withColumn("unread_count", F.col("conversation_id") % 4)
    return inbound.previews(inbound.inserts(rows, stored), talks).withColumn("conversation_id", _known("conversation_id"))


@query(
    f"""{_ARRIVED_SQL} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY place) - 1)::INTEGER AS place, trigger FROM (SELECT id, unnest([0, 1, 2, 3]) AS place,
    unnest([CASE WHEN first_inbound THEN 'first_inbound_message' END, CASE WHEN was_created THEN 'new_contact_created' END, 'new_message_received', CASE WHEN contains(content, '"k": 7') THEN 'keyword_match' END]) AS trigger FROM ins) WHERE trigger IS NOT NULL""",
    "contacts",
)
def inbound_triggers(spark, sf_dir: str) -> DataFrame:
    return inbound.triggers(inbound.inserts(*_arrived(spark, sf_dir)), rules.keyword_matches(F.col("content"), ['"k": 7']))


@query(
    f"""{_ARRIVED_SQL} SELECT message_id, actor_id, emoji, "at" FROM (SELECT n.prior AS message_id, coalesce(any_value(n.known), -1) AS actor_id, arg_max(CASE WHEN event_id % 2 = 0 THEN '' ELSE 'heart' END, (sent_at, n.id)) AS emoji, max(sent_at) AS "at"
    FROM new n JOIN there t ON t.contact = n.contact AND t.reply_to = n.prior WHERE r = 0 GROUP BY n.prior, n.contact) WHERE emoji <> ''""",
    "contacts",
)
def inbound_reactions(spark, sf_dir: str) -> DataFrame:
    """Reactions to stored messages and to those of the batch."""
    rows, stored = _arrived(spark, sf_dir)
    known = stored.unionByName(inbound.inserts(rows, stored).select("id", "conversation_id", "sender_type"))
    return inbound.reactions(rows, known).withColumn("actor_id", _known("actor_id"))


# --- dashboard ---

_DAY = "TIMESTAMP '2024-01-02'"
_BETWEEN = "{0} >= TIMESTAMP '2024-01-01' AND {0} < TIMESTAMP '2024-01-02'"


def _dated_contacts(spark, sf_dir: str) -> DataFrame:
    born = F.timestamp_add("DAY", F.col("id") % 30, F.lit("2023-12-05 06:00:00").cast("timestamp_ntz"))
    return views.contacts(spark, sf_dir).withColumn("created_at", born)


@query(
    q._TALKS(
        f""", deals AS ({views.SQL['deals']}), born AS (SELECT TIMESTAMP '2023-12-05 06:00:00' + to_days((id % 30)::INTEGER) AS began FROM contacts)
    SELECT 'active_conversations' AS metric, count(*)::DOUBLE AS current, (count(*) FILTER (created_at >= {_DAY}) - count(*) FILTER ({_BETWEEN.format('created_at')}))::DOUBLE AS previous FROM talks WHERE status = 'open'
    UNION ALL SELECT 'new_contacts', count(*) FILTER (began >= {_DAY})::DOUBLE, count(*) FILTER ({_BETWEEN.format('began')})::DOUBLE FROM born
    UNION ALL SELECT 'open_deals', count(*)::DOUBLE, NULL FROM deals WHERE status = 'open'
    UNION ALL SELECT 'open_deals_value', coalesce(sum(value), 0)::DOUBLE, NULL FROM deals WHERE status = 'open'
    UNION ALL SELECT 'messages_sent', count(*) FILTER (created_at >= {_DAY})::DOUBLE, count(*) FILTER ({_BETWEEN.format('created_at')})::DOUBLE FROM messages WHERE sender_type = 'agent'"""
    )
)
def dashboard_metrics(spark, sf_dir: str) -> DataFrame:
    m = views.messages(spark, sf_dir)
    return dashboard.metrics(messaging.conversations(m), _dated_contacts(spark, sf_dir), views.deals(spark, sf_dir), m, TODAY)


_NAMED = "coalesce(nullif(name, ''), nullif(phone, ''))"


@query(
    f"""SELECT * FROM (
      (SELECT 'msg-' || m.id AS id, 'message' AS kind, 'New message from ' || coalesce({_NAMED}, 'Unknown') AS text, created_at AS "at", '/inbox?c=' || conversation_id AS href FROM (SELECT * FROM messages WHERE sender_type = 'customer' ORDER BY created_at DESC, id DESC LIMIT 10) m LEFT JOIN (SELECT id AS cid, name, phone FROM contacts) ON cid = conversation_id)
      UNION ALL (SELECT 'contact-' || id, 'contact', 'New contact: ' || {_NAMED}, born, '/contacts' FROM (SELECT *, TIMESTAMP '2023-12-05 06:00:00' + to_days((id % 30)::INTEGER) AS born FROM contacts) ORDER BY born DESC, id DESC LIMIT 10)
      UNION ALL (SELECT 'deal-' || id, 'deal', 'Deal "#' || id || '" ' || CASE WHEN id % 5 = 0 THEN 'updated' ELSE 'in ' || stage_id END, updated_at, '/pipelines' FROM deals ORDER BY updated_at DESC, id DESC LIMIT 10)
      UNION ALL (SELECT 'broadcast-' || id, 'broadcast', 'Broadcast "No ' || id || '" ' || CASE WHEN id % 2 = 0 THEN 'sent to ' || total || ' contacts' ELSE 'draft (' || total || ' recipients)' END, last, '/broadcasts' FROM (SELECT broadcast_id AS id, count(*) AS total, max(created_at) AS last FROM recipients GROUP BY 1) ORDER BY last DESC, id DESC LIMIT 5)
      UNION ALL (SELECT 'auto-' || event_id, 'automation', 'Automation "Rule ' || user_id || '" ' || CASE WHEN event_id % 3 = 0 THEN 'failed for ' ELSE 'triggered for ' END || coalesce({_NAMED}, 'a contact'), ts, NULL FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10) LEFT JOIN (SELECT id AS cid, name, phone FROM contacts) ON cid = user_id))
    ORDER BY "at" DESC, id LIMIT 20""",
    "messages", "contacts", "deals", "recipients",
)
def dashboard_activity(spark, sf_dir: str) -> DataFrame:
    string = lambda c: F.col(c).cast("string")
    d = views.deals(spark, sf_dir).select("id", F.concat(F.lit("#"), string("id")).alias("title"), F.when(F.col("id") % 5 != 0, F.col("stage_id")).alias("stage_id"), "updated_at")
    b = views.recipients(spark, sf_dir).groupBy(F.col("broadcast_id").alias("id")).agg(F.count("*").alias("total"), F.max("created_at").alias("created_at"))
    b = b.withColumns({"name": F.concat(F.lit("No "), string("id")), "status": F.when(F.col("id") % 2 == 0, "sent").otherwise("draft")})
    logs = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("contact_id"), F.concat(F.lit("Rule "), string("user_id")).alias("automation"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("success").alias("status"))
    return dashboard.activity(views.messages(spark, sf_dir), _dated_contacts(spark, sf_dir), d, b, logs)


_STEPS = ["sent_count", "delivered_count", "read_count", "replied_count"]


@query(
    "SELECT broadcast_id, r.place AS place, r.step AS step, r.value AS value, greatest(5, floor(100.0::DOUBLE * r.value / top + 0.5))::BIGINT AS of_max, CASE WHEN sent_count > 0 THEN floor(100.0::DOUBLE * r.value / sent_count + 0.5) ELSE 0 END::BIGINT AS of_first FROM (SELECT *, greatest(1, sent_count, delivered_count, read_count, replied_count) AS top, unnest(["
    + ", ".join(f"{{'place': {i}, 'step': '{s}', 'value': {s}}}" for i, s in enumerate(_STEPS)) + f"]) AS r FROM (SELECT broadcast_id, {q._COUNTS} FROM recipients GROUP BY 1))",
    "recipients",
)
def broadcast_funnel_steps(spark, sf_dir: str) -> DataFrame:
    return dashboard.funnel(status.broadcast_counts(views.recipients(spark, sf_dir)), "broadcast_id", _STEPS)


@query(
    """SELECT top, array_to_string(list_distinct_ordered, ',') AS ticks, stride FROM (SELECT top, stride, [floor(x * top / 4.0 + 0.5)::BIGINT FOR x IN [0, 1, 2, 3, 4]] AS list_distinct_ordered
    FROM (SELECT greatest(1, max(greatest(i, o))) AS top, greatest(1, ceil(count(*) / 6.0))::BIGINT AS stride FROM (SELECT created_at::DATE AS day, count(*) FILTER (sender_type = 'customer') AS i, count(*) FILTER (sender_type <> 'customer') AS o FROM messages WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-31' GROUP BY 1)))""",
    "messages",
)
def chart_scale(spark, sf_dir: str) -> DataFrame:
    return dashboard.chart_scale(messaging.daily_series(views.messages(spark, sf_dir), "2024-01-30", 30), "incoming", "outgoing")


@query("SELECT event_id, props AS plain, true AS three_parts, event_id % 2 = 0 AS renewed FROM events")
def tokens_renewed(spark, sf_dir: str) -> DataFrame:
    """Every second token is of the older form; after renewal all are of the newer one and hold what they held."""
    key = "00" * 32
    old = F.when(F.col("event_id") % 2 == 0, security.encrypt_legacy_token(F.col("props"), key)).otherwise(security.encrypt_token(F.col("props"), key))
    e = views.table(spark, sf_dir, "events").select("event_id", old.alias("old")).withColumn("token", security.renewed_token(F.col("old"), key))
    return e.select("event_id", security.decrypt_any_token(F.col("token"), key).alias("plain"), (F.size(F.split("token", ":")) == 3).alias("three_parts"), security.is_legacy_token(F.col("old")).alias("renewed"))


@query("SELECT conversation_id, arg_max(coalesce(content_text, ''), (created_at, id)) AS last_message_text, max(created_at) AS last_message_at, count(*) FILTER (conversation_id <> 7) AS unread_count FROM messages GROUP BY 1", "messages")
def conversation_previews(spark, sf_dir: str) -> DataFrame:
    return folds.stream_previews(views.messages(spark, sf_dir), 7)


@query(
    """SELECT 'all' AS kind, greatest(0, (SELECT count(*) FROM contacts) - (SELECT count(DISTINCT contact_id) FROM contact_tags WHERE tag = '1-URGENT')) AS n
    UNION ALL SELECT 'tags', count(DISTINCT contact_id) FROM contact_tags WHERE tag IN ('2-HIGH', '5-LOW') AND contact_id NOT IN (SELECT contact_id FROM contact_tags WHERE tag = '1-URGENT')
    UNION ALL SELECT 'field', count(DISTINCT contact_id) FROM custom_values WHERE field = 'segment' AND value <> 'BUILDING' AND contact_id NOT IN (SELECT contact_id FROM contact_tags WHERE tag = '1-URGENT')
    UNION ALL SELECT 'csv', count(*) FROM orders UNION ALL SELECT 'incomplete', NULL""",
    "contacts", "contact_tags", "custom_values",
)
def audience_estimate_cases(spark, sf_dir: str) -> DataFrame:
    c, t = views.contacts(spark, sf_dir), views.contact_tags(spark, sf_dir)
    one = lambda name, kind, base=None: audience.estimate(kind, c, t, ["1-URGENT"], base).select(F.lit(name).alias("kind"), "n")
    out = one("all", "all").unionByName(one("tags", "ids", t.filter(F.col("tag").isin("2-HIGH", "5-LOW"))))
    out = out.unionByName(one("field", "ids", views.custom_values(spark, sf_dir).filter("field = 'segment' AND value != 'BUILDING'")))
    return out.unionByName(one("csv", "csv", views.table(spark, sf_dir, "orders"))).unionByName(one("incomplete", "none"))
