"""Queries of deep automation runs and of what they leave behind, each with DuckDB SQL.

The rules are one a customer; the customer's orders are its steps, in trees of up to seven levels: every second of the first
twelve is a condition below the one before, the steps between hang beside or below them, the rest stands at the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions.text import ordered_values
from murmur.operators import effects, runs
from murmur.operators.lineage import dealt
from murmur.plans.queries import query
from murmur.sources import views

KINDS = ("send_message", "send_template", "add_tag", "remove_tag", "assign_conversation", "update_contact_field", "create_deal", "send_webhook", "close_conversation", "wait")
SUBJECTS = ("tag_presence", "contact_field", "message_content", "time_of_day")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
WINDOWS = ("08:00-20:00", "22:30-06:15", "noon")
FIELDS = ("name", "email", "company", "phone")
DEPTH = 7


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _automations(spark, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    loose, strict = F.array(F.lit('"K": 7'), F.lit('"k": 3')), F.array(F.lit('{"K": 5}'), F.lit('{"k": 5}'), F.lit('{"k": 12}'))
    exact = key % 4 == 3
    return views.table(spark, sf_dir, "customer").select(
        key.alias("id"), key.alias("user_id"), F.when(key % 2 == 0, "new_message_received").otherwise("keyword_match").alias("trigger"),
        F.when(exact, strict).otherwise(loose).alias("keywords"), F.when(exact, "exact").otherwise("contains").alias("match_type"), exact.alias("case_sensitive"), (key % 5 != 0).alias("is_active"),
    )


def _contacts(spark, sf_dir: str) -> DataFrame:
    return views.contacts(spark, sf_dir).select("id", "user_id", "name", F.when(F.col("id") % 3 != 0, F.concat("name", F.lit("@example.com"))).alias("email"), "company", "phone")


def _conversations(spark, sf_dir: str) -> DataFrame:
    """Every third order; one in four of them belongs to another tenant."""
    key = F.col("o_orderkey")
    o = views.table(spark, sf_dir, "orders").filter(key % 3 == 0)
    return o.select(key.alias("id"), (F.col("o_custkey") + F.when(key % 4 == 0, 1).otherwise(0)).alias("user_id"), F.col("o_custkey").alias("contact_id"), F.when(key % 2 == 0, "open").otherwise("pending").alias("status"), F.when(key % 5 == 0, "old").alias("assigned_agent"))


def _profiles(spark, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return views.table(spark, sf_dir, "customer").filter(key % 5 != 1).select(key.alias("user_id"), F.concat(F.lit("p"), key.cast("string")).alias("agent"))


def _variables(key: Column) -> Column:
    """Keys in a mixed order; one map in seven is missing."""
    return F.when(key % 7 != 0, F.create_map(F.lit("name"), F.lit("N"), F.lit("10"), F.col("o_orderpriority"), F.lit("b.2"), key.cast("string"), F.lit("2"), F.lit("two"), F.lit("1"), F.when(key % 2 == 0, "one")))


def _steps(spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = views.table(spark, sf_dir, "orders")
    o = dealt(o, o.count(), "o_custkey").withColumn("r", F.row_number().over(by) - 1)
    back = lambda i: F.lag("o_orderkey", i).over(by)
    r = F.col("r")
    parent = F.when((r >= 12) | (r < 2), None).when(r % 2 == 0, back(2)).when(r % 4 == 3, back(1)).otherwise(back(3))
    o = o.withColumns({"parent_id": F.coalesce(parent, F.lit(-1)).cast("long"), "condition": (r % 2 == 0) & (r < 12)})
    o = o.withColumn("branch", F.when(F.col("parent_id") == -1, "").when((F.col("parent_id") % 4).isin(1, 2), "no").otherwise("yes"))
    subject = F.when(F.col("condition"), _pick(SUBJECTS, key))
    o = o.select(
        key.alias("id"), F.col("o_custkey").alias("automation_id"), "parent_id", "branch", F.when(F.col("condition"), "condition").otherwise(_pick(KINDS, key)).alias("kind"),
        F.when(key % 11 == 0, "  ").otherwise(F.concat(F.lit("Got {{ message.text }} for {{vars.name}}{{ other }} {{a-b}} #"), key.cast("string"))).alias("text_of_step"),
        F.when(key % 13 != 0, F.col("o_orderpriority")).alias("tag"), (key % 5).alias("amount"), F.when(key % 2 == 0, "hours").otherwise("days").alias("unit"), _pick(FIELDS, key).alias("field"), F.when(key % 7 != 0, F.col("o_orderpriority")).alias("stage"),
        subject.alias("subject"), F.when(subject == "tag_presence", F.col("o_orderpriority")).when(subject == "contact_field", "company").when(subject == "time_of_day", _pick(WINDOWS, key)).alias("operand"),
        F.when(subject == "contact_field", _pick(SEGMENTS, key)).when(subject == "message_content", F.concat(F.lit('"K": '), (key % 10).cast("string"))).when(~F.col("condition") & (key % 17 != 0), F.concat(F.lit("v"), key.cast("string"))).alias("value"),
        F.when(key % 8 != 1, F.concat(F.lit("t"), (key % 6).cast("string"))).alias("template"), _variables(key).alias("variables"), F.when(key % 9 != 4, F.concat(F.lit("a"), (key % 5).cast("string"))).alias("agent"), F.when(key % 3 == 0, "round_robin").otherwise("specific").alias("mode"),
        F.when(key % 4 == 3, F.col("o_totalprice").cast("decimal(12,2)")).alias("deal_value"), F.when(key % 19 != 0, "https://hooks.example.com/in").alias("url"),
    )
    return o.withColumn("position", F.row_number().over(Window.partitionBy("automation_id", "parent_id", "branch").orderBy("id")) - 1)


def _runs(spark, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    variables = F.when(i % 20 != 3, F.create_map(F.lit("name"), F.concat(F.lit("user "), F.col("user_id").cast("string"))))
    e = views.table(spark, sf_dir, "events").select(i, "user_id", F.col("ts").alias("at"), F.col("props").alias("text"), F.when(i % 50 != 0, F.col("user_id")).alias("contact_id"), F.when(i % 3 == 0, i * 10).alias("conversation_id"), variables.alias("vars"))
    return runs.dispatch(e, _automations(spark, sf_dir))


def _executed(spark, sf_dir: str, *keep: str) -> DataFrame:
    return runs.execute(_runs(spark, sf_dir), _steps(spark, sf_dir), _contacts(spark, sf_dir), views.contact_tags(spark, sf_dir), _conversations(spark, sf_dir), keep=keep)


def _list(values: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{at} % {len(values)} + 1]"


_BASE_SQL = f"""contacts AS (SELECT id, user_id, name, CASE WHEN id % 3 <> 0 THEN name || '@example.com' END AS email, company, phone FROM ({views.SQL['contacts']})),
  contact_tags AS ({views.SQL['contact_tags']}),
  talks AS (SELECT o_orderkey AS id, o_custkey + (o_orderkey % 4 = 0)::INTEGER AS user_id, o_custkey AS contact_id, CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'old' END AS assigned_agent FROM orders WHERE o_orderkey % 3 = 0),
  met AS (SELECT event_id, user_id AS automation_id, user_id, CASE WHEN event_id % 50 <> 0 THEN user_id END AS contact_id, CASE WHEN event_id % 3 = 0 THEN event_id * 10 END AS own, ts AS "at", props AS text, CASE WHEN event_id % 20 <> 3 THEN 'user ' || user_id ELSE '' END AS v_name
    FROM events JOIN customer ON user_id = c_custkey WHERE user_id % 5 <> 0 AND (user_id % 2 = 0 OR user_id % 4 = 1 AND (contains(lower(props), '"k": 7') OR contains(lower(props), '"k": 3')) OR user_id % 4 = 3 AND props IN ('{{"K": 5}}', '{{"k": 5}}', '{{"k": 12}}'))),
  one AS (SELECT user_id, contact_id, min(id) AS sole FROM talks GROUP BY ALL HAVING count(*) = 1),
  runs AS (SELECT met.*, coalesce(own, sole) AS conversation_id, company FROM met LEFT JOIN one USING (user_id, contact_id) LEFT JOIN (SELECT id AS contact_id, company FROM contacts) USING (contact_id)),
  ranked AS (SELECT *, row_number() OVER w - 1 AS r, lag(o_orderkey, 1) OVER w AS b1, lag(o_orderkey, 2) OVER w AS b2, lag(o_orderkey, 3) OVER w AS b3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  hung AS (SELECT *, r % 2 = 0 AND r < 12 AS is_condition, CASE WHEN r >= 12 OR r < 2 THEN -1 WHEN r % 2 = 0 THEN b2 WHEN r % 4 = 3 THEN b1 ELSE b3 END AS parent_id FROM ranked),
  steps0 AS (SELECT o_orderkey AS id, o_custkey AS automation_id, parent_id, CASE WHEN parent_id = -1 THEN '' WHEN parent_id % 4 IN (1, 2) THEN 'no' ELSE 'yes' END AS branch, CASE WHEN is_condition THEN 'condition' ELSE {_list(KINDS, 'o_orderkey')} END AS kind,
    CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE 'Got {{{{ message.text }}}} for {{{{vars.name}}}} {{{{a-b}}}} #' || o_orderkey END AS text_of_step, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS tag, o_orderkey % 5 AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'hours' ELSE 'days' END AS unit,
    {_list(FIELDS, 'o_orderkey')} AS field, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS stage, o_orderpriority AS priority, o_orderkey % 17 <> 0 AS filled, o_orderkey % 8 <> 1 AS templated, o_orderkey % 19 <> 0 AS addressed, o_orderkey % 3 = 0 AS turns, CASE WHEN o_orderkey % 9 <> 4 THEN 'a' || o_orderkey % 5 END AS agent,
    CASE WHEN o_orderkey % 4 = 3 THEN o_totalprice::DECIMAL(12,2) ELSE 0 END AS deal_value FROM hung),
  steps AS (SELECT *, row_number() OVER (PARTITION BY automation_id, parent_id, branch ORDER BY id) - 1 AS position FROM steps0),
  s0 AS (SELECT *, -1 AS parent_id, '' AS branch, []::INTEGER[] AS way FROM runs)"""
_RUN_COLUMNS = 'event_id, automation_id, user_id, contact_id, conversation_id, "at", text, v_name, company'


def _level(k: int) -> str:
    minute = 'hour("at") * 60 + minute("at")'
    window = f"CASE id % 3 WHEN 0 THEN {minute} >= 480 AND {minute} < 1200 WHEN 1 THEN {minute} >= 1350 OR {minute} < 375 ELSE false END"
    holds = f"""CASE id % 4 WHEN 0 THEN EXISTS (SELECT 1 FROM contact_tags t WHERE t.contact_id = r.contact_id AND t.tag = priority) WHEN 1 THEN company = {_list(SEGMENTS, 'id')} WHEN 2 THEN contains(lower(text), '"k": ' || id % 10) ELSE {window} END"""
    return f"""a{k} AS (SELECT {", ".join("r." + c for c in _RUN_COLUMNS.split(", "))}, r.parent_id, r.branch, r.way, s.* EXCLUDE (automation_id, parent_id, branch), list_append(r.way, s.position::INTEGER) AS place,
      CASE WHEN kind IN ('send_message', 'create_deal') THEN replace(replace(text_of_step, '{{{{ message.text }}}}', text), '{{{{vars.name}}}}', v_name) WHEN kind = 'send_webhook' THEN '{{"event_id":' || event_id || ',"automation_id":' || r.automation_id || ',"message":' || to_json(text) || '}}' END AS body,
      CASE WHEN kind = 'condition' THEN CASE WHEN {holds} THEN 'yes' ELSE 'no' END END AS chosen FROM s{k} r JOIN steps s ON r.automation_id = s.automation_id AND r.parent_id = s.parent_id AND r.branch = s.branch),
    j{k} AS (SELECT *, CASE WHEN kind NOT IN ('wait', 'condition', 'create_deal', 'send_webhook') AND contact_id IS NULL OR kind IN ('send_message', 'send_template') AND conversation_id IS NULL OR kind = 'send_message' AND trim(body) = '' OR kind = 'send_template' AND NOT templated OR kind IN ('add_tag', 'remove_tag') AND tag IS NULL
      OR kind = 'create_deal' AND stage IS NULL OR kind = 'send_webhook' AND NOT addressed THEN 'failed' WHEN kind = 'wait' THEN 'partial' WHEN kind = 'update_contact_field' AND field = 'phone' THEN 'skipped' ELSE 'success' END AS status FROM a{k}),
    l{k} AS (SELECT * EXCLUDE (stop) FROM (SELECT *, min(CASE WHEN status IN ('failed', 'partial') THEN position END) OVER (PARTITION BY event_id, automation_id, parent_id, branch) AS stop FROM j{k}) WHERE stop IS NULL OR position <= stop),
    s{k + 1} AS (SELECT {_RUN_COLUMNS}, id AS parent_id, chosen AS branch, place AS way FROM l{k} WHERE kind = 'condition')"""


_SQL = f"WITH {_BASE_SQL}, {', '.join(map(_level, range(DEPTH)))}, executed AS ({' UNION ALL '.join(f'SELECT * FROM l{k}' for k in range(DEPTH))})"
_ORDER = '("at", event_id, automation_id, place)'


@query(f"{_SQL} SELECT event_id, id AS step_id, kind, array_to_string(place, '.') AS place, status, chosen, body FROM executed")
def deep_step_log(spark, sf_dir: str) -> DataFrame:
    """Every step that ran, in trees of seven levels; all four kinds of conditions decide branches."""
    return _executed(spark, sf_dir, "status", "body").select("event_id", F.col("id").alias("step_id"), "kind", F.array_join("place", ".").alias("place"), "status", "chosen", "body")


@query(
    f"""{_SQL}, logged AS (SELECT event_id, automation_id, CASE WHEN bool_or(parent_id = -1 AND status = 'failed') THEN 'failed' WHEN bool_or(parent_id = -1 AND status = 'partial') THEN 'partial' ELSE 'success' END AS status, count(*) AS n_steps,
      string_agg(id || ':' || kind || ':' || CASE WHEN status = 'failed' THEN 'failed' ELSE 'success' END, ',' ORDER BY list_append(way, 2147483647), position) AS steps FROM executed GROUP BY ALL)
    SELECT event_id, automation_id, coalesce(status, 'success') AS status, coalesce(n_steps, 0) AS n_steps, coalesce(steps, '') AS steps FROM runs LEFT JOIN logged USING (event_id, automation_id)"""
)
def automation_logs(spark, sf_dir: str) -> DataFrame:
    return runs.automation_logs(_runs(spark, sf_dir), _executed(spark, sf_dir, "parent_id", "way", "position", "status"))


_PARAMS = "CASE WHEN {0} % 7 <> 0 THEN array_to_string([CASE WHEN {0} % 2 = 0 THEN 'one' ELSE '' END, 'two', priority, {0}::VARCHAR, 'N'], '|') ELSE '' END"


@query(f"{_SQL} SELECT event_id, id AS step_id, conversation_id, 't' || id % 6 AS template, {_PARAMS.format('id')} AS params FROM executed WHERE kind = 'send_template' AND status = 'success'")
def template_outbox(spark, sf_dir: str) -> DataFrame:
    return runs.template_outbox(_executed(spark, sf_dir, "conversation_id", "template", "params", "status")).withColumn("params", F.array_join("params", "|"))


@query(
    """SELECT id, string_agg(v, '|' ORDER BY n IS NULL, n, k) AS params FROM (SELECT o_orderkey AS id, unnest([{'k': CASE WHEN o_orderkey % 2 = 0 THEN '10' ELSE 'ten' END, 'v': o_orderpriority}, {'k': '2', 'v': 'two'}, {'k': (o_orderkey % 12)::VARCHAR || '.5', 'v': 'half'},
    {'k': CASE WHEN o_orderkey % 3 = 0 THEN '-1e1' ELSE '1e' END, 'v': 'power'}, {'k': 'Z', 'v': ''}], recursive := true) FROM orders), LATERAL (SELECT TRY_CAST(CASE WHEN k <> '1e' THEN k END AS DOUBLE) AS n) GROUP BY id"""
)
def template_params(spark, sf_dir: str) -> DataFrame:
    """Maps of mixed keys as positional parameters: numbers by number, then words."""
    key = F.col("o_orderkey")
    names = F.array(F.when(key % 2 == 0, "10").otherwise("ten"), F.lit("2"), F.concat((key % 12).cast("string"), F.lit(".5")), F.when(key % 3 == 0, "-1e1").otherwise("1e"), F.lit("Z"))
    mapped = F.map_from_arrays(names, F.array(F.col("o_orderpriority"), F.lit("two"), F.lit("half"), F.lit("power"), F.lit(None).cast("string")))
    return views.table(spark, sf_dir, "orders").select(key.alias("id"), F.array_join(ordered_values(mapped), "|").alias("params"))


@query(
    f"""{_SQL}, last AS (SELECT contact_id, tag, arg_max(kind, {_ORDER}) AS kind FROM executed WHERE kind IN ('add_tag', 'remove_tag') AND status = 'success' GROUP BY ALL)
    SELECT contact_id, tag FROM contact_tags FULL JOIN last USING (contact_id, tag) WHERE kind IS NULL OR kind = 'add_tag'"""
)
def tags_after_runs(spark, sf_dir: str) -> DataFrame:
    return effects.tags_after(_executed(spark, sf_dir, *effects.WRITE, "tag"), views.contact_tags(spark, sf_dir))


@query(
    f"""{_SQL}, last AS (SELECT contact_id, field, arg_max({{'x': CASE WHEN filled THEN 'v' || id END}}, {_ORDER}) AS v, max("at") AS "at" FROM executed WHERE kind = 'update_contact_field' AND status = 'success' GROUP BY ALL),
    set_ AS (SELECT contact_id AS id, any_value(v) FILTER (field = 'name') AS n, any_value(v) FILTER (field = 'email') AS e, any_value(v) FILTER (field = 'company') AS c, max("at") AS updated_at FROM last GROUP BY 1)
    SELECT id, CASE WHEN n IS NULL THEN name ELSE n.x END AS name, CASE WHEN e IS NULL THEN email ELSE e.x END AS email, CASE WHEN c IS NULL THEN company ELSE c.x END AS company, updated_at FROM contacts LEFT JOIN set_ USING (id)"""
)
def contacts_after_runs(spark, sf_dir: str) -> DataFrame:
    return effects.contacts_after(_executed(spark, sf_dir, *effects.WRITE, "field", "value"), _contacts(spark, sf_dir)).select("id", "name", "email", "company", "updated_at")


@query(f"""{_SQL} SELECT event_id, id AS step_id, user_id, contact_id, stage AS stage_id, body AS title, deal_value AS value, 'open' AS status, "at" AS created_at FROM executed WHERE kind = 'create_deal' AND status = 'success'""")
def deals_after_runs(spark, sf_dir: str) -> DataFrame:
    """The deals that came; those of before stay as they are."""
    return effects.deals_created(_executed(spark, sf_dir, *effects.WRITE, "stage", "body", "deal_value"))


@query(
    f"""{_SQL}, wrote AS (SELECT *, CASE WHEN turns THEN CASE WHEN user_id % 5 <> 1 THEN 'p' || user_id END ELSE agent END AS who FROM executed WHERE kind IN ('assign_conversation', 'close_conversation') AND status = 'success'),
    last AS (SELECT user_id, contact_id, arg_max(who, {_ORDER}) FILTER (kind = 'assign_conversation' AND who IS NOT NULL) AS who, max("at") FILTER (kind = 'close_conversation') AS closed FROM wrote GROUP BY ALL)
    SELECT id, user_id, contact_id, CASE WHEN closed IS NOT NULL THEN 'closed' ELSE status END AS status, coalesce(who, assigned_agent) AS assigned_agent, closed AS updated_at FROM talks LEFT JOIN last USING (user_id, contact_id)"""
)
def conversations_after_runs(spark, sf_dir: str) -> DataFrame:
    return effects.conversations_after(_executed(spark, sf_dir, *effects.WRITE, "mode", "agent"), _conversations(spark, sf_dir), _profiles(spark, sf_dir))
