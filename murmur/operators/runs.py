"""Automation runs: dispatch of events to rules, and interpretation of their step trees set by set.

A run is an event that met an active rule of its tenant. Its steps are interpreted scope by scope: all steps of all
runs at one depth of the trees are one join, so the driver's loop is over depth, never over rows, and ends when no run
has a scope open. Each depth is checkpointed, so none is computed again for the one below it. A scope stops at its first
step that fails or waits; a condition opens the scope of the branch it decides for, and its own scope goes on.

Where a scope stops is known from its steps, but for what the run lacks and for messages that may come out blank. So each
step is marked once with the last step before it that stops all runs, those without a contact and those without a conversation,
and with the messages before it that may be blank; a run's joined rows need not be gathered and sorted by scope.

Conditions see contacts and tags as they were before the batch; what the runs change comes out as writes in a total
order (``effects``). The order within a run is the place of a step: the positions on the way to it from the root.
"""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions.dates import wait_ms, within_window
from murmur.functions.text import PLACEHOLDER, interpolate, ordered_values
from murmur.operators.lineage import cut, fixed
from murmur.operators.rules import rule_matches

# The fields of a contact that a step may set.
WRITABLE = ("name", "email", "company")
STEP = ("id", "automation_id", "parent_id", "branch", "position", "kind", "text_of_step", "tag", "amount", "unit", "field", "stage")
#: Columns of a step that a table may lack, and what they are then.
OPTIONAL = {"subject": "'message_content'", "operand": "CAST(NULL AS STRING)", "value": "text_of_step", "template": "''", "variables": "CAST(NULL AS MAP<STRING, STRING>)", "agent": "CAST(NULL AS STRING)", "mode": "''", "url": "'-'", "deal_value": "CAST(NULL AS DECIMAL(12, 2))"}
#: Columns of a run, and those that dispatch takes over from events that have them.
RUN = ("event_id", "automation_id", "user_id", "contact_id", "conversation_id", "at", "text", "vars", "trigger")
CARRIED = ("contact_id", "conversation_id", "vars")
#: Steps that need a contact, and those that write into its conversation.
OF_CONTACT = ("send_message", "send_template", "add_tag", "remove_tag", "assign_conversation", "update_contact_field", "close_conversation")
SENDING = ("send_message", "send_template")
SCOPE = ("automation_id", "parent_id", "branch")
#: What the levels of the trees need of their rows.
ALWAYS = ("event_id", "automation_id", "id", "kind", "chosen", "place", "above")
#: What ``parked`` reads of them besides.
OF_PARKED = ("parent_id", "branch", "position", "status", "run_at", "way")


def dispatch(events: DataFrame, automations: DataFrame) -> DataFrame:
    """(event_id, user_id, at, text) meet active automations (id, user_id, trigger, and keyword or keywords, match_type and case_sensitive): one row a run.

    A keyword rule needs one of its keywords in the text, or as the text; other triggers always match. Events may carry contact_id, conversation_id and vars.
    """
    many = "keywords" in automations.columns
    words = [F.col(c) for c in ("keywords", "match_type", "case_sensitive")] if many else [F.array("keyword").alias("keywords"), F.lit("contains").alias("match_type"), F.lit(False).alias("case_sensitive")]
    rules = automations.filter("is_active").select(F.col("id").alias("automation_id"), "user_id", "trigger", *words)
    met = (F.col("trigger") != "keyword_match") | rule_matches(F.col("text"), F.col("keywords"), F.col("match_type"), F.col("case_sensitive"))
    carried = [c for c in CARRIED if c in events.columns]
    return events.join(rules, "user_id").filter(met).select("event_id", "automation_id", "user_id", "at", "text", "trigger", *carried)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _unset(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _status(talks_known: bool) -> Column:
    kind = F.col("kind")
    failed = kind.isin(*OF_CONTACT) & F.col("contact_id").isNull()
    failed |= ((kind == "send_message") & _blank(F.col("body"))) | _lacking()
    if talks_known:
        failed |= kind.isin(*SENDING) & F.col("conversation_id").isNull()
    skipped = (kind == "update_contact_field") & ~F.coalesce(F.col("field").isin(*WRITABLE), F.lit(False))
    return F.when(failed, "failed").when(kind == "wait", "partial").when(skipped, "skipped").otherwise("success")


def _lacking() -> Column:
    """Steps that fail in every run, as they lack what their kind needs."""
    kind = F.col("kind")
    return ((kind == "send_template") & _unset("template")) | (kind.isin("add_tag", "remove_tag") & _unset("tag")) | ((kind == "create_deal") & _unset("stage")) | ((kind == "send_webhook") & _unset("url"))


def _marked(steps: DataFrame) -> DataFrame:
    """steps with the last position before theirs, in their scope, where every run stops, where runs without a contact or without a conversation do, and the messages (position, text) before it that may come out blank."""
    kind = F.col("kind")
    # a message is blank in every run if nothing of it is left to fill, and in none if it has letters outside of its placeholders
    bare = _blank(F.regexp_replace("text_of_step", PLACEHOLDER, ""))
    filled = F.col("text_of_step").rlike(PLACEHOLDER)
    always = F.coalesce(kind == "wait", F.lit(False)) | F.coalesce(_lacking(), F.lit(False)) | F.coalesce((kind == "send_message") & _blank(F.col("text_of_step")), F.lit(False))
    before = Window.partitionBy(*SCOPE).orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
    last = lambda met: F.max(F.when(met, F.col("position"))).over(before)
    unsure = F.when((kind == "send_message") & filled & bare, F.struct("position", "text_of_step"))
    return steps.withColumns({"__all": last(always), "__contact": last(kind.isin(*OF_CONTACT)), "__talk": last(kind.isin(*SENDING)), "__unsure": F.collect_list(unsure).over(before)}).withColumn("__unsure", F.when(F.size("__unsure") > 0, F.col("__unsure")))


def _reached(talks_known: bool) -> Column:
    """Whether a run comes to a step from where it goes on: none of the stops that are marked lies between."""
    clear = lambda mark: F.coalesce(F.col(mark) < F.col("next_position"), F.lit(True))
    met = (F.col("position") >= F.col("next_position")) & clear("__all") & (F.col("contact_id").isNotNull() | clear("__contact"))
    if talks_known:
        met &= F.col("conversation_id").isNotNull() | clear("__talk")
    blank = F.exists("__unsure", lambda m: (m["position"] >= F.col("next_position")) & _blank(interpolate(m["text_of_step"], F.col("text"), F.col("vars"))))
    return met & (F.col("__unsure").isNull() | ~F.coalesce(blank, F.lit(False)))


def _decision() -> Column:
    """Whether a condition holds: a tag or a field of the contact, the text of the message, or the time of day."""
    subject, operand = F.col("subject"), F.col("operand")
    value = F.coalesce("value", F.lit(""))
    holds = F.when(subject == "tag_presence", F.array_contains("tags", operand)).when(subject == "contact_field", F.try_element_at("fields", operand) == value)
    holds = holds.when(subject == "message_content", F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(value))).when(subject == "time_of_day", within_window(F.col("at"), operand))
    return F.when(F.coalesce(holds, F.lit(False)), "yes").otherwise("no")


def _prepared(runs: DataFrame, contacts: DataFrame | None, contact_tags: DataFrame | None, conversations: DataFrame | None) -> DataFrame:
    """Runs with the fields and tags of their contact, and its conversation where the event named none."""
    missing = {"contact_id": F.col("user_id"), "conversation_id": F.lit(None).cast("long"), "vars": F.create_map().cast("map<string,string>")}
    runs = runs.withColumns({c: x for c, x in missing.items() if c not in runs.columns}).select(*RUN)
    if contacts is not None:
        named = [c for c in contacts.columns if c not in ("id", "user_id")]
        fields = F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*[F.col(c).cast("string") for c in named]))
        runs = runs.join(contacts.select(F.col("id").alias("contact_id"), fields.alias("fields")), "contact_id", "left")
    if contact_tags is not None:
        runs = runs.join(contact_tags.groupBy("contact_id").agg(F.collect_set("tag").alias("tags")), "contact_id", "left")
    if conversations is not None:
        # a contact with several conversations has none that a step could choose
        own = conversations.groupBy("user_id", "contact_id").agg(F.when(F.count("*") == 1, F.min("id")).alias("__only"))
        runs = runs.join(own, ["user_id", "contact_id"], "left").withColumn("conversation_id", F.coalesce("conversation_id", "__only")).drop("__only")
    empty = {"fields": F.lit(None).cast("map<string,string>"), "tags": F.lit(None).cast("array<string>")}
    return runs.withColumns({c: x for c, x in empty.items() if c not in runs.columns})


def execute(runs: DataFrame, steps: DataFrame, contacts: DataFrame | None = None, contact_tags: DataFrame | None = None, conversations: DataFrame | None = None, parked: DataFrame | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """runs of ``dispatch`` and a table of steps (STEP, OPTIONAL) -> one row a step that was run: RUN, the step, place, body, params, run_at, status, chosen.

    chosen is the branch that a condition opened, params are those of a template. With rows of ``parked``, their runs go on in
    the parked scope from next_position, at their run_at, and nothing else runs. Steps that form a cycle raise ValueError.
    With keep, rows have these columns and ALWAYS; each level is written, so what nobody reads need not be.
    """
    steps = steps.withColumns({c: F.expr(x) for c, x in OPTIONAL.items() if c not in steps.columns})
    n_steps, n_runs = steps.count(), runs.count()
    # all levels join the same steps: dealt and marked once, and kept by the executors until the last level is written
    marked = _marked(fixed(steps.select(*STEP, *OPTIONAL), n_steps + n_runs, *SCOPE)).persist(StorageLevel.DISK_ONLY)
    try:
        return _levels(marked, n_steps, n_runs, runs, contacts, contact_tags, conversations, parked, keep)
    finally:
        marked.unpersist()


def _levels(steps: DataFrame, n_steps: int, n_runs: int, runs: DataFrame, contacts: DataFrame | None, contact_tags: DataFrame | None, conversations: DataFrame | None, parked: DataFrame | None, keep: tuple[str, ...] | None) -> DataFrame:
    runs = _prepared(runs, contacts, contact_tags, conversations)
    if parked is None:
        # plain constants would be folded out of the join's keys, and all steps would be dealt anew
        never = F.length(F.col("automation_id").cast("string")) < 0
        scopes = runs.withColumns({"parent_id": F.when(never, 0).otherwise(-1).cast("long"), "branch": F.when(never, "-").otherwise(""), "next_position": F.lit(0), "way": F.array().cast("array<int>"), "above": F.array().cast("array<bigint>")})
    else:
        at = [F.col("run_at").alias("at")] if "run_at" in parked.columns else []
        waiting = parked.select("event_id", "automation_id", "parent_id", "branch", "next_position", *at, *[F.col(c) if c in parked.columns else F.array().cast(t).alias(c) for c, t in (("way", "array<int>"), ("above", "array<bigint>"))])
        scopes = (runs.drop("at") if at else runs).join(waiting, ["event_id", "automation_id"])
    # a template of its own run's text and variables: other kinds have none
    text = F.when(F.col("kind").isin("send_message", "create_deal"), interpolate(F.col("text_of_step"), F.col("text"), F.col("vars")))
    body = text.when(F.col("kind") == "send_webhook", F.to_json(F.struct("event_id", "automation_id", F.col("text").alias("message"))))
    later = F.timestamp_add("MILLISECOND", wait_ms(F.col("amount"), F.col("unit")), F.col("at"))
    made = {"body": body, "params": F.when(F.col("kind") == "send_template", ordered_values(F.col("variables"))), "run_at": F.when(F.col("kind") == "wait", later), "chosen": F.when(F.col("kind") == "condition", _decision()), "place": F.concat("way", F.array(F.col("position").cast("int")))}
    names = [*[c for c in scopes.columns if c not in ("next_position", "fields", "tags")], *[c for c in steps.columns if c not in scopes.columns and not c.startswith("__")], "fields", "tags", *made, "status"]
    kept = set(names) - {"fields", "tags"} if keep is None else {*ALWAYS, *keep}
    below = ("user_id", "contact_id", "conversation_id", "at", "text", "vars", "trigger", "fields", "tags")
    done, n_open = None, n_runs
    while True:
        # runs and steps are dealt alike, so that the steps stay where they are; only scopes that double the rows deal both anew
        usual, now = n_steps + n_runs, n_steps + n_open
        rows = fixed(scopes, now if now > 2 * usual else usual, *SCOPE).join(steps, list(SCOPE)).filter(_reached(conversations is not None))
        rows = rows.withColumns(made).withColumn("status", _status(conversations is not None))
        # what only the levels below a condition read is written with conditions alone
        rows = cut(rows.select(*[F.col(c) if c in kept else F.when(F.col("kind") == "condition", F.col(c)).alias(c) for c in names if c in kept or c in below]))
        done = rows if done is None else done.unionByName(rows)
        n_open, round_again = rows.agg(F.count_if(F.col("kind") == "condition"), F.count_if(F.array_contains("above", F.col("id")))).first()
        if round_again:
            raise ValueError("the steps of a rule form a cycle")
        if not n_open:
            return done if keep is None else done.select(*[c for c in names if c in kept])
        opens = {"parent_id": F.col("id"), "branch": F.col("chosen"), "next_position": F.lit(0), "way": F.col("place"), "above": F.concat("above", F.array("id"))}
        scopes = rows.filter("kind = 'condition'").select(*RUN, "fields", "tags", *[c.alias(n) for n, c in opens.items()])


def outbox(executed: DataFrame) -> DataFrame:
    """What is to be sent: messages and webhook bodies of steps that succeeded."""
    return executed.filter("kind IN ('send_message', 'send_webhook') AND status = 'success'").select("event_id", F.col("id").alias("step_id"), "kind", "body")


def template_outbox(executed: DataFrame) -> DataFrame:
    """Templates to be sent, with their positional parameters, and the conversation they go into."""
    return executed.filter("kind = 'send_template' AND status = 'success'").select("event_id", F.col("id").alias("step_id"), "conversation_id", "template", "params")


def parked(executed: DataFrame) -> DataFrame:
    """Where a waiting run goes on, and when."""
    return executed.filter("status = 'partial'").select("event_id", "automation_id", "parent_id", "branch", (F.col("position") + 1).alias("next_position"), "run_at", "way", "above")


def run_log(executed: DataFrame) -> DataFrame:
    """One row a run: its steps in order and its final status (failed before partial before success)."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("parent_id", "branch", "position", "id", "status"))), lambda s: F.concat_ws(":", s["id"], s["status"]))
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status") == "partial"), "partial").otherwise("success")
    return executed.groupBy("event_id", "automation_id").agg(status.alias("status"), F.count("*").alias("n_steps"), F.array_join(order, ",").alias("steps"))


def automation_logs(runs: DataFrame, executed: DataFrame) -> DataFrame:
    """One row a run, also of those without a step, as the engine leaves it: status, n_steps and steps.

    Scopes append their steps when they end, so those of a branch come before those of the scope that opened it. The
    outermost scope alone decides the status, so a failure or a wait inside a branch does not show in it.
    """
    last = F.array_append("way", F.lit((1 << 31) - 1))
    log = F.array_sort(F.collect_list(F.struct(last.alias("scope"), "position", "id", "kind", "status")))
    steps = F.transform(log, lambda s: F.concat_ws(":", s["id"], s["kind"], F.when(s["status"] == "failed", "failed").otherwise("success")))
    outer = lambda status: F.bool_or((F.col("parent_id") == -1) & (F.col("status") == status))
    found = executed.groupBy("event_id", "automation_id").agg(F.when(outer("failed"), "failed").when(outer("partial"), "partial").otherwise("success").alias("status"), F.count("*").alias("n_steps"), F.array_join(steps, ",").alias("steps"))
    rows = runs.select("event_id", "automation_id").join(found, ["event_id", "automation_id"], "left")
    return rows.select("event_id", "automation_id", F.coalesce("status", F.lit("success")).alias("status"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("steps", F.lit("")).alias("steps"))


def added_tags(executed: DataFrame, existing: DataFrame) -> DataFrame:
    """(contact_id, tag) that add_tag steps bring and that are not there yet."""
    wanted = executed.filter("kind = 'add_tag' AND status = 'success'").select("contact_id", "tag").distinct()
    return wanted.join(existing, ["contact_id", "tag"], "left_anti")
