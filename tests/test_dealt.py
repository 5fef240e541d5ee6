"""Joins of rules' steps are dealt by the number of rows, and where a scope stops is found without gathering it."""

from datetime import datetime

from pyspark.sql import functions as F

from murmur.operators import lineage, rules, runs

STEP = "id long, automation_id long, parent_id long, branch string, position int, kind string, text_of_step string, tag string, amount int, unit string, field string, stage string"
T = datetime(2024, 1, 1)


class _Conf(dict):
    """The session's settings as a dict, so that a test's changes are undone."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __setitem__(self, key, value):
        self.conf.set(key, value)

    def __delitem__(self, key):
        self.conf.unset(key)

    def pop(self, key, default=None):
        self.conf.unset(key)


def _step(i, rule, position, kind, text=None, parent=-1, branch="", tag="t"):
    return (i, rule, parent, branch, position, kind, text, tag, 1, "hours", "name", "s")


def test_paths_are_dealt_by_the_number_of_steps(spark, monkeypatch):
    rows = [_step(10 * r + i, r, i % 2, "condition" if i == 0 else "add_tag", parent=-1 if i < 2 else 10 * r, branch="" if i < 2 else "yes") for r in range(20) for i in range(4)]
    steps = spark.createDataFrame(rows, STEP)
    want = sorted(map(tuple, rules.tree_paths(steps, 2).collect()), key=str)
    few = rules.tree_paths(steps, 2).rdd.getNumPartitions()
    monkeypatch.setattr(lineage, "TASK_ROWS", 5)
    many = rules.tree_paths(steps, 2)
    assert many.rdd.getNumPartitions() > few and many.rdd.getNumPartitions() >= 16
    assert sorted(map(tuple, many.collect()), key=str) == want and len(want) == 80


def _runs(spark, texts):
    rows = [(i, 1, 1, None if i % 3 == 2 else 7, None if i % 2 else 5, T, t, {"v": "x"} if i % 2 else None, "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "event_id long, automation_id long, user_id long, contact_id long, conversation_id long, at timestamp_ntz, text string, vars map<string,string>, trigger string")


def _fold(run, steps, talks, first=0):
    """What a scope runs, one step after the other; steps of one position run together."""
    out, stop = [], None
    for s in sorted(steps, key=lambda s: (s[4], s[0])):
        if s[4] < first or (stop is not None and s[4] > stop):
            continue
        body = (s[6] or "").replace("{{ message.text }}", run["text"] or "").replace("{{vars.v}}", (run["vars"] or {}).get("v", ""))
        bad = s[5] in runs.OF_CONTACT and run["contact_id"] is None or s[5] == "send_message" and body.strip(" ") == "" or s[5] == "add_tag" and not s[7] or talks and s[5] == "send_message" and run["conversation_id"] is None
        if bad or s[5] == "wait":
            stop = s[4]
        out.append((run["event_id"], s[0], "failed" if bad else "partial" if s[5] == "wait" else "success"))
    return out


def test_scopes_stop_where_a_fold_stops_and_levels_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_ROWS", 1)
    monkeypatch.setitem(_Conf(spark), "spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setitem(_Conf(spark), "spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    texts = ["hi", "", " ", None, "yo", "  x", "", "", "a", None]
    scopes = [
        [_step(1, 1, 0, "close_conversation"), _step(2, 1, 1, "send_message", " {{ message.text }} "), _step(3, 1, 2, "add_tag"), _step(4, 1, 2, "send_message", "{{vars.v}}"), _step(5, 1, 3, "wait"), _step(6, 1, 4, "add_tag", tag=""), _step(7, 1, 5, "create_deal", "d")],
        [_step(1, 1, 0, "create_deal", "d"), _step(2, 1, 1, "send_message", "{{vars.v}}{{ message.text }}"), _step(3, 1, 3, "create_deal", " "), _step(4, 1, 4, "send_message", "  "), _step(5, 1, 4, "wait"), _step(6, 1, 5, "create_deal", "d"), _step(7, 1, 6, "send_message", "{{ message.text }}"), _step(8, 1, 7, "create_deal", "d")],
    ]
    r = _runs(spark, texts)
    for scope in scopes:
        s = spark.createDataFrame(scope, STEP)
        none = spark.createDataFrame([], "id long, user_id long, contact_id long")
        for talks in (None, none):
            got = runs.execute(r, s, conversations=talks, keep=("status",))
            assert set(got.columns) == {*runs.ALWAYS, "status"} and got.rdd.getNumPartitions() > 4
            assert sorted(map(tuple, got.select("event_id", "id", "status").collect())) == sorted(x for run in r.collect() for x in _fold(run, scope, talks is not None))
        # a run that goes on behind a stop meets the next one
        on = r.select("event_id", "automation_id", F.lit(-1).cast("long").alias("parent_id"), F.lit("").alias("branch"), F.lit(4).alias("next_position"))
        got = runs.execute(r, s, parked=on, keep=("status",)).select("event_id", "id", "status")
        assert sorted(map(tuple, got.collect())) == sorted(x for run in r.collect() for x in _fold(run, scope, False, 4))


def _over_kept(plan):
    """Whether the steps that are kept are dealt anew in a plan: an exchange right above their scan."""
    lines = plan.splitlines()
    for at in (i for i, line in enumerate(lines) if "InMemoryTableScan" in line):
        while at > 0 and any(w in lines[at] for w in ("InMemoryTableScan", "TableCacheQueryStage", "Filter", "Project", "Sort ", "AQEShuffleRead", "ShuffleQueryStage", "Exchange")):
            if "Exchange" in lines[at]:
                return True
            at -= 1
    return False


def test_kept_steps_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(lineage, "LEAST_ROWS", 5, raising=False)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setitem(_Conf(spark), "spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setitem(_Conf(spark), "spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    steps = [_step(1, 1, 0, "condition", "hi"), _step(2, 1, 0, "condition", "hi", 1, "yes"), _step(3, 1, 0, "add_tag", parent=2, branch="no"), _step(4, 1, 1, "add_tag", parent=1, branch="no")]
    plans, cut = [], runs.cut

    def noted(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return cut(rows)

    monkeypatch.setattr(runs, "cut", noted)
    # more partitions than cores, which Spark coalesces
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = runs.execute(_runs(spark, ["hi", "yo"] * 10), spark.createDataFrame(steps, STEP), keep=("status",))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(plans) > 1 and all("InMemoryTableScan" in p for p in plans)
    assert not any(_over_kept(p) for p in plans[1:])
    # 4 steps and 20 runs, 5 rows a task: what levels join is dealt by its rows, not to 40 partitions that are coalesced
    assert got.rdd.getNumPartitions() == 5 * len(plans) and got.groupBy("id").count().count() >= 3
