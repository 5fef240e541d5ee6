"""Scalar functions, small fixtures and streaming twins."""

import random

import pytest
from pyspark.sql import functions as F

from murmur.functions import dates, numbers, phone, security, text
from murmur.operators import audience, contacts, messaging, rules, status
from murmur.plans.queries import QUERIES
from murmur.sources import views
from murmur.sources.csv_contacts import read_contacts, write_csv
from murmur.streaming import folds


def values(spark, inputs, f, kind="string"):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_phones(spark):
    assert values(spark, ["+370 600 00001", "+1 (415) 555-1212", "", None], phone.digits) == ["37060000001", "14155551212", "", ""]
    good = ["+1234567", "+123456789012345"]
    bad = ["+0123456", "0044700000000", "+123456", "+1234567890123456", "+1-415-555-1212", "+1 4155551212", "abc12345678", ""]
    assert values(spark, good + bad, phone.is_e164) == [True] * 2 + [False] * 8
    found = values(spark, ["37060000001", "370060000001", "1", ""], phone.variants)
    assert found[0][0] == "37060000001" and {"307060000001", "370060000001"} <= set(found[0]) and len(set(found[0])) == len(found[0])
    assert "37060000001" in found[1] and found[2:] == [["1"], []]
    keys = values(spark, ["370060000001", "37060000001", "+37060000002", "1234567", "9991234567", "(415) 555-1212", "+1 415-555-1212"], phone.match_key)
    assert keys[0] == keys[1] != keys[2] and keys[3] != keys[4] and keys[5] == keys[6]
    assert values(spark, ["(#131030) x", "NOT IN ALLOWED LIST", "(#100) Invalid parameter", ""], phone.is_not_allowed_error) == [True, True, False, False]


def test_texts(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("y")).first()["y"]
    assert get(text.render(F.lit("a {{1}} {{2}} {{9}}"), F.array(F.lit("{{2}}"), F.lit("")))) == "a {{2}}  {{9}}"
    assert get(text.render(F.lit("{{1}}-{{2}}"), F.array(F.lit("x"), F.lit(" ")), keep_blank=False)) == "x-{{2}}"
    assert get(text.interpolate(F.lit("{{ message.text }}/{{vars.a}}/{{other}}!"), F.lit("hi"), F.create_map(F.lit("a"), F.lit("1")))) == "hi/1/!"
    assert get(text.placeholders(F.lit("{{10}} {{2}} {{2}}"))) == [2, 10]
    assert get(text.initials(F.lit(" ada  lovelace king"))) == "AL" and get(text.slug(F.lit("My File (1)"))) == "my-file-1-"
    assert get(text.csv_field(F.lit('a"b'))) == '"a""b"' and get(text.preview(F.lit("image"), F.lit(""))) == "[Image]"


def test_dates_and_numbers(spark):
    day = [str(r["day"]) for r in dates.day_spine(spark, "2026-05-02", 4).orderBy("day").collect()]
    assert day == ["2026-04-29", "2026-04-30", "2026-05-01", "2026-05-02"]
    monday = values(spark, ["2026-05-18", "2026-05-19", "2026-05-23", "2026-05-24"], lambda c: dates.monday_index(c.cast("date")))
    assert monday == [0, 1, 5, 6]
    assert values(spark, [-2.5, 2.5], numbers.half_up, "double") == [-2, 3]
    assert values(spark, [0.0, 3.0, 11.0, 100.0], numbers.nice_ceil, "double") == [4, 5, 20, 100]
    assert values(spark, [5.0, 130.0, 0.5], dates.duration, "double") == ["5m", "2.2h", "30s"]
    assert values(spark, ["2026-01-01 23:30:00", "2026-01-01 06:30:00"], lambda c: dates.within_day(c.cast("timestamp"), "22:00-06:30")) == [True, False]


def test_tokens_and_signatures(spark):
    key = "00" * 32
    frame = spark.createDataFrame([("secret",), ("",), ("žąsis",)], "x string").withColumn("t", security.encrypt_token(F.col("x"), key))
    frame = spark.createDataFrame(frame.collect(), frame.schema)
    got = frame.select("x", security.decrypt_token(F.col("t"), key).alias("y"), security.decrypt_token(F.concat(F.lit("0"), F.substring("t", 2, 999)), key).alias("z")).collect()
    assert all(r["x"] == r["y"] for r in got)
    import hashlib
    import hmac

    sign = "sha256=" + hmac.new(b"app-secret", b"body", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("body", sign), ("body2", sign), ("body", None), ("body", sign[7:])], "b string, h string")
    assert [r[0] for r in rows.select(security.signature_holds(F.col("b"), F.col("h"), "app-secret")).collect()] == [True, False, False, False]
    assert not any(r[0] for r in rows.select(security.signature_holds(F.col("b"), F.col("h"), "")).collect())


def walk(rows):
    pairs, waiting = [], None
    for at, sender in rows:
        if sender == "customer":
            waiting = waiting if waiting is not None else at
        elif waiting is not None:
            pairs.append((waiting, at))
            waiting = None
    return pairs


def test_pairs_equal_a_walk(spark, sf):
    by = {}
    for r in views.messages(spark, sf).orderBy("created_at", "id").collect():
        by.setdefault(r["conversation_id"], []).append((r["created_at"], r["sender_type"]))
    want = sorted((c, *p) for c, rows in by.items() for p in walk(rows))
    got = sorted((r["conversation_id"], r["asked_at"], r["replied_at"]) for r in messaging.response_pairs(views.messages(spark, sf)).collect())
    assert got == want and len(want) > 20


def test_ladder_equals_the_fold(spark):
    rng = random.Random(4)
    rows = [(k, i, i, rng.choice(["sent", "delivered", "read", "replied", "failed", "odd"])) for k in range(300) for i in range(rng.randint(1, 6))]
    got = {r["key"]: r["status"] for r in status.ladder(spark.createDataFrame(rows, "key long, seq long, at long, status string")).collect()}
    want = {}
    for k, _, _, s in rows:
        want[k] = status.fold_status(want.get(k, ("pending", False)), s)
    assert got == {k: v[0] for k, v in want.items()}


def limited(rows, limit, window):
    state, out = {}, {}
    for k, t, seq in sorted(rows):
        opened, used = state.get(k, (None, 0))
        if opened is None or t - opened >= window:
            opened, used = t, 0
        state[k] = (opened, used + 1)
        out[seq] = used + 1 <= limit
    return out


def test_limiter_equals_the_fold(spark, sf):
    rows = [(r["user_id"], r["ts"].timestamp() * 1000, r["event_id"]) for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    got = {r["seq"]: r["allowed"] for r in QUERIES["rate_limiter"](spark, sf).collect()}
    assert got == limited(rows, 3, 6 * 3600 * 1000) and not all(got.values())


def test_audience_cases(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    fields = spark.createDataFrame([(1, "city", "x"), (2, "city", "100% y")], "contact_id long, field string, value string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(audience.by_field(people, fields, "city", "is_not", "x")) == [2]  # contact 3 has no such field
    assert ids(audience.by_field(people, fields, "city", "contains", "%")) == [1, 2]  # a wildcard


def test_table_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert rows(contacts.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(contacts.upsert(old, new, ["k"], replace=False)) == [(1, "a"), (2, "b"), (3, "C")]
    assert sorted(r["k"] for r in contacts.restricted_delete(old, new, "k", "k").collect()) == [1]
    assert rules.keyword_matches(F.lit("x"), []) is not None


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Name,PHONE,extra\n"O\'Neil, Bo",+1 555,x\nAnn,,y\n\n"Q",\'777\',z\n')
    got = sorted((r["phone"], r["name"], r["email"]) for r in read_contacts(spark, str(tmp_path / "c.csv")).collect())
    assert got == [("+1 555", "ONeil, Bo", None), ("777", "Q", None)]
    (tmp_path / "d.csv").write_text("name\nx\n")
    assert read_contacts(spark, str(tmp_path / "d.csv")).count() == 0
    write_csv(spark.createDataFrame([('a"b', None, 1)], "x string, y string, z int").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part-*")).read_text() == '"x","y","z"\n"a""b","","1"\n'


def run_stream(spark, frame, tmp_path, name, twin, mode):
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = twin(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batches(spark, sf, tmp_path):
    events = views.status_events(spark, sf)
    got = {r["key"]: r["status"] for r in run_stream(spark, events, tmp_path / "a", "ladder_out", folds.stream_ladder, "update").collect()}
    assert got == {r["key"]: r["status"] for r in status.ladder(events).collect()}
    calls = views.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    out = run_stream(spark, calls, tmp_path / "b", "limit_out", lambda s: folds.stream_limiter(s, 3, 6 * 3600 * 1000), "append")
    assert {r["seq"]: r["allowed"] for r in out.collect()} == {r["seq"]: r["allowed"] for r in QUERIES["rate_limiter"](spark, sf).collect()}


@pytest.mark.parametrize("case", ["counters", "latest", "unread"])
def test_more_streams(spark, sf, tmp_path, case):
    if case == "counters":
        changes = views.recipients(spark, sf).select("broadcast_id", F.lit("pending").alias("old"), F.col("status").alias("new"))
        got = run_stream(spark, changes, tmp_path, "counter_out", folds.stream_counters, "complete")
        want = status.counter_deltas(changes)
    elif case == "latest":
        rows = views.messages(spark, sf).select("conversation_id", "id", "created_at", "sender_type")
        got = run_stream(spark, rows, tmp_path, "latest_out", lambda s: folds.stream_latest(s, ["conversation_id"], ["created_at", "id"]), "complete")
        want = contacts.latest_per_key(rows, ["conversation_id"], [F.desc("created_at"), F.desc("id")])
    else:
        got = run_stream(spark, views.messages(spark, sf), tmp_path, "unread_out", folds.stream_unread, "update")
        want = messaging.conversations(views.messages(spark, sf)).select("conversation_id", "unread_count")
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


@pytest.mark.parametrize("case", ["feed", "previews", "reactions"])
def test_feeds(spark, sf, tmp_path, case):
    e = views.table(spark, sf, "events")
    if case == "feed":
        name = F.concat(F.when(F.col("event_id") % 9 == 0, "temp-").otherwise("m"), (F.col("event_id") % 50).cast("string"))
        feed = e.select(name.alias("id"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("op"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
        got = run_stream(spark, feed, tmp_path, "feed_out", folds.stream_message_feed, "complete")
        want = contacts.latest_per_key(feed.filter("op != 'DELETE' AND id NOT LIKE 'temp-%'"), ["id"], [F.desc("at"), F.desc("seq")])
    elif case == "previews":
        rows = views.messages(spark, sf)
        got = run_stream(spark, rows, tmp_path, "preview_out", lambda s: folds.stream_previews(s, 7), "complete")
        want = folds.stream_previews(rows, 7)
    else:
        emoji = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
        rows = e.select(F.floor(F.col("event_id") / 5).alias("message_id"), (F.col("user_id") % 4).alias("actor_id"), emoji.alias("emoji"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
        known = spark.range(0, 150).toDF("id")
        got = run_stream(spark, rows, tmp_path, "reaction_out", lambda s: folds.stream_reactions(s, known), "complete")
        want = messaging.latest_reactions(rows.filter("message_id < 150"))
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())) != []


def test_changes_with_nulls_and_empty_tables(spark):
    from murmur.operators import changes

    rows = spark.createDataFrame([(1, "a", 5), (2, None, None), (None, "c", 7)], "id int, x string, n int")
    new = spark.createDataFrame([(1, None), (2, "z"), (9, "q")], "id int, x string")
    order = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    assert order(changes.update_by_key(rows, new, ["id"])) == order(spark.createDataFrame([(1, None, 5), (2, "z", None), (None, "c", 7)], rows.schema))
    assert order(changes.update_by_key(rows, new.limit(0), ["id"])) == order(rows)
    assert changes.replace_children(rows, rows, rows.limit(0), "id").collect() == [(None, "c", 7)]
    state = spark.createDataFrame([(1, "pending"), (2, "running")], "id int, status string")
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    once = changes.claim(state, ids, "id")
    assert once.collect() == [(1, "running")] and changes.claim(once, ids, "id").count() == 0
