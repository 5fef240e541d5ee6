"""Streams of change feeds against the batches of the same rows: replays, restarts, late rows, provisional values; and sources that are read line by line or page by page."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmur.operators import messaging
from murmur.plans import feeds as plans
from murmur.sources import views
from murmur.sources.contact_lines import read_contact_lines
from murmur.sources.pages import follow_pages, only_keys, poll
from murmur.streaming import feeds

START = datetime(2024, 5, 1)


def put(frame, path, number):
    """A file of a stream; later ones have later names and are read later."""
    frame.coalesce(1).write.parquet(f"{path}/part={number}")


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def run(frame, name, tmp_path, mode, spark):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def rows_of(frame, columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def test_merged_feed_as_a_stream(spark, sf, tmp_path):
    changes = plans.message_changes(spark, sf)
    # in no order at all, and every fourth row twice
    mixed = changes.unionByName(changes.filter("seq % 4 = 0")).withColumn("f", F.pmod(F.xxhash64("seq", F.rand(1)), F.lit(4)))
    for i in range(4):
        put(mixed.filter(F.col("f") == i).drop("f"), str(tmp_path), i)
    columns = ["status", "body", "conversation_id"]
    got = run(feeds.merged_feed(source(spark, tmp_path, changes.schema), "id", columns), "merged_out", tmp_path, "complete", spark)
    assert rows_of(got, ["id", *columns]) == rows_of(feeds.merged_feed(changes, "id", columns), ["id", *columns]) != []


def test_merged_feed_equals_a_fold(spark):
    rng = random.Random(6)
    events = [(f"{rng.choice(('m', 'temp-'))}{rng.randrange(12)}", rng.choice(("INSERT", "UPDATE", "UPDATE", "DELETE")), START + timedelta(minutes=rng.randrange(40)), i, rng.sample(["a", "b"], rng.randint(0, 2)), rng.choice((None, f"a{i}")), f"b{i}") for i in range(300)]
    want = {}
    for key, op, _, _, changed, a, b in sorted(events, key=lambda e: e[2:4]):
        if key.startswith("temp-"):
            continue
        if op == "INSERT":
            want.setdefault(key, {"a": a, "b": b})
        elif op == "UPDATE" and key in want:
            want[key] |= {c: v for c, v in (("a", a), ("b", b)) if c in changed}
    frame = spark.createDataFrame(events, "id string, op string, at timestamp_ntz, seq long, changed array<string>, a string, b string")
    assert rows_of(feeds.merged_feed(frame, "id", ["a", "b"]), ["id", "a", "b"]) == sorted((k, v["a"], v["b"]) for k, v in want.items())


def test_a_stream_that_stops_in_mid_batch_writes_every_row_once(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i % 400, START + timedelta(minutes=i // 4 + rng.randrange(-30, 30)), f"t{i % 400}") for i in range(1200)]  # an id comes three times, within the delay or not at all again
    rows = [(i, at if i < 400 else rows[i % 400][1] + timedelta(minutes=rng.randrange(20)), t) for i, (_, at, t) in enumerate(rows)]
    frame = spark.createDataFrame([(f"m{i % 400}", at, t) for i, at, t in rows], "id string, at timestamp, text string")
    parts = frame.withColumn("f", F.floor(F.expr("unix_seconds(at)") / 1500)).cache()
    numbers = sorted(r[0] for r in parts.select("f").distinct().collect())
    for k, f in enumerate(numbers):
        put(parts.filter(F.col("f") == f).drop("f"), str(tmp_path / "in"), f"{k:03}")
    out, failed = str(tmp_path / "out"), []

    def write(batch, number):
        feeds.write_once(out)(batch, number)
        if number in (1, 3) and number not in failed:
            failed.append(number)
            raise RuntimeError("stopped after the write")

    for _ in range(3):
        stream = feeds.deduplicated(source(spark, tmp_path / "in", frame.schema), ["id"], "at", "3 hours")
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            continue
    got = spark.read.parquet(out)
    assert failed == [1, 3] and got.count() == got.select("id").distinct().count() == frame.select("id").distinct().count() == 400


def test_optimistic_rows_as_a_stream(spark, tmp_path):
    rng = random.Random(12)
    events = []
    for i in range(400):
        at = START + timedelta(minutes=rng.randrange(2000))
        key = (rng.randrange(15), rng.randrange(3))
        value = rng.choice(("heart", "", "smile"))
        events.append((*key, f"r{i}", "ask", value, at, i))
        answer = rng.choice(("confirm", "reject", None, None))
        if answer:
            events.append((*key, f"r{i}", answer, value, at + timedelta(minutes=rng.randrange(1, 30)), 1000 + i))
    # moves the watermark on behind all of them
    end = START + timedelta(minutes=2400)
    schema = "message_id long, actor_id long, request string, kind string, value string, at timestamp, seq long"
    events.sort(key=lambda e: e[5])
    for k in range(0, len(events), 150):
        put(spark.createDataFrame(events[k : k + 150], schema), str(tmp_path / "in"), f"{k:05}")
    for k, minutes in enumerate((0, 1)):
        put(spark.createDataFrame([(-1, -1, "end", "confirm", "", end + timedelta(minutes=minutes), 0)], schema), str(tmp_path / "in"), f"9999{k}")
    for patience in (300, 2000):
        got = run(feeds.stream_optimistic(source(spark, tmp_path / "in", spark.createDataFrame([], schema).schema), patience * 60), f"optimistic_{patience}", tmp_path, "update", spark)
        last = {}
        for r in got.collect():  # rows of the memory sink come in the order of the batches
            last[r["message_id"], r["actor_id"]] = (r["shown"], r["pending"])
        clock = F.lit(end - timedelta(minutes=60)).cast("timestamp")
        want = {(r["message_id"], r["actor_id"]): (r["shown"], r["pending"]) for r in feeds.optimistic(spark.createDataFrame(events, schema), ["message_id", "actor_id"], clock, f"{patience} MINUTES").collect()}
        last.pop((-1, -1))
        assert last == want and {p for _, p in want.values()} == ({False} if patience == 300 else {False, True})


def test_unread_counts_with_bounded_state(spark, sf, tmp_path):
    messages = views.messages(spark, sf).select("conversation_id", "sender_type", "created_at", "id")
    # one conversation that nobody answers
    silent = messages.select(F.lit(-5).cast("long").alias("conversation_id"), F.lit("customer").alias("sender_type"), "created_at", "id")
    both = messages.unionByName(silent).withColumn("day", F.to_date("created_at")).cache()
    days = sorted(r[0] for r in both.select("day").distinct().collect())
    for k, day in enumerate(days):
        put(both.filter(F.col("day") == F.lit(day)).drop("day"), str(tmp_path), f"{k:03}")
    got = run(feeds.stream_unread_bounded(source(spark, tmp_path, messages.schema), "1 hour"), "bounded_out", tmp_path, "update", spark).collect()
    last = {r["conversation_id"]: r["unread_count"] for r in got}
    want = {r["conversation_id"]: r["unread_count"] for r in messaging.conversations(both.drop("day").withColumn("content_text", F.lit(""))).collect()}
    assert last == want
    # a day's rows at most are held, though the silent conversation waits for all of them
    assert max(r["kept"] for r in got if r["conversation_id"] == -5) < want[-5] / 4


# --- sources ---


def parsed(content):
    """A plain reading of an import: a quote switches, quotes of both kinds go."""
    lines = content.strip().split("\n")
    if len(lines) < 2:
        return []
    header = [h.strip().lower().replace('"', "").replace("'", "") for h in lines[0].split(",")]
    if "phone" not in header:
        return []
    out = []
    for line in lines[1:]:
        line = line.strip()
        cells, cell, inside = [], "", False
        for c in line:
            if c == '"':
                inside = not inside
            elif c == "," and not inside:
                cells.append(cell.strip())
                cell = ""
            else:
                cell += c
        cells.append(cell.strip())
        get = lambda name: (cells[header.index(name)].replace("'", "").strip() or None) if name in header and header.index(name) < len(cells) else None
        if line and get("phone"):
            out.append((get("phone"), get("name"), get("email"), get("company")))
    return out


def test_import_lines_equal_a_plain_reading(spark, tmp_path):
    rng = random.Random(21)
    bits = ['"', "'", ",", ",", " ", "a", "Bé", "+1 2", '""', "\t", "\\"]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(500)] + ["", "   ", '"', ",,,", '"' * 4001 + ",x", "a," * 3000]
    for k, header in enumerate((' Name,"PHONE",Email, company', "phone,phone,name", "'phone'", '"phone, x",name', "name,email", "PHONE ,`x`,a.b")):
        content = "\n\n" + "\n".join([header, *lines]) + "\n"
        (tmp_path / f"{k}.csv").write_text(content)
        assert rows_of(read_contact_lines(spark, str(tmp_path / f"{k}.csv")), ["phone", "name", "email", "company"]) == sorted(parsed(content), key=repr)
    (tmp_path / "short.csv").write_text("phone\n")
    (tmp_path / "none.csv").write_text("")
    assert read_contact_lines(spark, str(tmp_path / "short.csv")).count() == read_contact_lines(spark, str(tmp_path / "none.csv")).count() == 0


def test_pages_that_end_lead_back_or_are_lost(spark):
    body = lambda items, after: f'{{"data": {items}, "paging": {{"next": {after}}}}}'.replace("'", '"')
    pages = [("a", body(["1"], '"b"')), ("b", body(["2"], "null")), ("c", body([], '"c"')), ("d", body(["4"], '"gone"')), ("e", "no json"), ("f", '{"data": ["6"]}'), ("g", body(["7"], '""'))]
    starts = spark.createDataFrame([(i, u) for i, u in enumerate("acdefgz")], "list_id long, url string")
    rows, lists = follow_pages(starts, spark.createDataFrame(pages, "url string, body string"), most=3)
    assert sorted((r["list_id"], r["page"], r["url"]) for r in rows.collect() if r["b"]["data"]) == [(0, 1, "a"), (0, 2, "b"), (2, 1, "d"), (4, 1, "f"), (5, 1, "g")]
    assert {r["list_id"]: (r["pages"], r["truncated"], r["broken"]) for r in lists.collect()}[1] == (3, True, False)
    assert {r["list_id"] for r in lists.filter("broken").collect()} >= {2, 6}


def test_polling_ends_when_nothing_is_pending(spark, tmp_path):
    path, readings = str(tmp_path / "t"), []
    spark.createDataFrame([(1, "sending"), (2, "sent")], "id long, status string").write.parquet(path)

    def seen(rows, n):
        readings.append(sorted(r["status"] for r in rows.collect()))
        if n == 1:
            spark.createDataFrame([(1, "sent"), (2, "sent")], "id long, status string").write.mode("overwrite").parquet(path)

    assert poll(lambda: spark.read.parquet(path), F.col("status") == "sending", seen, seconds=0.01, most=10) == 3
    assert readings == [["sending", "sent"], ["sending", "sent"], ["sent", "sent"]]


def test_a_feed_of_one_key(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 4).alias("k"), "id")
    put(rows, str(tmp_path), 0)
    got = run(only_keys(source(spark, tmp_path, rows.schema), "k", value=2), "one_key", tmp_path, "append", spark)
    assert rows_of(got, ["k", "id"]) == rows_of(rows.filter("k = 2"), ["k", "id"])
    keys = spark.createDataFrame([(1,), (3,), (3,)], "key long")
    assert only_keys(rows, "k", keys).count() == 20


def test_pages_are_parsed_once(spark):
    """A page is read once, however many rounds follow the lists: each reading would draw other items."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    n = 6
    pages = spark.createDataFrame([(f"u{i}", f'{{"data": ["{i}"], "paging": {{"next": "{"u" + str(i + 1) if i < n - 1 else ""}"}}}}') for i in range(n)], "url string, body string")
    rows, lists = follow_pages(spark.createDataFrame([(1, "u0")], "list_id int, url string"), pages.mapInArrow(counted, pages.schema))
    assert [r["b"]["data"] for r in rows.orderBy("page").collect()] == [[str(i)] for i in range(n)] and tuple(lists.first()) == (1, n, False, False)
    assert read.value == n
