"""Rule runs, their effects, step trees and sends against plain walks over the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmur.functions import dates, text
from murmur.operators import effects, rules, runs, sends, trees

START = datetime(2024, 3, 1, 7, 0)
KINDS = ("send_message", "send_template", "add_tag", "remove_tag", "assign_conversation", "update_contact_field", "create_deal", "send_webhook", "close_conversation", "wait")
STEPS = "id long, automation_id long, parent_id long, branch string, position int, kind string, text_of_step string, tag string, amount int, unit string, field string, stage string, subject string, operand string, value string, template string, variables map<string,string>, agent string, mode string, url string, deal_value decimal(12,2)"
COLUMNS = [c.split()[0] for c in STEPS.replace("map<string,string>", "map").replace("decimal(12,2)", "decimal").split(", ")]


def some_steps(rng, automations, depth):
    """Random trees that surely reach a depth."""
    out, number = [], iter(range(1, 100_000))

    def scope(rule, parent, branch, left):
        n = rng.randint(1, 3)
        deep = rng.randrange(n) if left else -1
        for position in range(n):
            step = dict.fromkeys(COLUMNS) | dict(id=next(number), automation_id=rule, parent_id=parent, branch=branch, position=position)
            if position == deep or left and rng.random() < 0.1:
                subject = rng.choice(("tag_presence", "contact_field", "message_content", "time_of_day", "moon"))
                operand, value = {"tag_presence": (rng.choice("abc"), None), "contact_field": (rng.choice(("name", "email", "age")), rng.choice(("n1", "n2", None))), "message_content": (None, rng.choice(("HI", "x", None))), "time_of_day": (rng.choice(("08:00-20:00", "22:00-09:30", "noon", "9-x")), None), "moon": ("full", None)}[subject]
                out.append(step | dict(kind="condition", subject=subject, operand=operand, value=value))
                for b in ("yes", "no"):
                    scope(rule, step["id"], b, left - 1)
            else:
                kind = rng.choice(KINDS + ("shrug",))
                out.append(step | dict(kind=kind, text_of_step=rng.choice(("say {{message.text}} {{vars.who}}{{ no.pe }}{{a b}}", " ", "plain")), tag=rng.choice(("a", "b", "c", None)), amount=rng.randint(0, 3), unit=rng.choice(("hours", "days", "weeks")), field=rng.choice(("name", "email", "company", "phone")), stage=rng.choice(("s1", None)), value=rng.choice(("v1", "v2", None)), template=rng.choice(("t", "", None)), variables=rng.choice(({"10": "x", "2": "y", "b": None}, None)), agent=rng.choice(("ann", "", None)), mode=rng.choice(("specific", "round_robin")), url=rng.choice(("https://x.example/", None))))

    for rule in automations:
        scope(rule, -1, "", depth)
    return out


def interpolated(body, run):
    import re

    def put(m):
        space, _, own = m[1].partition(".")
        own = own.split(".")[0]
        return (run["text"] or "") if (space, own) == ("message", "text") else ((run["vars"] or {}).get(own) or "") if space == "vars" else ""

    return re.sub(r"\{\{\s*([A-Za-z0-9_.]+)\s*\}\}", put, body)


def holds(step, run, people, tags):
    person = people.get(run["contact_id"])
    if step["subject"] == "tag_presence":
        return (run["contact_id"], step["operand"]) in tags
    if step["subject"] == "contact_field":
        v = person and person.get(step["operand"])
        return v is not None and v == (step["value"] or "")
    if step["subject"] == "message_content":
        return (step["value"] or "").lower() in (run["text"] or "").lower()
    if step["subject"] == "time_of_day":
        begin, _, end = step["operand"].partition("-")
        if not begin or not end:
            return False
        number = lambda x: int(x) if x.isdigit() else 0
        minutes = lambda x: number(x.split(":")[0]) * 60 + number((x.split(":") + ["0"])[1])
        now, f, t = run["at"].hour * 60 + run["at"].minute, minutes(begin), minutes(end)
        return f <= now < t if f <= t else now >= f or now < t
    return False


def walk(steps, run, people, tags, talks, parent=-1, branch="", way=()):
    """[(place, step, status, body, chosen)] in the order of running."""
    out = []
    for s in sorted((s for s in steps if (s["automation_id"], s["parent_id"], s["branch"]) == (run["automation_id"], parent, branch)), key=lambda s: s["position"]):
        place, k = (*way, s["position"]), s["kind"]
        if k == "condition":
            chosen = "yes" if holds(s, run, people, tags) else "no"
            out.append((place, s, "success", None, chosen))
            out += walk(steps, run, people, tags, talks, s["id"], chosen, place)
            continue
        body = interpolated(s["text_of_step"], run) if k in ("send_message", "create_deal") else None
        own = [t["id"] for t in talks if (t["user_id"], t["contact_id"]) == (run["user_id"], run["contact_id"])]
        talk = run["conversation_id"] or (own[0] if len(own) == 1 else None)
        status = "success"
        if k in runs.OF_CONTACT and run["contact_id"] is None or k in runs.SENDING and talk is None or k == "send_message" and not body.strip() or k == "send_template" and not s["template"] or k in ("add_tag", "remove_tag") and not s["tag"] or k == "create_deal" and not s["stage"] or k == "send_webhook" and not s["url"]:
            status = "failed"
        elif k == "wait":
            status = "partial"
        elif k == "update_contact_field" and s["field"] == "phone":
            status = "skipped"
        out.append((place, s, status, body, None))
        if status in ("failed", "partial"):
            break
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    steps = some_steps(rng, range(6), 6)
    people = {i: dict(id=i, user_id=i % 3, name=f"n{i % 4}", email=rng.choice(("n1", None)), company="c") for i in range(12)}
    tags = {(i, rng.choice("abc")) for i in range(12) for _ in range(2)}
    talks = [dict(id=100 + i, user_id=rng.randrange(3), contact_id=rng.randrange(12), status=rng.choice(("open", "pending")), assigned_agent=rng.choice(("old", None))) for i in range(30)]
    some = [dict(event_id=i, automation_id=rng.randrange(6), user_id=rng.randrange(3), contact_id=rng.choice((*range(12), None)), conversation_id=rng.choice((None, 7)), at=START + timedelta(hours=rng.randrange(30)), text=rng.choice(("hi there", "X", None)), vars=rng.choice(({"who": "Bo"}, None)), trigger="t") for i in range(250)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = dict(
        steps=frame([[s[c] for c in COLUMNS] for s in steps], STEPS), contacts=frame([list(p.values()) for p in people.values()], "id long, user_id long, name string, email string, company string"),
        tags=frame(sorted(tags), "contact_id long, tag string"), talks=frame([list(t.values()) for t in talks], "id long, user_id long, contact_id long, status string, assigned_agent string"),
        runs=frame([list(r.values()) for r in some], "event_id long, automation_id long, user_id long, contact_id long, conversation_id long, at timestamp_ntz, text string, vars map<string,string>, trigger string"),
        profiles=frame([(0, "zoe"), (0, "amy"), (1, "kim")], "user_id long, agent string"),
    )
    done = runs.execute(tables["runs"], tables["steps"], tables["contacts"], tables["tags"], tables["talks"]).cache()
    want = [(r, *x) for r in some for x in walk(steps, r, people, tags, talks)]
    return tables, done, want, people, tags, talks, some


def test_runs_equal_a_walk(world):
    _, done, want, *_ = world
    got = sorted((r["event_id"], tuple(r["place"]), r["id"], r["status"], r["body"] if r["kind"] != "send_webhook" else None, r["chosen"]) for r in done.collect())
    assert got == sorted((r["event_id"], place, s["id"], status, body, chosen) for r, place, s, status, body, chosen in want)
    assert max(len(x[1]) for x in got) >= 7


def test_logs_equal_a_walk(world):
    tables, done, want, *_, some = world
    outer = {}
    for r, place, s, status, _, _ in want:
        outer.setdefault(r["event_id"], []).append((place, s, status))
    logs = {r["event_id"]: r for r in runs.automation_logs(tables["runs"], done).collect()}
    assert set(logs) == {r["event_id"] for r in some}
    for event, rows in outer.items():
        top = [status for place, _, status in rows if len(place) == 1]
        assert logs[event]["status"] == ("failed" if "failed" in top else "partial" if "partial" in top else "success") and logs[event]["n_steps"] == len(rows)

        def appended(way):
            here = [x for x in rows if x[0][:-1] == way]
            return [y for place, s, _ in here if s["kind"] == "condition" for y in appended(place)] + [s["id"] for _, s, _ in here]

        assert [int(x.split(":")[0]) for x in logs[event]["steps"].split(",")] == appended(())


def test_effects_equal_writes_one_after_the_other(world):
    tables, done, want, people, tags, talks, _ = world
    people, tags, talks = {k: dict(v, updated_at=None) for k, v in people.items()}, set(tags), [dict(t, updated_at=None) for t in talks]
    deals = []
    for r, place, s, status, body, _ in sorted(want, key=lambda x: (x[0]["at"], x[0]["event_id"], x[0]["automation_id"], x[1])):
        if status != "success":
            continue
        who, k = r["contact_id"], s["kind"]
        own = [t for t in talks if (t["user_id"], t["contact_id"]) == (r["user_id"], who)]
        if k == "add_tag":
            tags.add((who, s["tag"]))
        elif k == "remove_tag":
            tags.discard((who, s["tag"]))
        elif k == "update_contact_field":
            people[who] |= {s["field"]: s["value"], "updated_at": r["at"]}
        elif k == "create_deal":
            deals.append((r["event_id"], s["id"], who, body))
        elif k == "close_conversation":
            for t in own:
                t |= dict(status="closed", updated_at=r["at"])
        elif k == "assign_conversation":
            agent = {0: "amy", 1: "kim"}.get(r["user_id"]) if s["mode"] == "round_robin" else s["agent"]
            for t in own if agent else ():
                t["assigned_agent"] = agent
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(effects.tags_after(done, tables["tags"]).collect()) == order(tags)
    assert order(effects.contacts_after(done, tables["contacts"]).collect()) == order(p.values() for p in people.values())
    assert order(effects.deals_created(done).select("event_id", "step_id", "contact_id", "title").collect()) == order(deals) != []
    got = effects.conversations_after(done, tables["talks"], tables["profiles"]).select("id", "user_id", "contact_id", "status", "assigned_agent", "updated_at")
    assert order(got.collect()) == order(t.values() for t in talks)


def test_parked_runs_go_on_at_their_time(world):
    tables, done, want, *_ = world
    rest = runs.execute(tables["runs"], tables["steps"], tables["contacts"], tables["tags"], tables["talks"], parked=runs.parked(done))
    waits = {(r["event_id"], place[:-1]): (place[-1], r["at"] + timedelta(milliseconds=max(1000, s["amount"] * {"hours": 3_600_000, "days": 86_400_000}.get(s["unit"], 60_000)))) for r, place, s, status, _, _ in want if status == "partial"}
    rows = rest.collect()
    assert rows and all(any((r["event_id"], tuple(r["place"][:i])) in waits and r["place"][i] > waits[r["event_id"], tuple(r["place"][:i])][0] for i in range(len(r["place"]))) for r in rows)
    assert {(r["event_id"], r["at"]) for r in rows} <= {(e, at) for (e, _), (_, at) in waits.items()}


def test_a_cycle_raises(spark):
    bare = dict.fromkeys(COLUMNS) | dict(automation_id=1, branch="no", position=0, kind="condition", subject="moon")
    steps = spark.createDataFrame([[(bare | x)[c] for c in COLUMNS] for x in (dict(id=1, parent_id=2), dict(id=2, parent_id=1))], STEPS)
    run = spark.createDataFrame([(5, 1, 1, START, "x", "t")], "event_id long, automation_id long, user_id long, at timestamp_ntz, text string, trigger string")
    waiting = spark.createDataFrame([(5, 1, 2, "no", 0)], "event_id long, automation_id long, parent_id long, branch string, next_position int")
    with pytest.raises(ValueError, match="cycle"):
        runs.execute(run, steps, parked=waiting)
    # from the root a cycle is not met
    assert runs.execute(run, steps).count() == 0


def test_keywords_by_rule(spark):
    rows = [("Hello World", ["world"], "contains", False, True), ("Hello World", ["world"], "contains", True, False), ("Hello", ["hello"], "exact", None, True), ("Hello ", ["hello"], "exact", False, False), ("", ["x"], "contains", False, False), (None, ["x"], None, None, False), ("x", [], "exact", False, False), ("x", None, None, None, False), ("ab", ["q", None, "B"], None, False, True)]
    frame = spark.createDataFrame(rows, "t string, k array<string>, m string, c boolean, want boolean")
    assert all(r["want"] == r["got"] for r in frame.withColumn("got", rules.rule_matches(F.col("t"), F.col("k"), F.col("m"), F.col("c"))).collect())


def test_parameters_and_windows(spark):
    one = lambda c: spark.range(1).select(c.alias("y")).first()["y"]
    mapped = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    assert one(text.ordered_values(mapped({"b": "B", "10": "ten", "2": "two", "-1.5": "low", "a": "A", "1e1": "also ten", "": "zero", "Infinity": "word"}))) == ["low", "zero", "two", "ten", "also ten", "word", "A", "B"]
    assert one(text.ordered_values(F.lit(None).cast("map<string,string>"))) == []
    assert one(text.interpolate(F.lit("{{ vars.a.b }}{{message.text}}{{x}}{{a-b}}{{vars.none}}"), F.lit("{{vars.a}}"), mapped({"a": "1"}))) == "1{{vars.a}}{{a-b}}"
    for ts, window, want in (("2024-01-01 23:30:00", "22:00-06:00", True), ("2024-01-01 06:00:00", "22:00-06:00", False), ("2024-01-01 06:00:00", "06:00-06:00", False), ("2024-01-01 06:00:00", "-", False), ("2024-01-01 00:10:00", "x-1", True)):
        assert one(dates.within_window(F.lit(ts).cast("timestamp"), F.lit(window))) is want


# --- trees ---


def listed(tree, rule, parent=-1, branch=""):
    out = []
    for i, (number, kind, below) in enumerate(tree):
        out.append((number, rule, parent, branch, i, kind))
        for b in ("yes", "no"):
            out += listed(below[b], rule, number, b)
    return out


def at_path(tree, path):
    """The list and the place in it that a path names, or None."""
    import re

    parts = re.findall(r"(?:(yes|no)\.)?steps\[(\d+)\]", path)
    here = tree
    for k, (_, i) in enumerate(parts[:-1]):
        if int(i) >= len(here) or here[int(i)][1] != "condition":
            return None
        here = here[int(i)][2][parts[k + 1][0]]
    return here, int(parts[-1][1])


def test_edits_equal_edits_of_lists(spark):
    rng = random.Random(2)
    number = iter(range(1, 100_000))

    def grow(depth):
        out = []
        for _ in range(rng.randint(0, 3)):
            condition = depth and rng.random() < 0.6
            out.append([next(number), "condition" if condition else "wait", {b: grow(depth - 1) if condition else [] for b in ("yes", "no")}])
        return out

    forest = {rule: grow(4) for rule in range(25)}
    before = [x for rule, tree in forest.items() for x in listed(tree, rule)]
    edits = []
    for rule, tree in forest.items():
        for seq in range(rng.randint(0, 4)):
            path = f"steps[{rng.randint(0, 3)}]" + "".join(f".{rng.choice(('yes', 'no'))}.steps[{rng.randint(0, 2)}]" for _ in range(rng.randint(0, 3)))
            op, by, new = rng.choice(("insert", "remove", "move")), rng.choice((-1, 1)), next(number)
            edits.append((rule, seq, op, path, by, new, "condition"))
            found = at_path(tree, path)
            if found is None:
                continue
            here, i = found
            if op == "insert":
                here.insert(i, [new, "condition", {"yes": [], "no": []}])
            elif op == "remove" and i < len(here):
                del here[i]
            elif op == "move" and i < len(here) and 0 <= i + by < len(here):
                here[i], here[i + by] = here[i + by], here[i]
    steps = spark.createDataFrame(before, "id long, automation_id long, parent_id long, branch string, position int, kind string")
    changed = trees.edit_trees(steps, spark.createDataFrame(edits, "automation_id long, seq int, op string, path string, by int, new_id long, kind string"))
    assert sorted(map(tuple, changed.collect())) == sorted(x for rule, tree in forest.items() for x in listed(tree, rule)) != sorted(before)


def test_seeds_below_what_opens_no_branch_go(spark):
    rows = [(1, 0, None, None, "condition"), (1, 1, 0, None, "wait"), (1, 2, 1, "yes", "wait"), (1, 3, 0, "no", "condition"), (1, 4, 3, "no", "wait"), (1, 5, 9, "yes", "wait"), (1, 6, None, None, "wait"), (1, 7, 0, "yes", "wait")]
    got = trees.seeds_to_steps(spark.createDataFrame(rows, "automation_id long, index long, parent_index long, branch string, kind string"))
    assert sorted((r["id"], r["path"]) for r in got.collect()) == [(0, "steps[0]"), (1, "steps[0].yes.steps[0]"), (3, "steps[0].no.steps[0]"), (4, "steps[0].no.steps[0].no.steps[0]"), (6, "steps[1]"), (7, "steps[0].yes.steps[1]")]


# --- sends ---


def test_sends_equal_one_after_the_other(spark):
    rng = random.Random(8)

    def tried(number):
        out = [number]
        for c in (1, 2, 3):
            if len(number) > c and number[c] != "0":
                out.append(number[:c] + "0" + number[c:])
        for c in (1, 2, 3):
            if len(number) > c + 1 and number[c] == "0":
                out.append(number[:c] + number[c + 1 :])
        return list(dict.fromkeys(out))

    people = [(i, i % 3, rng.choice((f"+37{rng.choice(('0', ''))}0612345{i:02}", f"1 41{i:02}5550", "none", None, "0123456789"))) for i in range(40)]
    answers = {}
    for _, _, phone in people:
        for v in tried("".join(filter(str.isdigit, phone or ""))):
            if rng.random() < 0.4:
                answers[v] = rng.choice(((True, None), (False, "(#131030) x"), (False, "not in the allowed list"), (False, "boom")))
    out = [(i, rng.randrange(3), rng.randrange(44), rng.randrange(20), rng.choice(("text", "template")), f"text {i}", f"t{i % 3}", START + timedelta(minutes=rng.randrange(50))) for i in range(300)]
    talks = {i: (i, None, None) for i in range(15)}
    phones = {(user, i): p for i, user, p in people}
    attempts, messages, failures = [], [], []
    for send_id, user, who, talk, kind, body, template, at in sorted(out, key=lambda x: (x[7], x[0])):
        number = "".join(filter(str.isdigit, phones.get((user, who)) or ""))
        if not number:
            failures.append((send_id, "contact not found for this tenant"))
            continue
        if number[0] == "0" or not 7 <= len(number) <= 15:
            failures.append((send_id, "the contact's number is not valid"))
            continue
        error = None
        for place, v in enumerate(tried(number)):
            ok, error = answers.get(v, (False, "not in allowed list"))
            attempts.append((send_id, who, place, v, ok, error))
            if ok or error == "boom":
                break
        if error is not None:
            failures.append((send_id, error))
            continue
        if v != number:
            phones[user, who] = v
        messages.append((send_id, v, "template" if kind == "template" else "text"))
        if talk in talks:
            talks[talk] = (talk, f"[template:{template}]" if kind == "template" else body, at)
    frame = spark.createDataFrame
    done = sends.send(
        frame(out, "send_id long, user_id long, contact_id long, conversation_id long, kind string, text string, template string, at timestamp_ntz"), frame(people, "id long, user_id long, phone string"),
        frame([(k, *v) for k, v in answers.items()], "phone string, accepted boolean, error string"), frame([(i, None, None) for i in talks], "id long, last_message_text string, last_message_at timestamp_ntz"),
    )
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(done.attempts.collect()) == order(attempts)
    assert order(done.messages.select("send_id", "to", "content_type").collect()) == order(messages) != []
    assert order(done.failures.collect()) == order(failures) != []
    assert order(done.contacts.select("id", "user_id", "phone").collect()) == order((i, user, phones[user, i]) for i, user, _ in people)
    assert order(done.conversations.collect()) == order(talks.values())


def test_chunks_and_imports_of_awkward_tables(spark):
    rows = spark.createDataFrame([(g, i, None if i % 5 == 2 and g == 1 else True) for g in (0, 1, None) for i in range(12)], "g long, i long, fits boolean")
    done = sends.insert_in_chunks(rows, "g", F.col("fits"), "i", size=2)
    assert {(r["g"], r["total"], r["inserted"], r["status"], r["failed_count"]) for r in sends.insert_outcomes(done, "g").collect()} == {(0, 12, 12, "sending", 0), (1, 12, 2, "failed", 12), (None, 12, 12, "sending", 0)}
    got = {(r["chunk"], r["imported"], r["failed"], r["row_by_row"]) for r in sends.import_in_chunks(rows.filter("g = 1"), "g", F.col("fits"), "i", size=5).collect()}
    assert got == {(0, 4, 1, True), (1, 4, 1, True), (2, 2, 0, False)}
    assert sends.insert_in_chunks(rows.limit(0), "g", F.col("fits"), "i").count() == 0


# --- replies ---


@pytest.mark.parametrize("parts", [1, 5])
def test_replies_equal_a_stack(spark, parts):
    from murmur.operators import replies

    rng = random.Random(parts)
    sent = [(rng.choice((0, 0, 0, 0, 1, 2, 3)), START + timedelta(hours=rng.randrange(60)), rng.choice(("sent", "delivered", "read", "failed", "pending")), f"{i:05}") for i in range(500)]
    heard = [(rng.choice((0, 0, 0, 0, 1, 2, 9)), START + timedelta(hours=rng.randrange(60)), i) for i in range(500)]
    stacks, want = {}, {}
    moves = [(c, at, 0, name, None) for c, at, s, name in sent if s in replies.OPEN] + [(c, at, 1, f"{i:020}", i) for c, at, i in heard]
    for c, _, kind, name, i in sorted(moves, key=lambda m: m[:4]):
        if kind == 0:
            stacks.setdefault(c, []).append(name)
        elif stacks.get(c):
            want[i] = stacks[c].pop()
    people = spark.createDataFrame(sent, "contact_id long, created_at timestamp_ntz, status string, order string").withColumn("payload", F.struct("order"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = replies.answered_recipients(people, spark.createDataFrame(heard, "contact_id long, at timestamp_ntz, reply_id long"))
        assert {r["reply_id"]: r["payload"]["order"] for r in got.collect()} == want and len(want) < len(heard)
        after = replies.recipients_after(people, got, "order")
        assert after.filter("status = 'replied'").count() == len(want) and after.count() == len(sent)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_steps_are_computed_once_for_all_levels(spark):
    """Paths look a level at a time at steps that were computed once; only conditions of runs are written with tags of the contact."""
    from murmur.operators import runs as run_operators
    from murmur.operators.trees import rooted

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    n = 5
    names = "id long, automation_id long, parent_id long, branch string, position int, kind string, text_of_step string, tag string, amount long, unit string, field string, stage string"
    steps = spark.createDataFrame([(i, 1, i - 1 if i else -1, "yes" if i else "", 0, "condition", None, None, None, None, None, None) for i in range(n)], names)
    paths = rooted(steps.mapInArrow(counted, steps.schema))
    assert [r["path"] for r in paths.orderBy("depth").collect()] == ["steps[0]" + ".yes.steps[0]" * i for i in range(n)]
    assert read.value == n
    one = spark.createDataFrame([(7, 1, 3)], "event_id long, automation_id long, user_id long").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS at", "'x' AS text", "'t' AS trigger")
    tags = spark.createDataFrame([(3, "gold")], "contact_id long, tag string")
    done = run_operators.execute(one, steps.union(steps.filter("id = 4").selectExpr("9L", "automation_id", "parent_id", "branch", "1", "'close_conversation'", *steps.columns[6:])), contact_tags=tags)
    rows = {r["id"]: r for r in done.collect()}
    assert sorted(rows) == [*range(n), 9] and rows[4]["tags"] == ["gold"] and rows[9]["tags"] is None
