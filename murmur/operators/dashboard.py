"""The dashboard's figures and the feed of latest activity."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import first_filled


def metrics(conversations: DataFrame, contacts: DataFrame, deals: DataFrame, messages: DataFrame, today: str) -> DataFrame:
    """(metric, current, previous): open conversations, new contacts, open deals and their value, messages of agents.

    The previous value of open conversations is a difference: opened today less opened yesterday.
    """
    begin = F.lit(today).cast("timestamp_ntz")
    at = F.col("created_at")
    now, before = at >= begin, (at >= begin - F.expr("INTERVAL 1 DAY")) & (at < begin)

    def row(rows: DataFrame, name: str, current, previous=None) -> DataFrame:
        return rows.agg(current.cast("double").alias("current"), (F.lit(None) if previous is None else previous).cast("double").alias("previous")).select(F.lit(name).alias("metric"), "current", "previous")

    shown = deals.filter("status = 'open'")
    parts = [
        row(conversations.filter("status = 'open'"), "active_conversations", F.count("*"), F.count_if(now) - F.count_if(before)),
        row(contacts, "new_contacts", F.count_if(now), F.count_if(before)),
        row(shown, "open_deals", F.count("*")),
        row(shown, "open_deals_value", F.coalesce(F.sum("value"), F.lit(0))),
        row(messages.filter("sender_type = 'agent'"), "messages_sent", F.count_if(now), F.count_if(before)),
    ]
    return reduce(DataFrame.unionByName, parts)


def activity(messages: DataFrame, contacts: DataFrame, deals: DataFrame, broadcasts: DataFrame, logs: DataFrame, limit: int = 20) -> DataFrame:
    """(id, kind, text, at, href) of the latest of five sources: 10 of each, 5 broadcasts; each is cut before names are joined."""
    last = lambda rows, n, at="created_at": rows.orderBy(F.desc(at), F.desc("id")).limit(n)
    people = contacts.select(F.col("id").alias("contact_id"), first_filled(F.col("name"), F.col("phone")).alias("who"))
    named = lambda rows, other: rows.join(people, "contact_id", "left").withColumn("who", F.coalesce("who", F.lit(other)))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def item(rows: DataFrame, short: str, kind: str, words, at: str, href) -> DataFrame:
        return rows.select(text(f"{short}-", F.col("id").cast("string")).alias("id"), F.lit(kind).alias("kind"), words.alias("text"), F.col(at).alias("at"), href.cast("string").alias("href"))

    m = named(last(messages.filter("sender_type = 'customer'").withColumn("contact_id", F.col("conversation_id")), 10), "Unknown")
    d, b = last(deals, 10, "updated_at"), last(broadcasts, 5)
    log = named(last(logs, 10), "a contact")
    size = F.col("total").cast("string")
    items = [
        item(m, "msg", "message", text("New message from ", F.col("who")), "created_at", text("/inbox?c=", F.col("conversation_id").cast("string"))),
        item(last(contacts, 10), "contact", "contact", text("New contact: ", first_filled(F.col("name"), F.col("phone"))), "created_at", F.lit("/contacts")),
        item(d, "deal", "deal", F.when(F.col("stage_id").isNull(), text('Deal "', F.col("title"), '" updated')).otherwise(text('Deal "', F.col("title"), '" in ', F.col("stage_id"))), "updated_at", F.lit("/pipelines")),
        item(b, "broadcast", "broadcast", text('Broadcast "', F.col("name"), '" ', F.when(F.col("status") == "sent", text("sent to ", size, " contacts")).otherwise(text(F.col("status"), " (", size, " recipients)"))), "created_at", F.lit("/broadcasts")),
        item(log, "auto", "automation", text('Automation "', F.col("automation"), '" ', F.when(F.col("status") == "failed", "failed for ").otherwise("triggered for "), F.col("who")), "created_at", F.lit(None)),
    ]
    return reduce(DataFrame.unionByName, items).orderBy(F.desc("at"), "id").limit(limit)


def funnel(counts: DataFrame, key: str, steps: list[str]) -> DataFrame:
    """One row a step: its value, its share of the largest step (5 at least) and of the first step, in per cent."""
    half_up = lambda x: F.floor(x + F.lit(0.5))
    first, top = F.col(steps[0]), F.greatest(F.lit(1), *[F.col(s) for s in steps])
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("step"), F.col(s).alias("value"), F.greatest(F.lit(5), half_up(100.0 * F.col(s) / top)).cast("long").alias("of_max"), F.when(first > 0, half_up(100.0 * F.col(s) / first)).otherwise(0).cast("long").alias("of_first")) for i, s in enumerate(steps)])
    return counts.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def chart_scale(series: DataFrame, first: str, second: str) -> DataFrame:
    """The largest value of two columns, the axis marks at its quarters, and every how many days a label stands."""
    top = F.greatest(F.lit(1), F.max(F.greatest(first, second)))
    rows = series.agg(top.alias("top"), F.greatest(F.lit(1), F.ceil(F.count("*") / 6)).cast("long").alias("stride"))
    ticks = F.array_distinct(F.transform(F.array(*[F.lit(q / 4) for q in range(5)]), lambda q: F.floor(q * F.col("top") + F.lit(0.5))))
    return rows.select("top", F.array_join(ticks.cast("array<string>"), ",").alias("ticks"), "stride")
