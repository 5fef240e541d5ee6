"""Streaming twins of the stateful operators: keyed state for the ladder, counters and latest rows for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.status import counters_of, fold_status


def stream_ladder(events: DataFrame) -> DataFrame:
    """(key, seq, at, status) stream -> (key, status) after each micro-batch, in update mode.

    State is one status for each key. Within a micro-batch events are taken in the order of time; an event that
    comes in a later micro-batch is folded in when it comes.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        current = tuple(state.get) if state.exists else ("pending", False)
        for row in pd.concat(list(frames)).sort_values(["at", "seq"]).itertuples():
            current = fold_status(current, row.status)
        state.update(current)
        yield pd.DataFrame({"key": [key[0]], "status": [current[0]]})

    return events.groupBy("key").applyInPandasWithState(fold, "key long, status string", "status string, over boolean", "update", "NoTimeout")


def stream_limiter(calls: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """(key, seq, at) stream -> (key, seq, allowed); state is the open window's begin and its calls."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["at_ms", "seq"])
        allowed = []
        for t in rows["at_ms"]:
            if opened is None or t - opened >= window_ms:
                opened, used = float(t), 0
            used += 1
            allowed.append(used <= limit)
        state.update((opened, used))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "allowed": allowed})

    timed = calls.select("key", "seq", (F.unix_micros(F.col("at").cast("timestamp")) / 1000).alias("at_ms"))
    return timed.groupBy("key").applyInPandasWithState(fold, "key long, seq long, allowed boolean", "opened double, used long", "append", "NoTimeout")


def stream_counters(changes: DataFrame) -> DataFrame:
    """(broadcast_id, old, new) stream -> counters of each broadcast; plain streaming aggregation over deltas."""
    gain = F.transform(counters_of(F.col("new")), lambda c: F.struct(c.alias("counter"), F.lit(1).alias("d")))
    loss = F.transform(counters_of(F.col("old")), lambda c: F.struct(c.alias("counter"), F.lit(-1).alias("d")))
    rows = changes.select("broadcast_id", F.explode(F.concat(gain, loss)).alias("x"))
    return rows.groupBy("broadcast_id", "x.counter").agg(F.greatest(F.lit(0), F.sum("x.d")).alias("n"))


def stream_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, as change feeds of messages, conversations and reactions are folded."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def stream_unread(messages: DataFrame) -> DataFrame:
    """Customer messages of each conversation after the last answer, from two running maxima and a list of late times.

    Kept as a count of inbound messages by hour would be inexact; so state is the times since the last answer only.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        answered, waiting = state.get if state.exists else (None, [])
        rows = pd.concat(list(frames))
        outbound = rows.loc[rows["sender_type"] != "customer", "us"]
        if len(outbound):
            answered = int(max(outbound.max(), answered if answered is not None else outbound.max()))
        times = [*waiting, *rows.loc[rows["sender_type"] == "customer", "us"].tolist()]
        waiting = [int(t) for t in times if answered is None or t > answered]
        state.update((answered, waiting))
        yield pd.DataFrame({"conversation_id": [key[0]], "unread_count": [len(waiting)]})

    timed = messages.select("conversation_id", "sender_type", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"))
    return timed.groupBy("conversation_id").applyInPandasWithState(fold, "conversation_id long, unread_count long", "answered long, waiting array<long>", "update", "NoTimeout")


def stream_message_feed(feed: DataFrame) -> DataFrame:
    """(id, op, at, seq, ...) change feed -> the latest form of each message; provisional rows (``temp-``) and deletions are left out."""
    return stream_latest(feed.filter("op != 'DELETE'").filter(~F.col("id").startswith("temp-")), ["id"], ["at", "seq"])


def stream_previews(messages: DataFrame, active: int | None = None) -> DataFrame:
    """messages -> each conversation's last text and time, and how many came, of any sender; none for the one that is open.

    Plain aggregation, so it is its own batch twin.
    """
    unread = F.count("*") if active is None else F.count_if(F.col("conversation_id") != active)
    rows = messages.groupBy("conversation_id").agg(F.max_by(F.coalesce("content_text", F.lit("")), F.struct("created_at", "id")).alias("last_message_text"), F.max("created_at").alias("last_message_at"), unread.alias("unread_count"))
    return rows.select("conversation_id", "last_message_text", "last_message_at", "unread_count")


def stream_reactions(events: DataFrame, messages: DataFrame) -> DataFrame:
    """(message_id, actor_id, emoji, at, seq) stream and a static table of messages (id) -> each actor's last reaction.

    Reactions to unknown messages are dropped before the state; an empty emoji takes a reaction back.
    """
    there = messages.select(F.col("id").alias("message_id"))
    return stream_latest(events.join(there, "message_id", "left_semi"), ["message_id", "actor_id"], ["at", "seq"]).filter("emoji != ''").drop("seq")
