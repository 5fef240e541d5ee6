"""Change feeds with replays, late rows, partial updates and provisional rows, as streams and as batches.

Every fold here is written so that its result does not depend on the order in which rows arrive: rows carry their own
order (time and sequence). So the stream and the batch of the same rows agree, and a row that comes twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_feed(changes: DataFrame, key: str, columns: list[str], order: tuple[str, ...] = ("at", "seq"), provisional: str | None = "temp-") -> DataFrame:
    """(key, op, order, changed, columns) change feed, batch or stream -> the rows it leaves, merged column by column.

    The first INSERT makes a row, later ones of its key are replays. An UPDATE after it sets the columns named in its array
    changed, to null too, and leaves the others; of several the last in order counts, whenever it arrives. UPDATEs of
    rows that were never inserted, or from before the insert, and DELETEs change nothing; provisional ids are left out.
    One aggregation: the state of a key is its first row and one value a column.
    """
    when = F.struct(*order)
    if provisional:
        changes = changes.filter(~F.col(key).startswith(provisional))
    insert, update = F.col("op") == "INSERT", F.col("op") == "UPDATE"
    value = lambda c: F.struct(when.alias("order"), F.col(c).alias("x"))
    changed = lambda c: update & F.array_contains("changed", c)
    first = F.min_by(F.struct(when.alias("order"), *columns), F.when(insert, when)).alias("__first")
    later = [F.max_by(value(c), F.when(changed(c), when)).alias(f"__{i}") for i, c in enumerate(columns)]
    rows = changes.filter(insert | update).groupBy(key).agg(first, *later).filter(F.col("__first").isNotNull())
    newer = lambda i: F.coalesce(F.col(f"__{i}.order") > F.col("__first.order"), F.lit(False))
    return rows.select(key, *[F.when(newer(i), F.col(f"__{i}.x")).otherwise(F.col(f"__first.{c}")).alias(c) for i, c in enumerate(columns)])


def deduplicated(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """A stream without the replays of its rows: a key counts once within the delay, and its state goes when the watermark has passed it."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def write_once(path: str):
    """For foreachBatch: each micro-batch is a folder that its number names, and replaces what an attempt of the same number left.

    A stream that stops after a write and before its own checkpoint repeats the batch with the same number and the same rows, so
    the table (all folders below path) holds every row once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def optimistic(events: DataFrame, keys: list[str], clock: Column, patience: str) -> DataFrame:
    """(keys, request, kind: ask | confirm | reject, value, at, seq) -> keys, shown and pending, as of the clock.

    An ask shows its value at once and is pending; a confirmation makes its value the settled one; a rejection, or no answer
    for as long as patience, takes the pending value back to the settled one. A later ask replaces a pending one. An empty
    value is no value.
    """
    order = F.struct("at", "seq")
    asks, answers = F.col("kind") == "ask", F.col("kind").isin("confirm", "reject")
    # a row a request: many answers of a key do not meet in one place
    each = events.groupBy(*keys, "request").agg(
        F.max(F.when(asks, order)).alias("asked"), F.max_by("value", F.when(asks, order)).alias("wanted"), F.bool_or(answers).alias("answered"),
        F.max(F.when(F.col("kind") == "confirm", order)).alias("settled_at"), F.max_by("value", F.when(F.col("kind") == "confirm", order)).alias("settled"),
    )
    last = each.groupBy(*keys).agg(F.max_by("settled", "settled_at").alias("settled"), F.max_by(F.struct("wanted", "answered", "asked"), "asked").alias("ask"))
    waits = F.col("ask").isNotNull() & ~F.coalesce("ask.answered", F.lit(False)) & (F.col("ask.asked.at") + F.expr(f"INTERVAL {patience}") > clock)
    return last.select(*keys, F.when(waits, F.col("ask.wanted")).otherwise(F.coalesce("settled", F.lit(""))).alias("shown"), F.coalesce(waits, F.lit(False)).alias("pending"))


def stream_optimistic(events: DataFrame, patience_seconds: int, delay: str = "1 hour") -> DataFrame:
    """The same for a stream of (message_id, actor_id, request, kind, value, at, seq): keyed state in two phases, and a timer that rolls back.

    State of a key is its settled value and the one pending ask. Rows of a micro-batch are taken in their order; an answer may come
    before its ask, so the requests answered since the watermark are remembered. The timer fires when the watermark has
    passed the ask's time and patience.
    """
    state_type = "settled string, settled_us long, request string, wanted string, asked_us long, answered array<string>, answered_us array<long>"
    out_type = "message_id long, actor_id long, shown string, pending boolean"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        settled, settled_us, request, wanted, asked_us, names, times = state.get if state.exists else ("", -1, None, None, -1, [], [])
        answered = dict(zip(names, times))
        now = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for row in pd.concat(list(frames)).sort_values(["us", "seq"]).itertuples():
                if row.kind == "ask":
                    if row.us >= asked_us:
                        request, wanted, asked_us = row.request, row.value, row.us
                else:
                    answered[row.request] = row.us
                    if row.kind == "confirm" and row.us >= settled_us:
                        settled, settled_us = row.value, row.us
        if request is not None and (request in answered or asked_us + patience_seconds * 1_000_000 <= now):
            request, wanted = None, None
        answered = {name: us for name, us in answered.items() if us > now}
        state.update((settled, settled_us, request, wanted, asked_us, list(answered), list(answered.values())))
        if request is not None:
            state.setTimeoutTimestamp(max((asked_us + patience_seconds * 1_000_000) // 1000 + 1, now // 1000 + 1))
        yield pd.DataFrame({"message_id": [key[0]], "actor_id": [key[1]], "shown": [wanted if request is not None else settled], "pending": [request is not None]})

    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    return timed.groupBy("message_id", "actor_id").applyInPandasWithState(fold, out_type, state_type, "update", "EventTimeTimeout")


def stream_unread_bounded(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Customer messages of each conversation after its last answer, with state that does not grow with how long nobody answers.

    Times above the watermark are kept one by one, as an answer may still fall between them; those below can only be answered
    by something later, so they are a number. Rows below the watermark are late and left out. kept tells how many times
    the state of the conversation holds.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        answered, settled, waiting = state.get if state.exists else (-1, 0, [])
        now = state.getCurrentWatermarkMs() * 1000
        waiting = list(waiting)
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            rows = rows[rows["us"] >= now]
            outbound = rows.loc[rows["sender_type"] != "customer", "us"]
            if len(outbound) and int(outbound.max()) > answered:
                answered, settled = int(outbound.max()), 0
            waiting += rows.loc[rows["sender_type"] == "customer", "us"].tolist()
        waiting = [int(t) for t in waiting if t > answered]
        settled += sum(t < now for t in waiting)
        waiting = [t for t in waiting if t >= now]
        state.update((answered, settled, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting) // 1000 + 1)
        yield pd.DataFrame({"conversation_id": [key[0]], "unread_count": [settled + len(waiting)], "kept": [len(waiting)]})

    timed = messages.select("conversation_id", "sender_type", F.col("created_at").cast("timestamp").alias("at")).withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    return timed.groupBy("conversation_id").applyInPandasWithState(fold, "conversation_id long, unread_count long, kept long", "answered long, settled long, waiting array<long>", "update", "EventTimeTimeout")
