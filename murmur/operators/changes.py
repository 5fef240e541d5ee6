"""Keyed changes of tables: each takes the table as it is and gives it as it becomes (or what a change did)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def update_by_key(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of changes besides the keys replace those of all rows with the same keys, nulls too.

    The keys of changes are unique; those of rows need not be. Rows without a change stay, changes without a row go.
    """
    new = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, F.struct(*new).alias("__new"))
    joined = rows.join(c, keys, "left")
    out = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{x}")).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in rows.columns]
    return joined.select(*out)


def claim(pending: DataFrame, ids: DataFrame, key: str, before: str = "pending", after: str = "running") -> DataFrame:
    """The rows among ids that are still in the state before, in the state after: a second claim finds none of them."""
    free = pending.filter(F.col("status") == before)
    return free.join(ids.select(key).distinct(), key, "left_semi").withColumn("status", F.lit(after))


def replace_children(children: DataFrame, parents: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children of parents go and new ones come; those of other parents stay. A parent without new ones has none after."""
    return children.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def seed_if_empty(tenants: DataFrame, owned: DataFrame, seeds: list[tuple]) -> DataFrame:
    """(user_id) without a row in owned get one row a seed (name, colour), numbered by position from 0."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.lit(c).alias("colour")) for i, (n, c) in enumerate(seeds)])
    bare = tenants.select("user_id").distinct().join(owned.select("user_id"), "user_id", "left_anti")
    return bare.select("user_id", F.explode(rows).alias("s")).select("user_id", "s.*")


def split_by_enum(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows with accepted: whether the column holds one of the allowed values; null is no value and is accepted."""
    return rows.withColumn("accepted", F.coalesce(F.col(column).isin(allowed), F.lit(True)))


def import_outcome(rows: DataFrame, good: Column) -> DataFrame:
    """How many rows an import brings and how many it rejects."""
    ok = F.coalesce(good, F.lit(False))
    return rows.agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("failed"))


def mark_read(conversations: DataFrame, opened: DataFrame) -> DataFrame:
    """Conversations that are open and have unread messages have none; touched says which."""
    o = opened.select("conversation_id").distinct().withColumn("__open", F.lit(True))
    touched = F.coalesce(F.col("__open"), F.lit(False)) & (F.col("unread_count") > 0)
    rows = conversations.join(o, "conversation_id", "left").withColumn("touched", touched)
    return rows.withColumn("unread_count", F.when(F.col("touched"), 0).otherwise(F.col("unread_count"))).drop("__open")


def move_item(rows: DataFrame, group: str, key: str, moves: DataFrame) -> DataFrame:
    """(group, position) lists and moves (group, from_position, to_position) -> the lists with one item of each moved, numbered anew.

    The item goes before the one at its new place if it moves up and after it if it moves down.
    """
    r = rows.join(moves, group, "left")
    p, begin, end = F.col("position"), F.col("from_position"), F.col("to_position")
    place = F.when(p == begin, end + F.when(end > begin, 0.5).otherwise(-0.5)).otherwise(p).cast("double")
    order = Window.partitionBy(group).orderBy(place, key)
    return r.withColumn("position", F.row_number().over(order) - 1).select(*rows.columns)


def copy_trees(steps: DataFrame, copies: DataFrame, new_id: Callable[[Column, Column], Column]) -> DataFrame:
    """copies (automation_id, copy_id) -> the steps of each copy with ids and parents by new_id, a function of id and copy_id.

    The id of a parent is computed, not looked up, so no self join is needed; roots keep -1.
    """
    rows = steps.join(copies, "automation_id").withColumn("automation_id", F.col("copy_id"))
    parent = F.when(F.col("parent_id") == -1, F.lit(-1)).otherwise(new_id(F.col("parent_id"), F.col("copy_id")))
    return rows.withColumns({"parent_id": parent.cast("long"), "id": new_id(F.col("id"), F.col("copy_id")).cast("long")}).drop("copy_id")
