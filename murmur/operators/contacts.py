"""Contacts: search, tags, phone matching, import, and keyed changes of tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions.phone import match_key


def search_page(contacts: DataFrame, term: str, page: int, size: int) -> DataFrame:
    """One page by name and id; ``%`` and ``_`` of the term are wildcards."""
    like = f"%{term.strip()}%"
    found = contacts.filter(F.col("name").ilike(like) | F.col("phone").ilike(like) | F.col("company").ilike(like)) if term.strip() else contacts
    return found.orderBy("name", "id").offset(page * size).limit(size)


def with_tags(contacts: DataFrame, contact_tags: DataFrame) -> DataFrame:
    tags = contact_tags.groupBy(F.col("contact_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return contacts.join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def match_phones(inbound: DataFrame, contacts: DataFrame) -> DataFrame:
    """(phone) rows of inbound -> the contact of the smallest id whose number matches: an equi-join on the match key."""
    keyed = contacts.select(match_key(F.col("phone")).alias("k"), "id").filter("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("contact_id"), F.count("*").alias("candidates"))
    return inbound.withColumn("k", match_key(F.col("phone"))).join(keyed, "k", "left").drop("k")


def csv_upsert(contacts: DataFrame, imported: DataFrame) -> DataFrame:
    """(ord, phone, name) rows of a file -> those to insert: the last row of each phone at its first place, unless known."""
    once = imported.groupBy("phone").agg(F.min("ord").alias("ord"), F.max_by("name", "ord").alias("name"))
    return once.join(contacts.select("phone"), "phone", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """Rows of new win over rows of old with the same keys, or with replace False lose."""
    first, second = (new, old) if replace else (old, new)
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__turn", F.row_number().over(w)).filter("__turn = 1").drop("__turn")


def cascade_delete(children: DataFrame, survivors: DataFrame, child_key: str, key: str) -> DataFrame:
    return children.join(survivors.select(F.col(key).alias(child_key)), child_key, "left_semi")


def set_null_delete(children: DataFrame, survivors: DataFrame, child_key: str, key: str) -> DataFrame:
    """Children stay; a key whose parent is gone becomes null."""
    there = survivors.select(F.col(key).alias("__there")).distinct()
    joined = children.join(there, F.col(child_key) == F.col("__there"), "left")
    return joined.withColumn(child_key, F.col("__there")).drop("__there")


def restricted_delete(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """The parents that may go: no child refers to them."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def for_tenant(children: DataFrame, parents: DataFrame, child_key: str, key: str, user_id: int) -> DataFrame:
    """Rows whose parent belongs to the tenant."""
    return children.join(parents.filter(F.col("user_id") == user_id).select(F.col(key).alias(child_key)), child_key, "left_semi")


def sync_actions(stored: DataFrame, fetched: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """insert, update or keep for every fetched row by its natural key; rows that were not fetched are left."""
    s = stored.select(*keys, F.struct(*compared).alias("__old"))
    rows = fetched.withColumn("__new", F.struct(*compared)).join(s, keys, "left")
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__old") == F.col("__new"), "keep").otherwise("update")
    return rows.withColumn("action", action).drop("__old", "__new")


def page_with_total(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page (from 1) with the number of rows and of pages: a count and a top-k, two plans."""
    total = rows.count()
    page_rows = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return page_rows.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(-(-total // size)).cast("long")})
