"""Queries of campaigns, from audience to recipients, each with DuckDB SQL. A campaign is a nation's, and its contacts are that nation's customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import campaigns
from murmur.plans.queries import query
from murmur.sources import views

KINDS = ("all", "tags", "custom_field", "csv", "later")
OPERATORS = ("is", "is_not", "contains")


def _campaigns(spark, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))
    pair = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    variables = F.map_from_arrays(F.array(F.lit("10"), F.lit("2"), F.lit("who"), F.lit("1")), F.array(pair("static", F.col("n_name")), pair("field", F.lit("name")), pair("custom_field", F.lit("segment")), pair("field", F.when(key % 2 == 0, "company").otherwise("shoe"))))
    return views.table(spark, sf_dir, "nation").select(
        key.cast("long").alias("campaign_id"), key.cast("long").alias("user_id"), pick(KINDS, key).alias("kind"), F.array(F.lit("2-HIGH"), F.lit("5-LOW")).alias("tags"), F.when(key % 10 != 7, "segment").alias("field"), pick(OPERATORS, key).alias("operator"), F.lit("BU%D").alias("value"),
        F.when(key % 3 == 0, F.array(F.lit("1-URGENT"))).when(key % 3 == 1, F.array().cast("array<string>")).alias("excluded"), F.when(key % 11 != 4, variables).alias("variables"),
    ).withColumn("value", F.when(F.col("operator") == "contains", "bu%d").otherwise("BUILDING"))


def _lists(spark, sf_dir: str) -> DataFrame:
    """The lists of every campaign: customers of the nation, as they are written or with a blank more, and some lines twice."""
    key = F.col("id")
    c = views.contacts(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("long"))
    rows = c.filter(key % 3 != 2).select(F.col("user_id").alias("campaign_id"), "user_id", key.alias("ord"), F.concat("phone", F.when(key % 6 == 0, " ").otherwise("")).alias("phone"), F.concat(F.lit("L"), key.cast("string")).alias("name"))
    return rows.unionByName(rows.filter("ord % 9 = 0").withColumn("ord", F.col("ord") + 1_000_000))


def _contacts(spark, sf_dir: str) -> DataFrame:
    return views.contacts(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("long"))


_BASE = f"""contacts AS (SELECT id, user_id::BIGINT AS user_id, name, company, phone FROM ({views.SQL['contacts']})), contact_tags AS ({views.SQL['contact_tags']}),
  lines AS (SELECT user_id, id AS ord, phone || CASE WHEN id % 6 = 0 THEN ' ' ELSE '' END AS phone, 'L' || id AS name FROM contacts WHERE id % 3 <> 2),
  listed AS (SELECT * FROM lines UNION ALL SELECT user_id, ord + 1000000, phone, name FROM lines WHERE ord % 9 = 0),
  fresh AS (SELECT user_id, phone, arg_max(name, ord) AS name FROM listed WHERE (user_id, phone) NOT IN (SELECT (user_id, phone) FROM contacts) GROUP BY ALL),
  everybody AS (SELECT * FROM contacts UNION ALL SELECT -1, user_id, name, NULL, phone FROM fresh),
  camps AS (SELECT n_nationkey::BIGINT AS campaign_id, n_name, ['all', 'tags', 'custom_field', 'csv', 'later'][n_nationkey % 5 + 1] AS kind, CASE n_nationkey % 3 WHEN 0 THEN 'is' WHEN 1 THEN 'is_not' ELSE 'contains' END AS operator, n_nationkey % 10 <> 7 AS has_field, n_nationkey % 3 = 0 AS excludes, n_nationkey % 11 <> 4 AS has_variables FROM nation),
  chosen AS (SELECT c.*, p.* FROM camps c JOIN everybody p ON p.user_id = c.campaign_id WHERE CASE kind WHEN 'all' THEN true WHEN 'tags' THEN p.id IN (SELECT contact_id FROM contact_tags WHERE tag IN ('2-HIGH', '5-LOW'))
    WHEN 'custom_field' THEN coalesce(has_field AND CASE operator WHEN 'is' THEN company = 'BUILDING' WHEN 'is_not' THEN company <> 'BUILDING' ELSE company ILIKE '%bu%d%' END, false)
    WHEN 'csv' THEN (p.user_id, p.phone) IN (SELECT (user_id, phone) FROM listed) ELSE false END AND (kind = 'csv' OR p.id >= 0) AND NOT (excludes AND p.id IN (SELECT contact_id FROM contact_tags WHERE tag = '1-URGENT')))"""


def _chosen(spark, sf_dir: str) -> DataFrame:
    lists, people = _lists(spark, sf_dir), _contacts(spark, sf_dir)
    everybody = campaigns.with_imports(people, lists)
    return campaigns.audiences(_campaigns(spark, sf_dir), campaigns.profiled(everybody, views.contact_tags(spark, sf_dir), views.custom_values(spark, sf_dir)), lists)


@query(f"WITH {_BASE} SELECT campaign_id, kind, id AS contact_id, phone, name FROM chosen")
def campaign_audiences(spark, sf_dir: str) -> DataFrame:
    """Audiences of all kinds at once; contacts that a list brings are shown as -1, as their ids are hashes."""
    return _chosen(spark, sf_dir).select("campaign_id", "kind", F.greatest(F.col("id"), F.lit(-1)).alias("contact_id"), "phone", "name")


@query(
    f"""WITH {_BASE} SELECT campaign_id, id AS contact_id, regexp_replace(phone, '[^0-9]', '', 'g') AS phone, regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^[1-9][0-9]{{6,14}}$') AS valid, CASE WHEN has_variables THEN concat_ws('|', CASE WHEN campaign_id % 2 = 0 THEN coalesce(company, '') ELSE '' END, coalesce(name, ''), n_name, coalesce(company, '')) ELSE '' END AS params,
    (row_number() OVER (PARTITION BY campaign_id ORDER BY id) - 1) // 10 AS batch FROM chosen WHERE kind <> 'csv'"""
)
def campaign_recipients(spark, sf_dir: str) -> DataFrame:
    """Recipients with their values in batches; lists are left to the other query, as the order of their new ids is that of hashes."""
    rows = campaigns.recipients(_chosen(spark, sf_dir).filter("kind != 'csv'"))
    return rows.withColumn("params", F.array_join("params", "|"))


@query(
    f"""WITH {_BASE} SELECT campaign_id, CASE kind WHEN 'all' THEN (SELECT count(*) FROM contacts WHERE user_id = campaign_id) WHEN 'tags' THEN (SELECT count(DISTINCT id) FROM contacts JOIN contact_tags ON id = contact_id WHERE user_id = campaign_id AND tag IN ('2-HIGH', '5-LOW')) WHEN 'csv' THEN (SELECT count(*) FROM listed WHERE user_id = campaign_id) ELSE 0 END AS n FROM camps"""
)
def campaign_reach(spark, sf_dir: str) -> DataFrame:
    return campaigns.reach(_campaigns(spark, sf_dir), _contacts(spark, sf_dir), views.contact_tags(spark, sf_dir), _lists(spark, sf_dir))
