"""Queries of paged sources and contact files, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.plans.queries import query
from murmur.sources import views
from murmur.sources.contact_lines import parse_contact_lines
from murmur.sources.pages import follow_pages

#: Orders as pages: a customer's orders in their order, each naming the next one; every 13th customer's list leads back to its first page.
_CHAINS = """pages AS (SELECT o_custkey AS list_id, o_orderkey, o_orderpriority, row_number() OVER w AS page, coalesce(lead(o_orderkey) OVER w, CASE WHEN o_custkey % 13 = 0 THEN first_value(o_orderkey) OVER w END) AS next, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  there AS (SELECT *, min(CASE WHEN o_orderkey % 29 = 7 AND page > 1 THEN page END) OVER (PARTITION BY list_id) AS lost FROM pages)"""


def _pages(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.row_number().over(w).alias("page"), F.coalesce(F.lead("o_orderkey").over(w), F.when(F.col("o_custkey") % 13 == 0, F.first("o_orderkey").over(w))).alias("next"))
    url = lambda c: F.concat(F.lit("https://api.example.com/list?after="), F.col(c).cast("string"))
    body = F.to_json(F.struct(F.array("o_orderpriority", F.col("o_orderkey").cast("string")).alias("data"), F.struct(url("next").alias("next")).alias("paging")))
    pages = o.filter("NOT (o_orderkey % 29 = 7 AND page > 1)").select(url("o_orderkey").alias("url"), body.alias("body"))
    return o.filter("page = 1").select(F.col("o_custkey").alias("list_id"), url("o_orderkey").alias("url")), pages


@query(
    f"""WITH {_CHAINS}, ring AS (SELECT list_id, o_orderkey, page + lap * n AS page, o_orderpriority FROM there, (SELECT unnest(range(0, 20)) AS lap) WHERE (lap = 0 OR list_id % 13 = 0) AND (lost IS NULL OR lap = 0 AND page < lost))
    SELECT list_id, page, o_orderpriority || ',' || o_orderkey AS items FROM ring WHERE page <= 20"""
)
def followed_pages(spark, sf_dir: str) -> DataFrame:
    """The pages of each list, at most 20; a list that leads back to its begin is cut there as well."""
    return follow_pages(*_pages(spark, sf_dir))[0].select("list_id", F.col("page").cast("long").alias("page"), F.array_join("b.data", ",").alias("items"))


@query(
    f"""WITH {_CHAINS} SELECT list_id, CASE WHEN lost <= 20 THEN lost - 1 WHEN list_id % 13 = 0 THEN 20 ELSE least(n, 20) END AS pages, CASE WHEN lost <= 20 THEN false ELSE list_id % 13 = 0 OR n > 20 END AS truncated, coalesce(lost <= 20, false) AS broken
    FROM (SELECT list_id, max(n) AS n, max(lost) AS lost FROM there GROUP BY 1)"""
)
def page_lists(spark, sf_dir: str) -> DataFrame:
    return follow_pages(*_pages(spark, sf_dir))[1]


_LINE = """CASE c_custkey % 6 WHEN 0 THEN '"' || c_name || ', Jr",+370 ' || c_custkey || ',' || c_mktsegment WHEN 1 THEN 'A "b, ' || c_custkey || ' c,' || c_custkey WHEN 2 THEN c_name || ',''' || c_custkey || ''', x ,extra,' WHEN 3 THEN '   ' WHEN 4 THEN '""q"",1"2' || c_custkey || '"3,""' ELSE c_name || ', ' END"""


@query(
    f"""WITH cells AS (SELECT c_custkey AS id, [trim(regexp_replace(v, '["'']', '', 'g')) FOR v IN regexp_extract_all(trim({_LINE}), '(?:^|,)((?:[^",]|"[^"]*(?:"|$))*)', 1)] AS v FROM customer)
    SELECT id, v[2] AS phone, nullif(v[1], '') AS name, NULL::VARCHAR AS email, nullif(v[3], '') AS company FROM cells WHERE nullif(v[2], '') IS NOT NULL"""
)
def contact_lines(spark, sf_dir: str) -> DataFrame:
    """Customers as lines of an import with quotes in odd places."""
    key, name = F.col("c_custkey"), F.col("c_name")
    number = key.cast("string")
    cat = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    line = F.when(key % 6 == 0, cat('"', name, ', Jr",+370 ', number, ",", F.col("c_mktsegment"))).when(key % 6 == 1, cat('A "b, ', number, " c,", number)).when(key % 6 == 2, cat(name, ",'", number, "', x ,extra,")).when(key % 6 == 3, F.lit("   "))
    line = line.when(key % 6 == 4, cat('""q"",1"2', number, '"3,""')).otherwise(cat(name, ", "))
    return parse_contact_lines(views.table(spark, sf_dir, "customer").select(key.alias("id"), line.alias("value")), 'Name, "PHONE",Company')
