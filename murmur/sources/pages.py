"""Sources that come in pages, and tables that are polled until nothing is pending.

Pages are landed as rows: the address they were fetched from and their body. A body names the address of the next page. Chains of
many lists are followed at once, one join a page, so the loop is as long as the longest chain and never over lists.
"""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.lineage import cut

#: Pages of one list that are fetched at most; the rest of a longer or circular list is left out, and said so.
MOST = 20


def follow_pages(starts: DataFrame, pages: DataFrame, most: int = MOST, schema: str = "data array<string>, paging struct<next:string>") -> tuple[DataFrame, DataFrame]:
    """starts (list_id, url), pages (url, body) -> (list_id, page, url, b) in the order of fetching, and (list_id, pages, truncated, broken).

    b is the body by its schema. A list is truncated if a next page was named after the last one allowed, and broken if a named page was
    not there: what came before it is kept.
    """
    # bodies are parsed and written once; rounds see their links alone
    bodies = cut(pages.select("url", F.from_json("body", schema).alias("b")).withColumn("row", F.monotonically_increasing_id()))
    links = bodies.select("url", F.nullif("b.paging.next", F.lit("")).alias("next"), F.when(F.col("b").isNotNull(), F.col("row")).alias("row"))
    waiting = starts.select("list_id", "url").withColumn("page", F.lit(1))
    done = None
    for _ in range(most):
        fetched = cut(waiting.join(links, "url", "left").select("list_id", "page", "url", "row", "next"))
        done = fetched if done is None else done.unionByName(fetched)
        waiting = fetched.filter("next IS NOT NULL").select("list_id", F.col("next").alias("url"), (F.col("page") + 1).alias("page"))
        if waiting.isEmpty():
            break
    last = F.max_by(F.struct("next", F.col("row").isNull().alias("lost")), "page")
    lists = done.groupBy("list_id").agg(F.count("row").alias("pages"), last.alias("l"))
    rows = done.filter("row IS NOT NULL").join(bodies.select("row", "b"), "row").select("list_id", "page", "url", "b")
    return rows, lists.select("list_id", "pages", F.col("l.next").isNotNull().alias("truncated"), F.col("l.lost").alias("broken"))


def only_keys(rows: DataFrame, column: str, keys: DataFrame | None = None, value=None) -> DataFrame:
    """A feed, batch or stream, cut to one key or to the keys of a table before anything else looks at it."""
    if keys is not None:
        return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")
    return rows.filter(F.col(column) == value)


def poll(read: Callable[[], DataFrame], pending, seen: Callable[[DataFrame, int], None], seconds: float = 5.0, most: int | None = None) -> int:
    """Read a table every so many seconds, hand each reading on, and stop with the first in which nothing is pending; returns the readings.

    A reading decides with one row whether to go on. most bounds the readings where nobody else ends them.
    """
    n = 0
    while most is None or n < most:
        rows = read()
        settled = rows.filter(pending).isEmpty()
        seen(rows, n)
        n += 1
        if settled:
            break
        time.sleep(seconds)
    return n
