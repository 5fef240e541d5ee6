"""The CRM model over the test tables: each view as a DataFrame and, for checks, as a DuckDB subquery."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark, sf_dir: str) -> DataFrame:
    sender = F.when(F.col("event_type").isin("click", "view", "signup"), "customer").when(F.col("event_type") == "purchase", "agent").otherwise("bot")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation_id"), F.col("ts").alias("created_at"), sender.alias("sender_type"), F.col("props").alias("content_text"))


def contacts(spark, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    n = (60000000 + key % 1000).cast("string")
    phone = F.when(key % 4 == 0, F.concat(F.lit("+370 "), n)).when(key % 4 == 1, F.concat(F.lit("3700"), n)).when(key % 4 == 2, F.concat(F.lit("370-"), n)).otherwise((1000000 + key % 1000).cast("string"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company"), phone.alias("phone"))


def contact_tags(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contact_id"), F.col("o_orderpriority").alias("tag")).distinct()


def custom_values(spark, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    segment = customer.select(F.col("c_custkey").alias("contact_id"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value"))
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("contact_id"), F.lit("nation").alias("field"), F.col("n_name").alias("value"))
    return segment.unionByName(home)


def stages(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage_id")).distinct().withColumn("position", F.substring("stage_id", 1, 1).cast("int") - 1)


def deals(spark, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "P", "lost")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contact_id"), F.col("o_orderpriority").alias("stage_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("value"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))


RECIPIENT_STATUS = {"AF": "sent", "AO": "pending", "NF": "delivered", "NO": "read", "RF": "replied", "RO": "failed"}


def recipients(spark, sf_dir: str) -> DataFrame:
    flags = F.concat("l_returnflag", "l_linestatus")
    status = F.create_map(*[F.lit(x) for pair in RECIPIENT_STATUS.items() for x in pair])[flags]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("broadcast_id"), F.col("o_custkey").alias("contact_id"), status.alias("status"), F.col("l_shipdate").alias("created_at"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"))


STATUS_EVENT = {"signup": "sent", "click": "delivered", "view": "read", "purchase": "replied", "error": "failed"}


def status_events(spark, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for pair in STATUS_EVENT.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), status.alias("status"))


def thread(spark, sf_dir: str) -> DataFrame:
    sender = F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "agent").otherwise("bot")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", sender.alias("sender_type"), F.col("text").alias("content_text"))


def _cases(column: str, names: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


#: The same views for DuckDB.
SQL = {
    "messages": "SELECT event_id AS id, user_id AS conversation_id, ts AS created_at, CASE WHEN event_type IN ('click','view','signup') THEN 'customer' WHEN event_type = 'purchase' THEN 'agent' ELSE 'bot' END AS sender_type, props AS content_text FROM events",
    "contacts": "SELECT c_custkey AS id, c_nationkey AS user_id, c_name AS name, c_mktsegment AS company, CASE c_custkey % 4 WHEN 0 THEN '+370 ' || (60000000 + c_custkey % 1000) WHEN 1 THEN '3700' || (60000000 + c_custkey % 1000) WHEN 2 THEN '370-' || (60000000 + c_custkey % 1000) ELSE (1000000 + c_custkey % 1000)::VARCHAR END AS phone FROM customer",
    "contact_tags": "SELECT DISTINCT o_custkey AS contact_id, o_orderpriority AS tag FROM orders",
    "custom_values": "SELECT c_custkey AS contact_id, 'segment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "stages": "SELECT DISTINCT o_orderpriority AS stage_id, substring(o_orderpriority, 1, 1)::INTEGER - 1 AS position FROM orders",
    "deals": "SELECT o_orderkey AS id, o_custkey AS contact_id, o_orderpriority AS stage_id, o_totalprice::DECIMAL(12,2) AS value, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'won' WHEN 'P' THEN 'lost' END AS status, o_orderdate AS updated_at FROM orders",
    "recipients": f"SELECT l_suppkey AS broadcast_id, o_custkey AS contact_id, {_cases('l_returnflag || l_linestatus', RECIPIENT_STATUS)} AS status, l_shipdate AS created_at, l_orderkey AS order_id, l_partkey AS part_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "status_events": f"SELECT user_id * 100 + event_id % 100 AS key, event_id AS seq, ts AS \"at\", {_cases('event_type', STATUS_EVENT)} AS status FROM events",
    "thread": "SELECT conv_id AS conversation_id, turn, CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' ELSE 'bot' END AS sender_type, text AS content_text FROM conversations",
}


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql
