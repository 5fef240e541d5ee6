"""Queries of step trees: paths at any depth, seeds, edits, activation checks and templates, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import trees
from murmur.plans import automation
from murmur.plans.queries import query
from murmur.sources import views

_DEEP = "WITH RECURSIVE " + automation._BASE_SQL[automation._BASE_SQL.index("ranked AS ("):automation._BASE_SQL.index(",\n  s0 AS")]


def _walk(name: str, source: str) -> str:
    return f"""{name} AS (SELECT id, automation_id, parent_id, branch, position, kind, 'steps[' || position || ']' AS path, 0 AS depth FROM {source} WHERE parent_id = -1
    UNION ALL SELECT s.id, s.automation_id, s.parent_id, s.branch, s.position, s.kind, t.path || '.' || s.branch || '.steps[' || s.position || ']', t.depth + 1 FROM {source} s JOIN {name} t ON s.automation_id = t.automation_id AND s.parent_id = t.id)"""


@query(f"{_DEEP}, {_walk('paths', 'steps')} SELECT id, automation_id, path, depth FROM paths")
def deep_paths(spark, sf_dir: str) -> DataFrame:
    return trees.rooted(automation._steps(spark, sf_dir)).select("id", "automation_id", "path", "depth")


@query(
    f"""WITH RECURSIVE numbered AS (SELECT o_custkey AS automation_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS id, o_orderkey AS k FROM orders),
    seeds AS (SELECT automation_id, id, CASE WHEN id > 0 AND k % 4 <> 0 THEN k % id ELSE -1 END AS parent_id, CASE WHEN id > 0 AND k % 4 <> 0 THEN CASE k % 3 WHEN 0 THEN 'no' ELSE 'yes' END ELSE '' END AS branch, CASE WHEN k % 5 < 3 THEN 'condition' ELSE 'add_tag' END AS kind FROM numbered),
    placed AS (SELECT *, row_number() OVER (PARTITION BY automation_id, parent_id, branch ORDER BY id) - 1 AS position FROM seeds),
    tree AS (SELECT *, 'steps[' || position || ']' AS path FROM placed WHERE parent_id = -1 UNION ALL SELECT p.*, t.path || '.' || p.branch || '.steps[' || p.position || ']' FROM placed p JOIN tree t ON p.automation_id = t.automation_id AND p.parent_id = t.id AND t.kind = 'condition')
    SELECT automation_id, id, parent_id, branch, position::INTEGER AS position, kind, path FROM tree"""
)
def seeded_trees(spark, sf_dir: str) -> DataFrame:
    """Orders of a customer as flat seeds, each but one in four below an earlier one."""
    from pyspark.sql.window import Window

    key, i = F.col("o_orderkey"), F.col("index")
    s = views.table(spark, sf_dir, "orders").withColumn("index", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    below = (i > 0) & (key % 4 != 0)
    s = s.select(F.col("o_custkey").alias("automation_id"), "index", F.when(below, F.try_mod(key, i)).alias("parent_index"), F.when(below & (key % 3 == 0), "no").when(below & (key % 3 == 1), "yes").alias("branch"), F.when(key % 5 < 3, "condition").otherwise("add_tag").alias("kind"))
    return trees.seeds_to_steps(s).select("automation_id", "id", "parent_id", "branch", "position", "kind", "path")


#: Edits by remainder of the rule: (seq, op, path, by).
EDITS = [
    (0, 1, "insert", "steps[0].yes.steps[0]", 0), (0, 2, "move", "steps[0]", 1), (1, 1, "remove", "steps[0].no.steps[0]", 0), (1, 2, "insert", "steps[9]", 0), (2, 1, "move", "steps[0].yes.steps[1]", -1), (2, 2, "remove", "steps[1]", 0),
    (3, 1, "remove", "steps[0]", 0), (4, 1, "move", "steps[1]", -1), (4, 2, "insert", "steps[1].no.steps[0]", 0), (4, 3, "move", "steps[0]", -1),
]


def _round(i: int, source: str) -> str:
    """SQL of the i-th edit of each tree."""
    return f"""{_walk(f'w{i}', source)},
    e{i} AS (SELECT automation_id, op, path, dir, new_id, regexp_extract(path, '^(.*)\\.(yes|no)\\.steps.[0-9]+.$', 1) AS up, regexp_extract(path, '^(.*)\\.(yes|no)\\.steps.[0-9]+.$', 2) AS branch, regexp_extract(path, '([0-9]+).$', 1)::INTEGER AS index FROM edits WHERE seq = {i}),
    r{i} AS (SELECT e.*, CASE WHEN up = '' THEN -1 ELSE w.id END AS parent_id FROM e{i} e LEFT JOIN w{i} w ON w.automation_id = e.automation_id AND w.path = up AND w.kind = 'condition' WHERE up = '' OR w.id IS NOT NULL),
    m{i} AS (SELECT w.*, r.index AS ri, CASE WHEN r.op = 'move' AND r.index < n AND r.index + r.dir BETWEEN 0 AND n - 1 THEN r.index + r.dir END AS goes FROM (SELECT *, count(*) OVER (PARTITION BY automation_id, parent_id, branch) AS n FROM w{i}) w LEFT JOIN r{i} r USING (automation_id, parent_id, branch)),
    k{i} AS (SELECT m.id, m.automation_id, m.parent_id, m.branch, m.kind, CASE WHEN goes IS NULL THEN position WHEN position = ri THEN goes WHEN position = goes THEN ri ELSE position END::DOUBLE AS place FROM m{i} m LEFT JOIN (SELECT automation_id, path AS gone FROM r{i} WHERE op = 'remove') g USING (automation_id) WHERE gone IS NULL OR NOT (path = gone OR starts_with(path, gone || '.'))
      UNION ALL SELECT new_id, automation_id, parent_id, branch, 'add_tag', index - 0.5 FROM r{i} WHERE op = 'insert'),
    t{i} AS (SELECT id, automation_id, parent_id, branch, kind, row_number() OVER (PARTITION BY automation_id, parent_id, branch ORDER BY place, id) - 1 AS position FROM k{i})"""


_EDIT_ROWS = ", ".join(f"({r}, {s}, '{o}', '{p}', {b})" for r, s, o, p, b in EDITS)


@query(
    f"""{_DEEP}, edits AS (SELECT c_custkey AS automation_id, seq, op, path, dir, -c_custkey * 10 - seq - 10 AS new_id FROM customer JOIN (VALUES {_EDIT_ROWS}) v(rest, seq, op, path, dir) ON c_custkey % 5 = rest),
    {_round(1, 'steps')}, {_round(2, 't1')}, {_round(3, 't2')} SELECT id, automation_id, parent_id, branch, position::INTEGER AS position, kind FROM t3"""
)
def edited_trees(spark, sf_dir: str) -> DataFrame:
    """Up to three edits of each rule's tree: inserts, removals of whole branches, and moves."""
    key = F.col("c_custkey")
    cases = F.array(*[F.struct(F.lit(r).alias("rest"), F.lit(s).alias("seq"), F.lit(o).alias("op"), F.lit(p).alias("path"), F.lit(b).alias("by")) for r, s, o, p, b in EDITS])
    e = views.table(spark, sf_dir, "customer").select(key.alias("automation_id"), F.explode(F.filter(cases, lambda c: c["rest"] == key % 5)).alias("e")).select("automation_id", "e.seq", "e.op", "e.path", "e.by")
    e = e.withColumns({"new_id": -F.col("automation_id") * 10 - F.col("seq") - 10, "kind": F.lit("add_tag")})
    s = automation._steps(spark, sf_dir).select("id", "automation_id", "parent_id", "branch", "position", "kind")
    return trees.edit_trees(s, e)


@query(
    f"""{_DEEP}, {_walk('paths', 'steps')}, checked AS (SELECT p.automation_id, p.path, unnest([
      CASE WHEN p.kind = 'send_message' AND p.id % 11 = 0 THEN '.text|needs a text' END, CASE WHEN p.kind = 'send_template' AND p.id % 8 = 1 THEN '.template_name|needs a template' END, CASE WHEN p.kind IN ('add_tag', 'remove_tag') AND tag IS NULL THEN '.tag_id|needs a tag' END,
      CASE WHEN p.kind = 'assign_conversation' AND p.id % 3 <> 0 AND agent IS NULL THEN '.agent_id|needs an agent' END, CASE WHEN p.kind = 'update_contact_field' AND NOT filled THEN '.value|needs a value' END,
      CASE WHEN p.kind = 'create_deal' AND p.id % 6 = 0 THEN '.pipeline_id|needs a pipeline' END, CASE WHEN p.kind = 'create_deal' AND stage IS NULL THEN '.stage_id|needs a stage' END, CASE WHEN p.kind = 'create_deal' AND p.id % 11 = 0 THEN '.title|needs a title' END,
      CASE WHEN p.kind = 'wait' AND amount = 0 THEN '.amount|needs a positive amount' END, CASE WHEN p.kind = 'condition' AND p.id % 4 = 2 THEN '.operand|needs an operand' END, CASE WHEN p.kind = 'send_webhook' AND NOT addressed THEN '.url|needs an address' END,
      CASE WHEN p.kind = 'close_conversation' AND p.id % 20 = 8 THEN '|is of an unknown kind' END]) AS issue FROM paths p JOIN steps s ON s.id = p.id)
    SELECT automation_id, path || split_part(issue, '|', 1) AS path, split_part(issue, '|', 2) AS message FROM checked WHERE issue IS NOT NULL
    UNION ALL SELECT c_custkey, 'steps', 'needs at least one step' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def activation_issues(spark, sf_dir: str) -> DataFrame:
    """All checks of steps, over trees of any depth; rules without steps have an issue of their own."""
    i = F.col("id")
    s = automation._steps(spark, sf_dir).withColumns({"pipeline": F.when(i % 6 != 0, "main"), "kind": F.when((F.col("kind") == "close_conversation") & (i % 20 == 8), "shrug").otherwise(F.col("kind"))})
    return trees.activation_issues(trees.rooted(s), automation._automations(spark, sf_dir))


@query(
    """SELECT c_custkey AS id, slug, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN bare AND known THEN 'Template ' || slug END) AS name, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'tag_added' END, CASE WHEN bare AND known THEN 'on_' || slug END) AS trigger,
    CASE WHEN bare AND known THEN 'wait,' || slug WHEN c_custkey % 7 = 0 THEN 'own' ELSE '' END AS steps,
    coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN bare AND known THEN slug END, '') <> '' AND coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'x' END, CASE WHEN bare AND known THEN slug END, '') <> '' AS accepted
    FROM (SELECT *, c_mktsegment AS slug, c_custkey % 7 <> 0 AS bare, c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AS known FROM customer)"""
)
def rules_from_templates(spark, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    none = F.array().cast("array<string>")
    c = views.table(spark, sf_dir, "customer")
    wanted = c.select(key.alias("id"), F.col("c_mktsegment").alias("slug"), F.when(key % 3 == 0, F.col("c_name")).alias("name"), F.when(key % 4 == 0, "tag_added").alias("trigger"), F.when(key % 7 == 0, F.array(F.lit("own"))).when(key % 2 == 0, none).alias("steps"))
    kinds = c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE")).select(F.col("c_mktsegment").alias("slug")).distinct()
    known = kinds.select("slug", F.concat(F.lit("Template "), "slug").alias("name"), F.concat(F.lit("on_"), "slug").alias("trigger"), F.array(F.lit("wait"), F.col("slug")).alias("steps"))
    return trees.expand_templates(wanted, known, ["name", "trigger"]).withColumn("steps", F.array_join(F.coalesce("steps", none), ","))
