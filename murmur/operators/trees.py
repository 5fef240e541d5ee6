"""Step trees as tables: paths at any depth, flat seeds to trees, and edits of many trees at once.

A tree is its rows (automation_id, id, parent_id, branch, position); roots have parent -1 and the branch ''. A scope is the
rows of one parent and branch. Edits name a step by its path (``steps[0].yes.steps[2]``). Loops of the driver are over
the depth of trees and over the edits of one tree, never over trees.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.operators.lineage import cut

SCOPE = ["automation_id", "parent_id", "branch"]


def rooted(steps: DataFrame, opens: Column | None = None) -> DataFrame:
    """steps with path and depth, down to any depth; steps that hang on no root, or below one that does not open branches, are left out.

    One join a level, each level checkpointed; a cycle hangs on no root, so the loop ends.
    """
    part = F.concat(F.lit("steps["), F.col("position").cast("string"), F.lit("]"))
    # the steps are computed and written once; levels see their links alone
    steps = cut(steps.withColumn("__row", F.monotonically_increasing_id()))
    links = steps.select("__row", *SCOPE, "id", "position", (F.lit(True) if opens is None else F.coalesce(opens, F.lit(False))).alias("__opens"))
    nested = links.filter("parent_id != -1")
    level = cut(links.filter("parent_id = -1").withColumns({"path": part, "depth": F.lit(0)}))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        above = level.filter("__opens").select("automation_id", F.col("id").alias("parent_id"), F.col("path").alias("__above"))
        below = nested.join(above, ["automation_id", "parent_id"])
        level = cut(below.withColumns({"path": F.concat("__above", F.lit("."), "branch", F.lit("."), part), "depth": F.lit(depth)}).drop("__above"))
        out = out.unionByName(level)
    return steps.join(out.select("__row", "path", "depth"), "__row").drop("__row")


def seeds_to_steps(seeds: DataFrame) -> DataFrame:
    """(automation_id, index, parent_index, branch, kind, ...) flat seeds -> steps: id is the seed's index, parent_id its parent's, position its place in its scope.

    A seed with a parent and no branch hangs below yes. Only conditions have branches: seeds below other steps, or below no seed, go.
    """
    nested = F.col("parent_index").isNotNull()
    rows = seeds.withColumns({"id": F.col("index").cast("long"), "parent_id": F.coalesce("parent_index", F.lit(-1)).cast("long"), "branch": F.when(nested, F.coalesce("branch", F.lit("yes"))).otherwise("")}).drop("index", "parent_index")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("id")) - 1)
    return rooted(rows, F.col("kind") == "condition")


def _resolved(steps: DataFrame, edits: DataFrame) -> DataFrame:
    """edits with the scope they are about (parent_id, branch) and index, the place in it; those whose scope is not there go."""
    nested = r"^(.*)\.(yes|no)\.steps\[(\d+)\]$"
    within = F.col("path").rlike(nested)
    e = edits.withColumns({"__up": F.when(within, F.regexp_extract("path", nested, 1)), "branch": F.when(within, F.regexp_extract("path", nested, 2)).otherwise(""), "index": F.regexp_extract("path", r"\[(\d+)\]$", 1).cast("int")})
    parents = steps.filter("kind = 'condition'").select("automation_id", F.col("path").alias("__up"), F.col("id").alias("__parent"))
    e = e.join(parents, ["automation_id", "__up"], "left")
    return e.filter("__up IS NULL OR __parent IS NOT NULL").withColumn("parent_id", F.coalesce("__parent", F.lit(-1)).cast("long")).drop("__up", "__parent")


def _edited(steps: DataFrame, edits: DataFrame) -> DataFrame:
    """One edit a tree at most."""
    paths = rooted(steps)
    e = cut(_resolved(paths, edits))
    rows = paths.join(e.select(*SCOPE, F.col("op").alias("__op"), F.col("index").alias("__index"), F.col("by").alias("__by")), SCOPE, "left")
    size = F.count("*").over(Window.partitionBy(*SCOPE))
    rows = rows.withColumn("__to", F.when((F.col("__op") == "move") & (F.col("__index") < size) & (F.col("__index") + F.col("__by")).between(0, size - 1), F.col("__index") + F.col("__by")))
    place = F.col("position")
    swapped = F.when(place == F.col("__index"), F.col("__to")).when(place == F.col("__to"), F.col("__index"))
    rows = rows.withColumn("__place", F.coalesce(F.when(F.col("__to").isNotNull(), swapped), place).cast("double"))
    gone = e.filter("op = 'remove'").select("automation_id", F.col("path").alias("__gone"))
    left = rows.join(gone, "automation_id", "left").filter(F.col("__gone").isNull() | ~((F.col("path") == F.col("__gone")) | F.startswith("path", F.concat("__gone", F.lit("."))))).drop("__gone")
    new = e.filter("op = 'insert'").withColumns({"id": F.col("new_id").cast("long"), "__place": F.col("index") - 0.5, "position": F.col("index")})
    columns = [c for c in steps.columns]
    given = [F.col(c) if c in new.columns else F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in columns]
    both = left.select(*columns, "__place").unionByName(new.select(*given, "__place"))
    numbered = F.row_number().over(Window.partitionBy(*SCOPE).orderBy("__place", "id")) - 1
    return both.withColumn("position", numbered).select(*columns)


def edit_trees(steps: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (automation_id, seq, op, path, by, new_id, kind, ...) -> the steps after all of them, those of a tree one after the other.

    insert puts a new step before what is at its path, or at the end of the scope; its columns are those of the edit. remove
    takes a step away with all below it. move swaps a step with its neighbour (by -1 or 1), if it has one. Scopes are numbered anew. An
    edit whose path is not there changes nothing. One edit of each tree is a round; there are as many as one tree has edits.
    """
    turn = edits.withColumn("__turn", F.row_number().over(Window.partitionBy("automation_id").orderBy("seq")))
    turn = cut(turn)
    for i in range(1, (turn.agg(F.max("__turn")).first()[0] or 0) + 1):
        steps = cut(_edited(steps, turn.filter(F.col("__turn") == i).drop("__turn", "seq")))
    return steps


def activation_issues(steps: DataFrame, automations: DataFrame) -> DataFrame:
    """(automation_id, path, message): all that keeps rules from being switched on, from steps with their path; a rule without steps has an issue too."""
    kind, blank = F.col("kind"), lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    protocol = F.try_parse_url(F.col("url"), F.lit("PROTOCOL"))
    issue = lambda bad, field, text: F.when(bad, F.struct(F.concat(F.col("path"), F.lit(field)).alias("path"), F.lit(text).alias("message")))
    known = ["send_message", "send_template", "add_tag", "remove_tag", "assign_conversation", "update_contact_field", "create_deal", "wait", "condition", "send_webhook", "close_conversation"]
    checks = F.array(
        issue((kind == "send_message") & blank("text_of_step"), ".text", "needs a text"), issue((kind == "send_template") & blank("template"), ".template_name", "needs a template"),
        issue(kind.isin("add_tag", "remove_tag") & blank("tag"), ".tag_id", "needs a tag"), issue((kind == "assign_conversation") & (F.col("mode") == "specific") & blank("agent"), ".agent_id", "needs an agent"),
        issue((kind == "update_contact_field") & blank("field"), ".field", "needs a field"), issue((kind == "update_contact_field") & (F.coalesce("value", F.lit("")) == ""), ".value", "needs a value"),
        issue((kind == "create_deal") & blank("pipeline"), ".pipeline_id", "needs a pipeline"), issue((kind == "create_deal") & blank("stage"), ".stage_id", "needs a stage"), issue((kind == "create_deal") & blank("text_of_step"), ".title", "needs a title"),
        issue((kind == "wait") & ~F.coalesce(F.col("amount") > 0, F.lit(False)), ".amount", "needs a positive amount"), issue((kind == "wait") & ~F.coalesce(F.col("unit").isin("minutes", "hours", "days"), F.lit(False)), ".unit", "needs minutes, hours or days"),
        issue((kind == "condition") & blank("subject"), ".subject", "needs a subject"), issue((kind == "condition") & blank("operand"), ".operand", "needs an operand"),
        issue((kind == "send_webhook") & blank("url"), ".url", "needs an address"), issue((kind == "send_webhook") & ~blank("url") & protocol.isNull(), ".url", "is no address"), issue((kind == "send_webhook") & protocol.isNotNull() & ~protocol.isin("http", "https"), ".url", "needs http or https"),
        issue(~F.coalesce(kind.isin(known), F.lit(False)), "", "is of an unknown kind"),
    )
    found = steps.select("automation_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("i")).select("automation_id", "i.path", "i.message")
    bare = automations.select(F.col("id").alias("automation_id")).join(steps.select("automation_id"), "automation_id", "left_anti")
    return found.unionByName(bare.select("automation_id", F.lit("steps").alias("path"), F.lit("needs at least one step").alias("message")))


def expand_templates(requests: DataFrame, templates: DataFrame, fields: list[str]) -> DataFrame:
    """requests (slug, steps, fields) for new rules -> the same with what the template of the slug gives for fields left out, and its steps.

    Only a request without steps of its own takes anything from its template; accepted says whether name and trigger are there then.
    """
    t = templates.select("slug", F.col("steps").alias("__steps"), *[F.col(c).alias(f"__{c}") for c in fields])
    rows = requests.join(t, "slug", "left")
    bare = F.col("steps").isNull() | (F.size("steps") == 0)
    taken = {c: F.coalesce(F.col(c), F.when(bare, F.col(f"__{c}"))) for c in fields} | {"steps": F.when(bare & F.col("__steps").isNotNull(), F.col("__steps")).otherwise(F.col("steps"))}
    rows = rows.select(*[taken.get(c, F.col(c)).alias(c) for c in requests.columns])
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return rows.withColumn("accepted", filled("name") & filled("trigger"))
