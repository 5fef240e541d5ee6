"""Automation rules: keyword match, conditions, step trees, validation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.lineage import dealt


def keyword_matches(text: Column, keywords: list[str], exact: bool = False, case_sensitive: bool = False) -> Column:
    """No keywords, or no text: no match."""
    if not keywords:
        return F.lit(False)
    value = F.coalesce(text, F.lit(""))
    value = value if case_sensitive else F.lower(value)
    words = [w if case_sensitive else w.lower() for w in keywords]
    tests = [F.trim(value) == w.strip() if exact else F.instr(value, w) > 0 for w in words]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return (value != "") & out


def rule_matches(text: Column, keywords: Column, match_type: Column, case_sensitive: Column) -> Column:
    """Keywords that differ by rule: any of the array is in the text or, where match_type is exact, is the text; no keywords or no text: no match."""
    value = F.coalesce(text, F.lit(""))
    exact, cased = F.coalesce(match_type == "exact", F.lit(False)), F.coalesce(case_sensitive, F.lit(False))
    met = lambda word, whole: F.when(exact, whole == word).otherwise(F.contains(whole, word))
    found = F.exists(keywords, lambda k: F.coalesce(F.when(cased, met(k, value)).otherwise(met(F.lower(k), F.lower(value))), F.lit(False)))
    return (value != "") & F.coalesce(found, F.lit(False))


def tree_paths(steps: DataFrame, depth: int) -> DataFrame:
    """(id, automation_id, parent_id, branch, position, ...) -> the same with path and depth of every step that hangs on a root (parent_id -1).

    One join a level, dealt by the number of steps; orphans are left out.
    """
    n = steps.count()
    nested = dealt(steps.filter("parent_id != -1"), n, "automation_id", "parent_id")
    level = steps.filter("parent_id = -1").withColumns({"path": F.concat(F.lit("steps["), F.col("position").cast("string"), F.lit("]")), "depth": F.lit(0)})
    out = level
    for i in range(1, depth):
        above = level.select("automation_id", F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = nested.join(dealt(above, n, "automation_id", "parent_id"), ["automation_id", "parent_id"]).withColumns({"path": F.concat("above", F.lit("."), "branch", F.lit(".steps["), F.col("position").cast("string"), F.lit("]")), "depth": F.lit(i)}).drop("above")
        out = out.unionByName(level)
    return out


def step_issues(steps: DataFrame, *keep: str) -> DataFrame:
    """(path, kind, text, tag, amount, unit, url) -> one row for each problem that keeps a rule from being switched on, with the columns to keep."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    protocol = F.try_parse_url(F.col("url"), F.lit("PROTOCOL"))
    issue = lambda bad, field, text: F.when(bad, F.struct(F.concat(F.col("path"), F.lit(field)).alias("path"), F.lit(text).alias("message")))
    kind = F.col("kind")
    checks = F.array(
        issue((kind == "send_message") & blank(F.col("text")), ".text", "needs a text"),
        issue(kind.isin("add_tag", "remove_tag") & blank(F.col("tag")), ".tag_id", "needs a tag"),
        issue((kind == "wait") & ~F.coalesce(F.col("amount") > 0, F.lit(False)), ".amount", "needs a positive amount"),
        issue((kind == "wait") & ~F.coalesce(F.col("unit").isin("minutes", "hours", "days"), F.lit(False)), ".unit", "needs minutes, hours or days"),
        issue((kind == "send_webhook") & blank(F.col("url")), ".url", "needs an address"),
        issue((kind == "send_webhook") & ~blank(F.col("url")) & protocol.isNull(), ".url", "is no address"),
        issue((kind == "send_webhook") & protocol.isNotNull() & ~protocol.isin("http", "https"), ".url", "needs http or https"),
    )
    return steps.select(*keep, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("i")).select(*keep, "i.path", "i.message")


def execution_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("automation_id").agg(F.count("*").alias("executions"), F.max("at").alias("last_executed_at"))


def trigger_issues(rules: DataFrame) -> DataFrame:
    """(id, trigger, keywords, match_type, schedule, tag) -> (id, path, message), one row for each problem of a rule's trigger."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    issue = lambda bad, field, text: F.when(bad, F.struct(F.lit(f"trigger.{field}").alias("path"), F.lit(text).alias("message")))
    kind, words = F.col("trigger"), F.col("keywords")
    none = words.isNull() | (F.size(words) == 0)
    checks = F.array(
        issue((kind == "keyword_match") & none, "keywords", "at least one keyword is required"),
        issue((kind == "keyword_match") & ~none & F.exists(words, blank), "keywords", "keywords cannot be empty strings"),
        issue((kind == "keyword_match") & ~F.coalesce(F.col("match_type").isin("exact", "contains"), F.lit(False)), "match_type", 'match type must be "exact" or "contains"'),
        issue((kind == "time_based") & blank(F.col("schedule")), "schedule", "schedule is required"),
        issue((kind == "tag_added") & blank(F.col("tag")), "tag_id", "tag is required"),
    )
    return rules.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("i")).select("id", "i.path", "i.message")


def may_activate(rules: DataFrame, issues: DataFrame) -> DataFrame:
    """Rules with the number of issues (id, ...) they have; those that are to be active and have one stay off."""
    n = issues.groupBy("id").agg(F.count("*").alias("n_issues"))
    rows = rules.join(n, "id", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
    return rows.withColumn("is_active", F.col("is_active") & (F.col("n_issues") == 0))
