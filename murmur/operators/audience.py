"""Audiences and broadcasts: who is written to, and with which values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions.phone import digits, is_e164
from murmur.operators.campaigns import parameters


def without_tags(contacts: DataFrame, contact_tags: DataFrame, excluded: list[str]) -> DataFrame:
    out = contact_tags.filter(F.col("tag").isin(excluded)).select(F.col("contact_id").alias("id"))
    return contacts.join(out, "id", "left_anti")


def with_any_tag(contacts: DataFrame, contact_tags: DataFrame, wanted: list[str]) -> DataFrame:
    return contacts.join(contact_tags.filter(F.col("tag").isin(wanted)).select(F.col("contact_id").alias("id")), "id", "left_semi")


def by_field(contacts: DataFrame, values: DataFrame, field: str, operator: str, value: str) -> DataFrame:
    """is, is_not (of those that have the field) or contains, where ``%`` and ``_`` of the value are wildcards."""
    test = {"is": F.col("value") == value, "is_not": F.col("value") != value, "contains": F.col("value").ilike(f"%{value}%")}[operator]
    return contacts.join(values.filter((F.col("field") == field) & test).select(F.col("contact_id").alias("id")), "id", "left_semi")


def estimates(contacts: DataFrame, contact_tags: DataFrame, wanted: list[str], excluded: list[str]) -> DataFrame:
    """Sizes as the wizard shows them: of all less the excluded, of the tags less the excluded, and of the tags alone."""
    tagged = contact_tags.groupBy("contact_id").agg(F.bool_or(F.col("tag").isin(wanted)).alias("wanted"), F.bool_or(F.col("tag").isin(excluded)).alias("excluded"))
    counts = tagged.agg(F.count_if("excluded").alias("out"), F.count_if(F.col("wanted") & ~F.col("excluded")).alias("tags_estimate"), F.count_if("wanted").alias("tags_reach"))
    total = contacts.agg(F.count("*").alias("total"))
    rows = total.select(F.lit("total").alias("name"), F.col("total").alias("n")).unionByName(counts.select(F.explode(F.map_from_arrays(F.array(F.lit("out"), F.lit("tags_estimate"), F.lit("tags_reach")), F.array("out", "tags_estimate", "tags_reach"))).alias("name", "n")))
    one = rows.groupBy().pivot("name", ["out", "tags_estimate", "tags_reach", "total"]).agg(F.first("n"))
    return one.select(F.greatest(F.lit(0), F.col("total") - F.col("out")).alias("all_estimate"), "tags_estimate", "tags_reach")


def field_index(values: DataFrame) -> DataFrame:
    """One map of field to value for each contact."""
    entry = F.struct("field", F.coalesce("value", F.lit("")))
    return values.groupBy("contact_id").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"))


def resolve(variables: dict[str, tuple[str, str]], fields: Column, contact: dict[str, Column]) -> Column:
    """array of the values of numbered variables, numbers first and in order; (static | field | custom_field, value)."""
    named = F.map_from_arrays(F.array(*map(F.lit, variables)), F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(value).alias("value")) for kind, value in variables.values()]))
    return parameters(named, F.create_map(*[x for c, v in contact.items() for x in (F.lit(c), v)]), fields)


def payloads(contacts: DataFrame, values: DataFrame, variables: dict[str, tuple[str, str]], batch: int = 10) -> DataFrame:
    """Recipients with their values and the number of their batch of ``batch``.

    Batches are filled inside ranges of ids, cut at quantiles so that scattered ids make even ranges: counts of the
    ranges before (one row a range, as many as shuffle partitions) give where each begins.
    """
    rows = contacts.join(field_index(values), contacts["id"] == F.col("contact_id"), "left")
    rows = rows.select("id", digits(F.col("phone")).alias("phone"), resolve(variables, F.col("fields"), {"name": F.col("name"), "company": F.col("company"), "phone": F.col("phone")}).alias("params"))
    parts = int(contacts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = contacts.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [1.0], F.lit(20 * parts))).first()[0] or []
    rows = rows.withColumn("range", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>"), lambda c: c < F.col("id"))))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("id")) + F.col("begins") - 1
    return rows.join(begins, "range").select("id", "phone", F.concat_ws("|", "params").alias("params"), is_e164(F.col("phone")).alias("valid"), F.floor(place / batch).alias("batch"))


def estimate(kind: str, contacts: DataFrame, contact_tags: DataFrame, excluded: list[str], base: DataFrame | None = None) -> DataFrame:
    """One row with n, as the wizard shows it: "all" is all contacts less the number of excluded ones (not below 0, without looking
    whether those are among them); "ids" is the distinct contact_id of base less the excluded; "csv" the rows of base, copies and
    excluded ones too; anything else is not set up yet and null.
    """
    out = contact_tags.filter(F.col("tag").isin(excluded)).select("contact_id").distinct()
    if kind == "all":
        each = contacts.select(F.lit(1).alias("d")).unionByName(out.select(F.lit(-1).alias("d")))
        return each.agg(F.greatest(F.lit(0), F.coalesce(F.sum("d"), F.lit(0))).cast("long").alias("n"))
    if kind == "ids":
        return base.select("contact_id").distinct().join(out, "contact_id", "left_anti").agg(F.count("*").alias("n"))
    if kind == "csv":
        return base.agg(F.count("*").alias("n"))
    return contacts.sparkSession.range(1).select(F.lit(None).cast("long").alias("n"))
