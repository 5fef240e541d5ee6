"""Many campaigns at once: audiences of every kind, values of their variables, and recipients in batches.

A campaign is a row: its tenant, the kind of its audience with what that kind needs, tags to leave out, and a map of variables.
Contacts carry their tags and fields as an array and a map, so that one join by tenant decides for every kind.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.phone import digits, is_e164
from murmur.functions.text import numbered_first
from murmur.operators.lineage import placed

CAMPAIGN = ("campaign_id", "user_id", "kind", "tags", "field", "operator", "value", "excluded", "variables")


def profiled(contacts: DataFrame, contact_tags: DataFrame, values: DataFrame) -> DataFrame:
    """contacts with tags (array) and fields (map) of each; both are as long as a tenant has tags and fields."""
    tags = contact_tags.groupBy(F.col("contact_id").alias("id")).agg(F.collect_set("tag").alias("tags_of"))
    fields = values.groupBy(F.col("contact_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("value", F.lit(""))))).alias("fields_of"))
    return contacts.join(tags, "id", "left").join(fields, "id", "left")


def with_imports(contacts: DataFrame, imported: DataFrame) -> DataFrame:
    """contacts and, marked as imported, those that the lists (campaign_id, user_id, ord, phone, name) of campaigns bring: a new number of a tenant makes one contact.

    Its name is that of the last line it stands on. New ids are hashes of tenant and number, so that a repeated import makes the same rows.
    """
    lines = imported.filter(F.coalesce("phone", F.lit("")) != "").groupBy("user_id", "phone").agg(F.max_by("name", F.struct("campaign_id", "ord")).alias("name"))
    new = lines.join(contacts.select("user_id", "phone"), ["user_id", "phone"], "left_anti").withColumn("id", -F.abs(F.xxhash64("user_id", "phone")))
    return contacts.withColumn("imported", F.lit(False)).unionByName(new.select("id", "user_id", "name", "phone", F.lit(True).alias("imported")), allowMissingColumns=True)


def audiences(campaigns: DataFrame, profiles: DataFrame, imported: DataFrame) -> DataFrame:
    """CAMPAIGN rows and contacts of ``profiled`` -> a row a campaign and contact it goes to, with all columns of both.

    all, tags (any of them), custom_field (is, is_not of those that have it, contains with wildcards) and csv (the numbers of its list
    as they are written). Tags to leave out hold for every kind; a campaign without its settings, or of another kind, goes to nobody.
    Contacts that lists bring (imported) are only there for lists.
    """
    listed = imported.select("campaign_id", "user_id", "phone").distinct().withColumn("__listed", F.lit(True))
    pairs = campaigns.join(profiles, "user_id").join(listed, ["campaign_id", "user_id", "phone"], "left")
    held = F.try_element_at("fields_of", F.col("field"))
    field = F.when(F.col("operator") == "is", held == F.col("value")).when(F.col("operator") == "is_not", held != F.col("value")).when(F.col("operator") == "contains", F.ilike(held, F.concat(F.lit("%"), "value", F.lit("%"))))
    kind = F.col("kind")
    goes = F.when(kind == "all", True).when(kind == "tags", F.arrays_overlap("tags", "tags_of")).when(kind == "custom_field", field).when(kind == "csv", F.col("__listed"))
    out = F.coalesce(F.arrays_overlap("excluded", "tags_of"), F.lit(False))
    return pairs.filter(F.coalesce(goes, F.lit(False)) & ~out & ((kind == "csv") | ~F.col("imported"))).drop("__listed", "imported")


def reach(campaigns: DataFrame, contacts: DataFrame, contact_tags: DataFrame, imported: DataFrame) -> DataFrame:
    """(campaign_id, n) as the last step of the wizard counts: tags to leave out do not matter, lists count lines, fields count nobody."""
    everybody = contacts.groupBy("user_id").agg(F.count("*").alias("n_all"))
    owners = contacts.select(F.col("id").alias("contact_id"), "user_id")
    wanted = campaigns.filter("kind = 'tags'").select("campaign_id", "user_id", F.explode("tags").alias("tag"))
    tagged = wanted.join(contact_tags.join(owners, "contact_id"), ["user_id", "tag"]).groupBy("campaign_id").agg(F.countDistinct("contact_id").alias("n_tags"))
    lines = imported.groupBy("campaign_id").agg(F.count("*").alias("n_lines"))
    rows = campaigns.join(everybody, "user_id", "left").join(tagged, "campaign_id", "left").join(lines, "campaign_id", "left")
    return rows.select("campaign_id", F.coalesce(F.when(F.col("kind") == "all", F.col("n_all")).when(F.col("kind") == "tags", F.col("n_tags")).when(F.col("kind") == "csv", F.col("n_lines")), F.lit(0)).alias("n"))


def parameters(variables: Column, contact: Column, fields: Column) -> Column:
    """A map of name to (type, value) -> the values in order, numbers first: given ones, fields of the contact (a map) or custom ones; none is empty."""

    def one(e: Column) -> Column:
        kind, value = e["value"]["type"], e["value"]["value"]
        return F.coalesce(F.when(kind == "static", value).when(kind == "field", F.try_element_at(contact, value)).otherwise(F.try_element_at(fields, value)), F.lit(""))

    return F.coalesce(F.transform(numbered_first(F.map_entries(variables)), one), F.array().cast("array<string>"))


def recipients(chosen: DataFrame, size: int = 10) -> DataFrame:
    """Rows of ``audiences`` -> (campaign_id, contact_id, phone, params, valid, batch): batches are numbered within a campaign, in the order of contacts."""
    contact = F.create_map(*[x for c in ("name", "phone", "email", "company") if c in chosen.columns for x in (F.lit(c), F.col(c))])
    rows = chosen.select("campaign_id", F.col("id").alias("contact_id"), digits(F.col("phone")).alias("phone"), is_e164(digits(F.col("phone"))).alias("valid"), parameters(F.col("variables"), contact, F.col("fields_of")).alias("params"))
    return placed(rows, "campaign_id", "contact_id").withColumn("batch", F.floor(F.col("ordinal") / size)).drop("ordinal")
