"""Message templates: pages of a provider's list, normal forms, synchronisation, and what a draft still lacks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "data array<struct<name:string,language:string,category:string,status:string,components:array<struct<type:string,format:string,text:string>>>>, paging struct<next:string>"
# The provider's states and categories, and those stored.
CATEGORIES = {"UTILITY": "Utility", "AUTHENTICATION": "Authentication"}
STATES = {"APPROVED": "Approved", "PENDING": "Pending", "IN_APPEAL": "Pending", "PENDING_DELETION": "Pending", "REJECTED": "Rejected", "DISABLED": "Rejected", "PAUSED": "Rejected"}


def looked_up(value: Column, names: dict[str, str], default: str) -> Column:
    """names[value in capitals], or the default for unknown values and null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.upper(value)), F.lit(default))


def parse_pages(pages: DataFrame, most: int = 20) -> DataFrame:
    """(page, body) rows as they were fetched -> the templates of the first pages in their order; page numbers begin with 1."""
    t = pages.filter(F.col("page") <= most).select("page", F.from_json("body", SCHEMA).alias("b")).select("page", F.posexplode("b.data").alias("place", "t"))
    part = lambda kind: F.get(F.filter("t.components", lambda c: c["type"] == kind), F.lit(0))
    return t.select(
        "page", "place", "t.name", "t.language", looked_up(F.col("t.category"), CATEGORIES, "Marketing").alias("category"), looked_up(F.col("t.status"), STATES, "Draft").alias("status"),
        F.lower(part("HEADER")["format"]).alias("header_type"), part("HEADER")["text"].alias("header_content"), F.coalesce(part("BODY")["text"], F.lit("")).alias("body_text"), part("FOOTER")["text"].alias("footer_text"),
    )


def sync_totals(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """How many templates are new, how many are known by name and language, and how many match several stored ones (errors).

    A template that comes twice is new once and known from then on, as rows are written one after the other.
    """
    known = stored.groupBy("name", "language").agg(F.count("*").alias("n"))
    once = parsed.groupBy("name", "language").agg(F.count("*").alias("times")).join(known, ["name", "language"], "left")
    n = F.coalesce("n", F.lit(0))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return once.agg(count(F.col("times")).alias("total"), count(F.when(n == 0, 1)).alias("inserted"), count(F.when(n == 0, F.col("times") - 1).when(n == 1, F.col("times"))).alias("updated"), count(F.when(n > 1, F.col("times"))).alias("errors"))


def marks(body: Column) -> Column:
    """Distinct placeholders as written, in the order of their text (``{{10}}`` before ``{{2}}``)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(r"(\{\{\d+\}\})"), F.lit(1))))


def unmapped(body: Column, variables: Column) -> Column:
    """Placeholders without a filled value in the map of number to value."""
    value = lambda mark: F.coalesce(F.trim(F.try_element_at(variables, F.regexp_extract(mark, r"\d+", 0))), F.lit(""))
    return F.filter(marks(body), lambda mark: value(mark) == "")


def draft_preview(body: Column, variables: Column) -> Column:
    """Placeholders replaced one after the other in the order of ``marks``, so what a value brings can be replaced again; unmapped ones stay."""
    value = lambda mark: F.coalesce(F.nullif(F.try_element_at(variables, F.regexp_extract(mark, r"\d+", 0)), F.lit("")), mark)
    return F.aggregate(marks(body), body, lambda text, mark: F.replace(text, mark, value(mark)))


def broadcast_preview(body: Column, variables: Column, contact: Column, fields: Column) -> Column:
    """A broadcast's text for one contact: placeholders replaced one after the other in the order of ``marks``.

    variables maps a number to (type, value): a given value, a field of the contact (a map), where only null falls back, or a custom
    field, where empty does too; without a value the placeholder stays. In a value ``$$`` is a dollar and ``$&`` the placeholder, as
    the product's editor replaces; what a value brings can be replaced again.
    """

    def value(mark: Column, v: Column, given: Column) -> Column:
        name = F.nullif(v["value"], F.lit(""))
        found = F.when(v["type"] == "static", name).when(v["type"] == "field", F.try_element_at(given["contact"], name)).when(v["type"] == "custom_field", F.nullif(F.try_element_at(given["fields"], name), F.lit("")))
        return F.coalesce(found, mark)

    def unfolded(text: Column, mark: Column) -> Column:
        signs = F.transform(F.regexp_extract_all(text, F.lit(r"(\$[$&])"), F.lit(1)), lambda s: F.when(s == "$$", "$").otherwise(mark))
        joined = F.array_join(F.zip_with(F.split(text, r"\$[$&]", -1), signs, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
        return F.when(F.contains(text, F.lit("$")), joined).otherwise(text)

    def texts(given: Column) -> Column:
        found = F.transform(marks(body), lambda mark: F.struct(mark.alias("mark"), F.try_element_at(given["variables"], F.regexp_extract(mark, r"\d+", 0)).alias("v")))
        return F.transform(found, lambda p: F.struct(p["mark"].alias("mark"), value(p["mark"], p["v"], given).alias("text")))

    # in a lambda an expression is computed at each of its uses, so the maps, what they hold and the values are elements of arrays
    once = F.array(F.struct(variables.alias("variables"), contact.alias("contact"), fields.alias("fields")))
    return F.aggregate(F.get(F.transform(once, texts), F.lit(0)), body, lambda text, p: F.replace(text, p["mark"], unfolded(p["text"], p["mark"])))
