"""Contact files: read with what a sloppy header allows, written with every field quoted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("phone", "name", "email", "company")


def read_contacts(spark, path: str) -> DataFrame:
    """(phone, name, email, company); quotes of both kinds go, empty is null, rows without a phone go.

    Header names are taken in lower case and in any order; without a phone column there are no rows.
    """
    raw = spark.read.csv(path, header=True, quote='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = {c.strip().strip("\"'").lower(): c for c in raw.columns}
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(f"`{named[c]}`"), "[\"']", "")), F.lit(""))
    rows = raw.select(*[(clean(c) if c in named else F.lit(None).cast("string")).alias(c) for c in COLUMNS])
    return rows.filter(F.col("phone").isNotNull())


def write_csv(rows: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled, null empty."""
    text = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    text.write.option("emptyValue", "").csv(path, header=True, quoteAll=True, escape='"')
