"""Contact files as the import reads them, line by line: a quote switches between inside and outside, and nothing escapes it.

That differs from Spark's CSV reader, where a doubled quote is a quote, where a quote inside a field is text, and where a quoted field
may hold line ends. Here a field is a run of characters other than commas, in which quoted stretches may hold commas; a
stretch that is not closed goes on to the end of the line. These fields are a regular language, so one built-in
expression cuts them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("phone", "name", "email", "company")
#: A comma and the field behind it, of a line with a comma put before it; possessive, so that no line takes longer than its length.
FIELD = r""",((?:[^",]++|"[^"]*+(?:"|$))*+)"""
#: White space as a browser trims it.
BLANK = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: A character that no line holds, so that Spark's reader takes each line as one column and the first as the header.
NEVER = "\u0001"


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}++|{BLANK}++$", "")


def cut_fields(line: Column) -> Column:
    """The fields of a line, without quotes of either kind and without white space around them."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), _trimmed(line)), F.lit(FIELD), F.lit(1))
    return F.transform(fields, lambda v: _trimmed(F.regexp_replace(v, "[\"']", "")))


def header_places(header: str) -> dict[str, int]:
    """Column name -> its place; names in lower case, of equal ones the first. Here quotes do not keep commas together."""
    names = [h.strip().lower().replace('"', "").replace("'", "") for h in header.split(",")]
    return {c: names.index(c) for c in COLUMNS if c in names}


def parse_contact_lines(lines: DataFrame, header: str, line: str = "value") -> DataFrame:
    """lines below a header -> the other columns and phone, name, email, company; empty is null, lines without a phone go.

    Without a phone column there are no rows; a line may have fewer or more fields than the header.
    """
    places = header_places(header)
    cell = lambda c: F.nullif(F.get(F.col("__fields"), F.lit(places[c])), F.lit("")) if c in places else F.lit(None).cast("string")
    rest = [c for c in lines.columns if c != line]
    rows = lines.withColumn("__fields", cut_fields(F.col(line))).select(*rest, *[cell(c).alias(c) for c in COLUMNS])
    return rows.filter(F.col("phone").isNotNull())


def read_contact_lines(spark, path: str) -> DataFrame:
    """(phone, name, email, company) of a file, or of files of the same header; blank lines go, the first other one is the header."""
    lines = spark.read.csv(path, header=True, sep=NEVER, quote="", escape="", maxCharsPerColumn=-1, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not lines.columns:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
    header = lines.columns[0]
    return parse_contact_lines(lines.select(F.col(f"`{header.replace('`', '``')}`").alias("value")), header)
