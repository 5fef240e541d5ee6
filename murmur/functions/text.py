"""Text columns: fallbacks, templates, placeholders, labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def placeholders(body: Column) -> Column:
    """Distinct numbers n of ``{{n}}``, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\{\{([0-9]+)\}\}"), F.lit(1)), lambda x: x.cast("int"))))


def render(body: Column, params: Column, keep_blank: bool = True) -> Column:
    """``{{n}}`` becomes params[n - 1]; a missing one stays, a blank one stays blank or (keep_blank False) its placeholder.

    Gaps and placeholders are joined piece by piece, so a value that holds ``{{k}}`` is not expanded again.
    """
    pattern = r"\{\{[0-9]+\}\}"
    marks = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))

    def filled(mark: Column) -> Column:
        value = F.get(params, F.regexp_extract(mark, "[0-9]+", 0).cast("int") - 1)
        return F.coalesce(value if keep_blank else F.when(F.trim(value) != "", value), mark)

    return F.array_join(F.zip_with(F.split(body, pattern, -1), F.transform(marks, filled), lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")


#: What ``interpolate`` fills.
PLACEHOLDER = r"\{\{\s*([\w.]+)\s*\}\}"


def interpolate(body: Column, message: Column, variables: Column) -> Column:
    """``{{ message.text }}`` and ``{{vars.x}}``; every other name of word characters and dots becomes empty, other braces stay."""
    pattern = PLACEHOLDER
    names = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))

    def value(name: Column) -> Column:
        parts = F.split(name, r"\.")
        space, own = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        return F.coalesce(F.when((space == "message") & (own == "text"), message).when(space == "vars", F.try_element_at(variables, own)), F.lit(""))

    return F.array_join(F.zip_with(F.split(body, pattern, -1), F.transform(names, value), lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")


def numbered_first(entries: Column) -> Column:
    """Entries (key, ...) of a map of variables in order: keys that are numbers by number, then the others by text.

    Keys of the same number (``1`` and ``1.0``) keep the order of the map. An empty key counts as 0.
    """

    def number(key: Column) -> Column:
        written = F.trim(key)
        return F.when(written == "", 0.0).when(written.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), written.try_cast("double"))

    def order(a: Column, b: Column) -> Column:
        x, y = number(a["key"]), number(b["key"])
        sign = lambda less, more: F.when(less, -1).when(more, 1).otherwise(0)
        both = x.isNotNull() & y.isNotNull()
        return F.when(both, sign(x < y, x > y)).when(x.isNotNull(), -1).when(y.isNotNull(), 1).otherwise(sign(a["key"] < b["key"], a["key"] > b["key"]))

    return F.array_sort(entries, order)


def ordered_values(variables: Column) -> Column:
    """The values of a map of variables, numbers first, as the positional parameters of a template; a null map has none, a null value is empty."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(numbered_first(F.map_entries(variables)), lambda e: F.coalesce(e["value"], F.lit(""))), none)


def initials(name: Column, most: int = 2) -> Column:
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, F.lit(1), F.lit(most)), lambda w: F.left(w, F.lit(1))), ""))


def slug(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?i)[^a-z0-9_-]+", "-"))


def csv_field(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def preview(kind: Column, text: Column) -> Column:
    """A quoted message: its text, or what kind of content it is."""
    label = F.when(kind.isin("image", "video", "document", "audio", "location", "template"), F.concat(F.lit("["), F.initcap(kind), F.lit("]")))
    return F.coalesce(F.nullif(text, F.lit("")), label, F.lit("[Message]"))


def contains_text(value: Column, term: Column) -> Column:
    """Literal, case-insensitive; null is empty."""
    return F.instr(F.lower(F.coalesce(value, F.lit(""))), F.lower(term)) > 0
