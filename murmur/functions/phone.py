"""Phone numbers as columns: digits, validity, the key that fuzzy matches share, dialling variants."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(phone: Column) -> Column:
    """Digits only; null is empty."""
    return F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")


def is_e164(phone: Column) -> Column:
    return F.coalesce(phone, F.lit("")).rlike(r"^\+?[1-9][0-9]{6,14}$")


def match_key(phone: Column) -> Column:
    """Numbers match when equal, or when both have 8 digits or more and the last 8 agree: an equi-join on this key.

    Shorter numbers keep all their digits, so a short key equals no long one. Numbers without digits match nothing.
    """
    d = digits(phone)
    return F.when(F.length(d) >= 8, F.right(d, F.lit(8))).when(F.length(d) > 0, d)


def variants(sanitized: Column) -> Column:
    """The number, then with a trunk zero after a country code of 1, 2 or 3 digits, then without one, each once."""
    n = F.length(sanitized)
    rest = lambda cc: F.substring(sanitized, cc + 1, 40)
    zero = lambda cc: rest(cc).startswith("0")
    added = [F.when((n > cc) & ~zero(cc), F.concat(F.substring(sanitized, 1, cc), F.lit("0"), rest(cc))) for cc in (1, 2, 3)]
    dropped = [F.when((n > cc + 1) & zero(cc), F.concat(F.substring(sanitized, 1, cc), F.substring(sanitized, cc + 2, 40))) for cc in (1, 2, 3)]
    return F.array_distinct(F.filter(F.array(F.when(n > 0, sanitized), *added, *dropped), lambda x: x.isNotNull()))


def is_not_allowed_error(message: Column) -> Column:
    return F.coalesce(message, F.lit("")).rlike("(?i)131030|not in (the )?allowed list")
