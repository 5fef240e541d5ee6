"""Days, weeks and spans of time; the clock is always a parameter."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def monday_index(ts: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(ts)


def day_spine(spark, last_day: str, days: int) -> DataFrame:
    """The days that end with last_day, one row each."""
    last = F.to_date(F.lit(last_day))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def wait_ms(amount: Column, unit: Column) -> Column:
    """At least a second; an unknown unit is minutes."""
    scale = F.when(unit == "hours", 3_600_000).when(unit == "days", 86_400_000).otherwise(60_000)
    return F.greatest(F.lit(1000), amount * scale).cast("long")


def within_day(ts: Column, window: str) -> Column:
    """``HH:mm-HH:mm``, half open, over midnight if the end is earlier; equal ends hold nothing."""
    begin, end = (int(x[:2]) * 60 + int(x[3:]) for x in window.split("-"))
    minute = F.hour(ts) * 60 + F.minute(ts)
    if begin <= end:
        return (minute >= begin) & (minute < end)
    return (minute >= begin) | (minute < end)


def within_window(ts: Column, window: Column) -> Column:
    """As ``within_day`` for windows that differ by row; parts that are no numbers are 0, a window without both ends holds nothing."""
    part = lambda i: F.get(F.split(window, "-"), F.lit(i))
    number = lambda x: F.coalesce(F.trim(x).try_cast("int"), F.lit(0))
    minutes = lambda x: number(F.get(F.split(x, ":"), F.lit(0))) * 60 + number(F.get(F.split(x, ":"), F.lit(1)))
    begin, end, now = minutes(part(0)), minutes(part(1)), F.hour(ts) * 60 + F.minute(ts)
    inside = F.when(begin <= end, (now >= begin) & (now < end)).otherwise((now >= begin) | (now < end))
    return F.coalesce((part(0) != "") & (part(1) != "") & inside, F.lit(False))


def ago(seconds: Column) -> Column:
    """Short age of an entry: 5s, 3m, 2h, 4d."""
    s = F.greatest(F.lit(1), F.floor(seconds + F.lit(0.5)))
    cut = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, cut(1, "s")).when(s < 3600, cut(60, "m")).when(s < 86400, cut(3600, "h")).otherwise(cut(86400, "d"))


def since(then: Column, now: Column) -> Column:
    """How long ago, in words of a list of rules; a date from 30 days on, "never" without one."""
    s = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1_000_000 + F.lit(0.5))
    cut = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    words = F.when(s < 60, "just now").when(s < 3600, cut(60, "m")).when(s < 86400, cut(3600, "h")).when(s < 2_592_000, cut(86400, "d")).otherwise(F.date_format(then, "yyyy-MM-dd"))
    return F.coalesce(words, F.lit("never"))


def day_label(day: Column, today: Column) -> Column:
    """What a list of messages calls a day: Today, Yesterday, or the date in words."""
    ago = F.datediff(today, day)
    return F.when(ago == 0, "Today").when(ago == 1, "Yesterday").otherwise(F.date_format(day, "MMMM d, yyyy"))


def duration(minutes: Column) -> Column:
    """Seconds below a minute, minutes below an hour, else hours with one decimal."""
    half_up = lambda x: F.floor(x + F.lit(0.5))
    return F.when(minutes < 1, F.concat(half_up(minutes * 60).cast("string"), F.lit("s"))).when(minutes < 60, F.concat(half_up(minutes).cast("string"), F.lit("m"))).otherwise(F.concat((half_up(minutes / 6) / 10).cast("decimal(18,1)").cast("string"), F.lit("h")))
