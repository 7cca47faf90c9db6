"""Dates as people write them, to timestamps that lie in the past."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_date

MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DAY = "(sun|mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?)(?:day)?"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
CLOCK = r"(?:^|[ t])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.][0-9]+)?)? ?(am|pm)?(?: ?(?:utc|gmt|z))?$"
HOUR = r"(?:^| )([0-9]{1,2}) ?(am|pm)$"
UNITS = {"year": "year", "month": "month", "fortnight": "2 week", "week": "week", "day": "day", "hour": "hour", "minute": "minute", "min": "minute", "second": "second"}


def _tidy(text: Column) -> Column:
    """Lower case, without commas, ordinal ends, dots of abbreviations and little words."""
    out = F.regexp_replace(F.lower(text), r"\b([ap])[.]?m[.]?(?=$|[ ,])", "$1m")
    for pattern, to in ((rf"\b{MONTH}[.]", "$1"), (r"[,\n\t]", " "), (r"\b([0-9]+)(st|nd|rd|th)\b", "$1"), (r"\b(at|on|the|of|posted|about)\b", " "), (r"\bnoon$", "12:00"), (r"\bmidnight$", "0:00"), (" +", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))


def natural_date(text: Column, now: Column) -> Column:
    """A timestamp, or null where the text is no date.

    What parse_date reads, and in any letter case: days with month names in either order, with a weekday before them or
    not; numbers with slashes (month first, unless it can't be); a month, a year, or both (their start); days without year
    and weekdays (the last that lie before now), today, yesterday, the day before yesterday; last or this week (from
    Sunday), month or year (their start); so many years to seconds ago; a time of day behind any day, or alone (the last)."""
    bound = F.transform(F.array(_tidy(text)), lambda s: _read(s, now))[0]  # bound by a function, as it stands in many places
    return F.coalesce(parse_date(text), bound)


def _read(s: Column, now: Column) -> Column:
    part = lambda pattern, k, has: F.when(s.contains(has), F.regexp_extract(s, pattern, k)).otherwise("")
    whole, hour = part(CLOCK, 1, ":"), part(HOUR, 1, "m")
    half = F.coalesce(F.nullif(part(CLOCK, 4, ":"), F.lit("")), F.when(whole == "", part(HOUR, 2, "m")), F.lit(""))
    rest = F.when(s.contains(":"), F.regexp_replace(s, CLOCK, "")).otherwise(s)
    date = F.regexp_replace(F.trim(F.when(s.contains("m"), F.regexp_replace(rest, HOUR, "")).otherwise(rest)), rf"^{DAY} (?=[0-9a-z])", "")
    parts = F.struct(date.alias("date"), F.coalesce(F.nullif(whole, F.lit("")), hour).alias("hour"), part(CLOCK, 2, ":").alias("minute"), part(CLOCK, 3, ":").alias("second"), half.alias("half"))

    def timed(x: Column) -> Column:
        h, half = x["hour"].try_cast("int"), x["half"]
        minute, second = F.coalesce(x["minute"].try_cast("int"), F.lit(0)), F.coalesce(x["second"].try_cast("int"), F.lit(0))
        valid = F.when(half != "", h.between(1, 12)).otherwise(h <= 23) & (minute <= 59) & (second <= 59)
        seconds = F.when(x["hour"] == "", 0).when(valid, (F.when(half == "", h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))) * 3600 + minute * 60 + second)
        return F.struct(x["date"].alias("date"), seconds.alias("seconds"), (x["hour"] != "").alias("timed"))

    return F.transform(F.transform(F.array(parts), timed), lambda x: _resolved(x["date"], x["seconds"], x["timed"], now))[0]


def _resolved(date: Column, seconds: Column, timed: Column, now: Column) -> Column:
    """The time that a tidy date and a time of day, in seconds, stand for; null seconds are no time."""
    part = lambda c, pattern, k: F.regexp_extract(c, pattern, k)
    today, year = F.date_trunc("day", now), F.year(now)
    month_of = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(name, 1, 3)).cast("int")
    number = lambda pattern, k: part(date, pattern, k).try_cast("int")
    back = lambda n: today - F.make_interval(days=n)

    def last_of(month: Column, day: Column) -> Column:
        return F.coalesce(*[F.when(d <= now, d) for d in (_date(year - k, month, day) for k in range(5))])

    def full_year(y: Column) -> Column:
        return F.when(y >= 100, y).otherwise(y + F.when(y <= year % 100, F.floor(year / 100) * 100).otherwise(F.floor(year / 100) * 100 - 100))

    iso, slashes = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$", r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4}|[0-9]{2})$"
    mdy, dmy, ymd = rf"^{MONTH} ([0-9]{{1,2}}) ([0-9]{{4}})$", rf"^([0-9]{{1,2}})[ -]{MONTH}[ -]([0-9]{{4}})$", rf"^([0-9]{{4}}) {MONTH} ([0-9]{{1,2}})$"
    md, dm, my, m, y = rf"^{MONTH} ([0-9]{{1,2}})$", rf"^([0-9]{{1,2}}) {MONTH}$", rf"^{MONTH} ([0-9]{{4}})$", rf"^(?:last |in |this )?{MONTH}$", "^(?:in )?([12][0-9]{3})$"
    weekday, span, ago = rf"^(?:last |this )?{DAY}$", "^(last|this) (week|month|year)$", rf"^(an?|[0-9]+) ({'|'.join(UNITS)})s? ago$"
    first, second_number = number(slashes, 1), number(slashes, 2)
    days_back = (F.dayofweek(now) - 1 - (F.array_position(F.array(*map(F.lit, DAYS)), F.substring(part(date, weekday, 1), 1, 3)).cast("int") - 1) + 7) % 7
    unit = F.when(part(date, span, 2) == "week", back(F.dayofweek(now) - 1)).when(part(date, span, 2) == "month", F.date_trunc("month", now)).otherwise(F.date_trunc("year", now))
    before = F.when(part(date, span, 2) == "week", F.make_interval(days=F.lit(7))).when(part(date, span, 2) == "month", F.make_interval(months=F.lit(1))).otherwise(F.make_interval(years=F.lit(1)))
    n = F.when(part(date, ago, 1).isin("a", "an"), 1).otherwise(number(ago, 1))
    day = (
        F.when(date.rlike(iso), _date(number(iso, 1), number(iso, 2), number(iso, 3)))
        .when(date.rlike(slashes), F.when(first > 12, _date(full_year(number(slashes, 3)), second_number, first)).otherwise(_date(full_year(number(slashes, 3)), first, second_number)))
        .when(date.rlike(mdy), _date(number(mdy, 3), month_of(part(date, mdy, 1)), number(mdy, 2)))
        .when(date.rlike(dmy), _date(number(dmy, 3), month_of(part(date, dmy, 2)), number(dmy, 1)))
        .when(date.rlike(ymd), _date(number(ymd, 1), month_of(part(date, ymd, 2)), number(ymd, 3)))
        .when(date.rlike(md), last_of(month_of(part(date, md, 1)), number(md, 2)))
        .when(date.rlike(dm), last_of(month_of(part(date, dm, 2)), number(dm, 1)))
        .when(date.rlike(my), _date(number(my, 2), month_of(part(date, my, 1)), F.lit(1)))
        .when(date.rlike(m), last_of(month_of(part(date, m, 1)), F.lit(1)))
        .when(date.rlike(y) & ~timed, _date(number(y, 1), F.lit(1), F.lit(1)))
        .when(date.rlike(weekday), back(F.when(days_back == 0, 7).otherwise(days_back)))
        .when(date == "today", today).when(date == "yesterday", back(F.lit(1))).when(date == "day before yesterday", back(F.lit(2)))
        .when(date.rlike(span) & ~timed, F.when(part(date, span, 1) == "this", unit).otherwise(unit - before))
        .when((date == "") & timed, F.when(today + F.make_interval(secs=seconds.cast("double")) <= now, today).otherwise(back(F.lit(1))))
    )
    counted = F.lit(None).cast("timestamp")
    for name, what in UNITS.items():
        times = 2 if what.startswith("2 ") else 1
        field = {"year": "years", "month": "months", "week": "weeks", "day": "days", "hour": "hours", "minute": "mins"}.get(what.split(" ")[-1])
        step = F.make_interval(**{field: n * times}) if field else F.make_interval(secs=n.cast("double"))
        counted = F.when(part(date, ago, 2) == name, now - step).otherwise(counted)
    counted = F.when(date == "now", now).when(date.contains(" ago") & ~timed, counted)
    return F.coalesce(counted, day + F.make_interval(secs=seconds.cast("double")))
