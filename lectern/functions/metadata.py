"""Years, dates, titles and numbers from file paths; durations and sizes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import extract, strip

YEAR_SECONDS = 31536000


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(name: Column) -> Column:
    """The file name without its last extension; a leading dot is no extension."""
    n = file_name(name)
    return F.regexp_replace(n, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def year_from_name(folder: Column) -> Column:
    """A year 19xx or 20xx, else the first number of two digits (50 and up are 19xx), else null."""
    four = extract(folder, r"(19\d{2}|20\d{2})").cast("int")
    two = extract(folder, r"\b(\d{2})(?:-\d{2})?\b").cast("int")
    return F.coalesce(four, F.when(two >= 50, 1900 + two).otherwise(2000 + two))


def year_from_path(path: Column) -> Column:
    """The year of the nearest part of a path that has one, from its end."""
    years = F.transform(F.reverse(F.split(path, r"[/\\]")), year_from_name)
    return F.get(F.filter(years, lambda y: y.isNotNull()), F.lit(0))


def date_from_name(name: Column, year: Column) -> Column:
    mmdd = extract(stem(name), r"^(\d{4})(?:\D|$)")
    return F.try_to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), mmdd), "yyyyMMdd")


def title_from_name(name: Column) -> Column:
    s = stem(name)
    rest = extract(s, r"^\d{4}[_\- ]*(.*)$")
    return F.coalesce(F.nullif(strip(F.coalesce(rest, s)), F.lit("")), s)


def number_from_name(name: Column) -> Column:
    """After "Lecture" or "L", anywhere; else the day of a leading MMDD."""
    s = stem(name)
    said = extract(s, r"(?:Lecture|L)\s*(\d+)", 1, "(?iuU)").cast("int")
    month, day = extract(s, r"^(\d{2})\d{2}").cast("int"), extract(s, r"^\d{2}(\d{2})").cast("int")
    return F.coalesce(said, F.when(month.between(1, 12) & day.between(1, 31), day))


def subtitle(date: Column, number: Column, author: str) -> Column:
    d = F.dayofmonth(date)
    ending = F.when(d.isin(1, 21, 31), "st").when(d.isin(2, 22), "nd").when(d.isin(3, 23), "rd").otherwise("th")
    year = F.year(date).cast("string")
    full = F.concat(F.lit("Lecture "), number.cast("string"), F.lit(" given on "), d.cast("string"), ending, F.lit(" of "), F.date_format(date, "MMMM"), F.lit(" "), year, F.lit(f" by {author}"))
    dated = F.concat(F.date_format(date, "EEEE"), F.lit(", "), d.cast("string"), F.lit(" "), F.date_format(date, "MMMM"), F.lit(" "), year, F.lit(f"\nby {author}"))
    numbered = F.concat(F.lit("Lecture "), number.cast("string"), F.lit(f" by {author}"))
    known = number.isNotNull() & (number != 0)
    return F.when(date.isNotNull() & known, full).when(date.isNotNull(), dated).when(known, numbered).otherwise(f"by {author}")


def format_duration(seconds: Column) -> Column:
    """1h 30m 45.26s; null stays null, over a year counts as nothing, below zero as zero."""
    s = F.bround(F.greatest(seconds.cast("double"), F.lit(0.0)), 2)
    h, m, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), F.format_string("%.2f", s % 60)
    short = F.concat(m.cast("string"), F.lit("m "), rest, F.lit("s"))
    return F.when(seconds.isNull(), None).when(seconds > YEAR_SECONDS, "0m 0.00s").when(h > 0, F.concat(h.cast("string"), F.lit("h "), short)).otherwise(short)


def format_minutes(seconds: Column) -> Column:
    s = F.bround(F.greatest(seconds.cast("double"), F.lit(0.0)), 2)
    out = F.concat(F.format_string("%02d", F.floor(s / 60).cast("long")), F.lit(":"), F.format_string("%05.2f", s % 60))
    return F.when(seconds.isNull(), None).when(seconds > YEAR_SECONDS, "00:00").otherwise(out)


def format_clock(seconds: Column) -> Column:
    """HH:MM:SS without fractions; hours may exceed 24."""
    s = seconds.cast("long")
    out = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60)))
    return F.when(seconds.isNull(), None).when(s > YEAR_SECONDS, "00:00:00").otherwise(out)


def format_size(n: Column) -> Column:
    """Bytes with one decimal in the largest unit below 1024, TB at most."""
    size, out = n.cast("double"), None
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        one = F.format_string(f"%.1f {unit}", F.bround(size / 1024**k, 1))
        out = F.when(size < 1024 ** (k + 1), one) if out is None else out.when(size < 1024 ** (k + 1), one)
    return F.when(n.isNull(), None).otherwise(out.otherwise(F.format_string("%.1f TB", F.bround(size / 1024**4, 1))))


def header_source(text: Column) -> Column:
    """The path of the first line "Source:"; null if there is none or it is empty."""
    line = F.get(F.filter(F.split(text, "\n"), lambda l: F.startswith(l, F.lit("Source:"))), F.lit(0))
    return F.nullif(strip(F.substr(line, F.lit(8))), F.lit(""))


def body(text: Column) -> Column:
    """Without all "Source:" and "Output:" lines and without leading line ends."""
    kept = F.filter(F.split(text, "\n"), lambda l: ~(F.startswith(l, F.lit("Source:")) | F.startswith(l, F.lit("Output:"))))
    return F.regexp_replace(F.array_join(kept, "\n"), "^\n+", "")
