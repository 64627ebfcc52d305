"""Date, formatting and display functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.schema import UNKNOWN_AUTHOR

MICROS_PER_DAY = 86_400_000_000.0


def as_of_column(as_of: datetime | str | Column) -> Column:
    """The explicit "now" of a job as a timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def days_before(as_of, days: int | float) -> Column:
    micros = F.unix_micros(as_of_column(as_of)) - F.lit(int(days * MICROS_PER_DAY))
    return F.timestamp_micros(micros)


def age_days(ts: Column, as_of) -> Column:
    """Age in fractional days."""
    return (F.unix_micros(as_of_column(as_of)) - F.unix_micros(ts)) / F.lit(MICROS_PER_DAY)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def datetime_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def feed_date(text: Column) -> Column:
    """Parse an RFC 822 or ISO 8601 date; anything else gives null.

    The weekday is dropped because Spark's parser rejects it. Zone names and
    numeric offsets are both tried.
    """
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    bare = F.regexp_replace(bare, r"\s+", " ")
    candidates = [
        F.try_to_timestamp(bare, F.lit(pattern))
        for pattern in (
            "d MMM yyyy HH:mm:ss Z",
            "d MMM yyyy HH:mm:ss z",
            "d MMM yyyy HH:mm Z",
            "d MMM yyyy HH:mm z",
            "d MMM yy HH:mm:ss Z",
            "d MMM yyyy HH:mm:ss",
        )
    ]
    return F.coalesce(*candidates, F.expr("try_cast(null as timestamp)"), bare.try_cast("timestamp"))


def since(age: Column, as_of) -> Column:
    """Human readable age of something ``age`` days old."""
    moment = F.timestamp_micros(
        F.unix_micros(as_of_column(as_of)) - F.round(age * F.lit(MICROS_PER_DAY)).cast("long")
    )
    return (
        F.when(age.isNull() | (age == 0), F.lit("never"))
        .when(age < 2.0 / 24, F.concat((age * 24.0 * 60.0).cast("int").cast("string"), F.lit(" minutes ago")))
        .when(age < 1.0, F.concat((age * 24.0).cast("int").cast("string"), F.lit(" hours ago")))
        .when(age < 2.0, F.lit("one day ago"))
        .when(age < 3.0, F.concat(age.cast("int").cast("string"), F.lit(" days ago")))
        .otherwise(F.date_format(moment, "yyyy-MM-dd"))
    )


# The five entities XML defines.
XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_text(text: Column) -> Column:
    """Escape for XML: five entities, and numeric ones for U+0080 to U+00FF."""
    out = text
    for char, entity in XML_ENTITIES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    latin = F.transform(
        F.split(out, ""),
        lambda c: F.when(
            (c >= F.lit("\u0080")) & (c <= F.lit("ÿ")),
            F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";")),
        ).otherwise(c),
    )
    # Most text has no such character, so the per-character pass is rare.
    return F.when(out.rlike("[\\x{80}-\\x{ff}]"), F.array_join(latin, "")).otherwise(out)


def display_author(author: Column) -> Column:
    return F.replace(author, F.lit('"'), F.lit("'"))


def tag_label(tags: Column, author: Column) -> Column:
    """Sorted tags followed by the author, or ``(no tags)``."""
    named = F.when(F.coalesce(author, F.lit("")).isin("", UNKNOWN_AUTHOR), None).otherwise(
        display_author(author)
    )
    parts = F.array_compact(
        F.concat(F.array_sort(F.coalesce(tags, F.array().cast("array<string>"))), F.array(named))
    )
    return F.when(F.size(parts) == 0, F.lit("(no tags)")).otherwise(F.array_join(parts, " "))


def share_author(author: Column, feed_title: Column) -> Column:
    return F.when(author == UNKNOWN_AUTHOR, feed_title).otherwise(author)


def share_title(feed_title: Column, title: Column) -> Column:
    return F.concat(feed_title, F.lit(": "), title)


def feed_flags(status: Column, private: Column, exempt: Column, feed_filter: Column) -> Column:
    return F.concat_ws(
        ", ",
        F.when(status == 1, "suspended"),
        F.when(private, "private"),
        F.when(exempt, "exempt"),
        F.when(feed_filter.isNotNull(), "filtered"),
    )


def error_level(errors: Column) -> Column:
    return F.when(errors > 10, "error").when(errors > 0, "small-error").otherwise("")


def snr_percent(snr: Column) -> Column:
    return (F.lit(100) * snr).cast("int")


def fix_scheme(url: Column) -> Column:
    return F.replace(url, F.lit("feed://"), F.lit("http://"))


def clean_desc(text: Column) -> Column:
    """Subscription description: tags dropped, then quote, ampersand and copyright."""
    out = F.regexp_replace(text, "<[^>]*>", "")
    for old, new in (('"', "&quot;"), ("& ", "&amp; "), ("©", "&copy;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def tags_json(tags: Column) -> Column:
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))
