"""Text and date columns of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorage.settings import LEAST_LINK_WORDS


def truncate_words(text: Column, limit: int, keep_end: bool) -> Column:
    """At most ``limit`` characters from one end, cut between words where a space allows it."""
    if keep_end:
        cut = F.right(text, F.lit(limit))
        place = F.locate(" ", cut)
        shorter = F.when(place > 0, F.substring(cut, place + 1, F.lit(limit))).otherwise(cut)
    else:
        cut = F.left(text, F.lit(limit))
        shorter = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, "(?s) [^ ]*$", "")).otherwise(cut)
    return F.when(F.char_length(text) <= limit, text).otherwise(shorter)


def percent_encode(text: Column) -> Column:
    """Everything but unreserved characters percent-encoded, and hyphens as well, as text fragments want it."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("-", "%2D"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))


def deep_link(page_url: Column, day: Column, text: Column, before: Column, after: Column) -> Column:
    """Where on a page a link stands: its section, and its text with what surrounds it if that is enough to find it.

    The text is used when there is link text and it has, with its
    surroundings, five words or more.
    """
    has = lambda c: c.isNotNull() & (c != "")
    words = word_count(text) + word_count(before) + word_count(after)
    fragment = F.concat(
        F.lit(":~:text="),
        F.when(has(before), F.concat(percent_encode(before), F.lit("-,"))).otherwise(""),
        percent_encode(text),
        F.when(has(after), F.concat(F.lit(",-"), percent_encode(after))).otherwise(""),
    )
    section = F.when(has(day), day).otherwise("")
    anchor = F.when(has(text) & (words >= LEAST_LINK_WORDS), F.concat(section, fragment)).otherwise(section)
    return F.when(anchor == "", page_url).otherwise(F.concat(page_url, F.lit("#"), anchor))


def day_number(day: Column) -> Column:
    """Number behind the first three characters of a section's name; 0 where there is no number, null for no section."""
    digits = F.regexp_extract(F.substring(day, 4, 1 << 20), r"^\s*([0-9]+)", 1)
    return F.when(day != "", F.coalesce(F.try_to_number(digits, F.lit("9999999999")).cast("bigint"), F.lit(0).cast("bigint")))


def trimmed_lower(text: Column) -> Column:
    """Lower case without spaces at the ends."""
    return F.trim(F.lower(text))


def text_display(text: Column) -> Column:
    """Link text, or a placeholder where there is none."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("(no link text)"))


def day_display(label: Column, day: Column) -> Column:
    """A section's label, or else its name; null for neither."""
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(day, F.lit("")))


def pluralized(n: Column, word: str) -> Column:
    """A count with its noun."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def occurrence_id(page_url: Column, link_id: Column, day: Column) -> Column:
    return F.concat_ws("::", page_url, link_id.cast("string"), F.coalesce(day, F.lit("")))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago a time was, in the largest unit that fits: days, hours, minutes or seconds."""
    seconds = F.timestamp_diff("SECOND", then, now)
    out = F.concat(seconds.cast("string"), F.lit(" s ago"))
    for size, unit in ((60, "min"), (3600, "h"), (86400, "d")):
        out = F.when(F.abs(seconds) >= size, F.concat((seconds / size).cast("int").cast("string"), F.lit(f" {unit} ago"))).otherwise(out)
    return out
