"""Page figures, money, dates, snippets and scene numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions.text import strip


def pages(characters: Column) -> Column:
    """A page estimate from length; halves round to even."""
    return F.greatest(F.lit(1), F.bround(characters / vocab.CHARS_PER_PAGE).cast("long"))


def page_of(offset: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(offset / vocab.CHARS_PER_PAGE) + 1)


def runtime(page_count: Column) -> Column:
    minutes = F.greatest(F.lit(0), page_count)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return (F.when((hours > 0) & (rest > 0), F.concat(hours, F.lit("h "), rest, F.lit("m")))
            .when(hours > 0, F.concat(hours, F.lit("h")))
            .otherwise(F.concat(rest, F.lit("m"))))


def eighths(characters: Column) -> Column:
    total = F.greatest(F.lit(1), F.bround(characters / (vocab.CHARS_PER_PAGE / 8)).cast("long"))
    whole, part = F.floor(total / 8), total % 8
    return (F.when((whole > 0) & (part > 0), F.concat(whole, F.lit(" "), part, F.lit("/8")))
            .when(whole > 0, whole.cast("string"))
            .otherwise(F.concat(part, F.lit("/8"))))


def cost_display(cost: Column) -> Column:
    # A decimal pattern rounds the exact binary value, as the ledger's display does.
    return (F.when(cost >= 0.01, F.concat(F.lit("$"), F.call_function(
                "format_number", cost, F.lit("0.00"))))
            .when(cost >= 0.0001, F.concat(F.lit("$"), F.call_function(
                "format_number", cost, F.lit("0.0000"))))
            .when(cost > 0, F.lit("under $0.0001"))
            .when(cost.isNotNull(), F.lit("$0.00")))


def when_label(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM HH:mm")


def snippet(text: Column) -> Column:
    return F.when(F.char_length(text) <= 140, text).otherwise(
        F.concat(F.left(text, F.lit(137)), F.lit("…")))


def thread_title(message: Column) -> Column:
    """At most 48 characters, cut at the last word boundary that fits."""
    words = strip(F.regexp_replace(message, r"(?U)[\s\x1c-\x1f]+", " "))
    head = F.left(words, F.lit(48))
    cut = F.regexp_extract(head, r"^(.*) ", 1)
    return (F.when(words == "", "Untitled request")
            .when(F.char_length(words) <= 48, words)
            .otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit("…"))))


def first_line_card(text: Column) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(120))


def inserted_number(after: Column, first: Column, used: Column) -> Column:
    """the number of a scene inserted after ``after`` (or before ``first``).

    ``used`` is the array of numbers the script already prints.
    """
    letters = F.transform(F.sequence(F.lit(65), F.lit(90)), lambda i: F.char(i))
    behind = F.transform(letters, lambda x: F.concat(after, x))
    before = F.transform(F.sequence(F.lit(1), F.lit(26)),
                         lambda i: F.concat(F.repeat(F.lit("A"), i), first))
    candidates = F.when(F.coalesce(after, F.lit("")) == "", before).otherwise(behind)
    free = F.filter(candidates, lambda x: ~F.array_contains(used, x))
    return F.when(F.size(used) > 0, F.try_element_at(free, F.lit(1)))
