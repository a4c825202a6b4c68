"""Small native text helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes, and those that end a line.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      "
              "          　")
LINE_END = r"(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85  ])|(?<=\r)(?!\n)"
OTHER_END = "[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def is_ascii(c: Column) -> Column:
    """True when bytes and characters agree, i.e. no multi-byte character."""
    return F.octet_length(c) == F.char_length(c)


def words(array: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in array])


def one_of(c: Column, values: list[str]) -> Column:
    return c.isin(*values)


def split_feeds(text: Column) -> Column:
    """Lines with their line feed, the only end they know; the last line has none and may be empty."""
    def ended(parts):
        last = F.size(parts) - 1
        return F.transform(parts, lambda x, i: F.when(i < last, F.concat(x, F.lit("\n"))).otherwise(x))
    return bound(F.split(text, "\n"), ended)


def split_lines(text: Column) -> Column:
    """Lines with their terminators; no empty tail after a final terminator."""
    def whole(parts):
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    # Most texts know one terminator, which splits without looking around at every character.
    return F.when(~text.rlike(OTHER_END), bound(split_feeds(text), whole)).otherwise(bound(F.split(text, LINE_END), whole))


def word_ngrams(tokens: Column, sizes: list[int]) -> Column:
    """Every run of consecutive words of the given sizes, space joined, distinct."""
    def runs(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.sequence(F.lit(0), F.size(tokens) - n)
        return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.concat_ws(
            " ", *[F.get(tokens, i + k) for k in range(n)]))
        ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[runs(n) for n in sizes]))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def evaluated(df, name: str, value: Column):
    """Add a costly column that later filters will not repeat.

    A filter on a plain column is pushed below the projection that makes it, with
    the whole expression copied once per mention. A generated column stays put.
    """
    return df.withColumn(name, F.explode(F.array(value)))
