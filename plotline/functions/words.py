"""Word sets, endpoint order, coercions and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import names
from plotline.functions.text import words

NOT_WORD = r"[^0-9a-z]+"
# The phrases that mark a finding written in the older voice.
ARGUED = ["contradicts", "the established", "conflicts with"]


def tokens(text: Column) -> Column:
    """The words of an already folded text."""
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def spaced(text: Column) -> Column:
    """The blank-separated pieces of a text."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def content_terms(question: Column) -> Column:
    stop = words(vocab.STOPWORDS)
    return F.filter(F.split(names.fold(question), NOT_WORD),
                    lambda w: (F.char_length(w) > 2) & ~F.array_contains(stop, w))


def edge_words(text: Column) -> Column:
    """Words of a labelled edge; a predicate's underscores split like spaces."""
    return F.array_distinct(tokens(F.translate(names.fold(text), "_", " ")))


def significant(label: Column) -> Column:
    """Case-folded letter runs of four and more."""
    found = F.regexp_extract_all(label, F.lit(r"([\p{L}\p{Nl}\p{No}]{4,})"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def extends_name(shorter: Column, longer: Column) -> Column:
    """F16: one word list is a proper prefix of the other."""
    return ((F.size(shorter) > 0) & (F.size(shorter) < F.size(longer))
            & (F.slice(longer, F.lit(1), F.greatest(F.size(shorter), F.lit(1))) == shorter))


def first_endpoint(predicate: Column, subject: Column, obj: Column) -> Column:
    """the subject after ordering a symmetric edge by string form."""
    swap = predicate.isin(*vocab.SYMMETRIC_PREDICATES) & (
        subject.cast("string") > obj.cast("string"))
    return F.when(swap, obj).otherwise(subject)


def second_endpoint(predicate: Column, subject: Column, obj: Column) -> Column:
    swap = predicate.isin(*vocab.SYMMETRIC_PREDICATES) & (
        subject.cast("string") > obj.cast("string"))
    return F.when(swap, subject).otherwise(obj)


def confidence(raw: Column, low: float) -> Column:
    """a JSON number in [low, 1]; a boolean, a string or anything else is null."""
    kind = F.schema_of_variant(raw)
    number = F.try_variant_get(raw, "$", "double")
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(numeric & number.between(low, 1.0), number)


def span_ok(start: Column, end: Column, text: Column) -> Column:
    """Both offsets, in range and not empty."""
    return F.coalesce((start >= 0) & (start < end) & (end <= F.char_length(text)), F.lit(False))


def quoted(start: Column, end: Column, text: Column) -> Column:
    return F.when(span_ok(start, end, text), F.substring(text, start + 1, end - start))


def kept_share(old_words: Column, new_words: Column) -> Column:
    """The share of the old line's distinct words the new line keeps."""
    old = F.array_distinct(old_words)
    return F.size(F.array_intersect(old, new_words)) / F.nullif(F.size(old), F.lit(0))


def reads_as_argued(message: Column) -> Column:
    return F.lower(message).rlike("|".join(ARGUED))
