"""the type of a written line, from its marker or from what it follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline.functions import headings as H
from plotline.functions.text import strip

FORCED_HEADING = r"^\.[A-Za-z]"
WRITTEN_TRANSITION = r"^[A-Z0-9 .'-]+TO:$"
MAX_CUE = 40


def marker(text: Column) -> Column:
    """The type a leading marker states, or null."""
    return (F.when(text.startswith(">>"), "shot").when(text.startswith("@"), "character")
            .when(text.startswith("!"), "action").when(text.startswith('"'), "dialogue")
            .when(text.startswith(">") & ~text.endswith("<"), "transition")
            .when(text.startswith("[[") & text.endswith("]]"), "note"))


def unmarked(text: Column) -> Column:
    """The words of the line without its marker."""
    kind = marker(text)
    one = strip(F.substr(text, F.lit(2)))
    return (F.when(kind == "shot", strip(F.substr(text, F.lit(3))))
            .when(kind == "dialogue", strip(F.regexp_replace(one, '"$', "")))
            .when(kind == "note",
                  strip(F.substr(text, F.lit(3), F.greatest(F.char_length(text) - 4, F.lit(0)))))
            .when(kind.isNotNull(), one).otherwise(text))


def typed(text: Column, above: Column) -> Column:
    """struct(unit_type, words, refused) for a line written under a unit of type ``above``.

    ``above`` is null at the top of a scene.
    """
    kind, words = marker(text), unmarked(text)
    heading = H.is_heading(words) | words.rlike(FORCED_HEADING)
    in_speech = F.coalesce(above.isin("character", "dialogue", "parenthetical"), F.lit(False))
    opens = F.coalesce(above.isin("character", "parenthetical"), F.lit(False))
    capitals = words == F.upper(words)
    free = (F.when(words.startswith("(") & in_speech, "parenthetical")
            .when(words.rlike(WRITTEN_TRANSITION), "transition")
            .when(capitals & H.is_shot(words), "shot")
            .when(~opens & capitals & (F.char_length(words) <= MAX_CUE) & H.is_cue(words),
                  "character")
            .when(opens, "dialogue").otherwise("action"))
    unit_type = F.coalesce(kind, F.when(~heading, free))
    return F.struct(unit_type.alias("unit_type"),
                    F.when(unit_type == "character", F.upper(words)).otherwise(words)
                    .alias("words"),
                    (kind.isNull() & heading).alias("refused"))


def bracketed(text: Column) -> Column:
    body = strip(F.rtrim(F.ltrim(strip(text), F.lit("(")), F.lit(")")))
    return F.when(body != "", F.concat(F.lit("("), body, F.lit(")"))).otherwise(text)
