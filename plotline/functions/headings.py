"""Scene headings, character cues, inline cues, act and scene ordinals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions.text import bound, strip

# The line patterns of the screenplay and stage-play layouts.
HEADING = (r"(?iU)^(INT\.?/EXT\.?|EXT\.?/INT\.?|I/E\.?|INT\.?|EXT\.?|EST\.?)"
           r"(?=[\s.])\s*(.*)$")
SCENE_NUMBER = r"(?U)\s*#([\p{L}\p{N}_.\-]+)#\s*$"
TRANSITION = (r"^(?:[A-Z0-9 '\-]+\s+TO:|FADE (?:IN|OUT)[.:]?|CUT TO BLACK[.:]?|"
              r"SMASH CUT[.:]?|MATCH CUT[.:]?|END(?:\s+OF)?\s+MONTAGE)\s*$")
SHOT = (r"(?i)^(?:ANGLE ON|CLOSE ON|CLOSE UP|EXTREME CLOSE|WIDE ON|WIDE SHOT|POV|INSERT|"
        r"BACK TO|SERIES OF SHOTS|MONTAGE|INTERCUT|AERIAL|TRACKING)\b")
END_DIRECTION = r"(?i)^END(?:\s+OF)?\s+(?:INTERCUT|MONTAGE|FLASHBACK|DREAM|SERIES)\b"
CUE = (r"(?U)^([\p{L}\p{Nl}\p{No}][\p{L}\p{N}_ .'\-#&]*?)"
       r"((?:\s*\((?:[^)]*)\))*)\s*(\^)?\s*$")
INLINE_CUE = (r"^([A-Z0-9][A-Z0-9 '.\-]*?)(?:\.\s+(?=[A-Za-z\"'‘“])|\s*(?=\[))(\S.*)$")
ROMAN = r"[IVXLCDM]+"
ORDINALS = "FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH"
ACT = (r"(?i)^(?:ACT\s+(" + ROMAN + r"|\d+|ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN|"
       + ORDINALS + r")|(" + ORDINALS + r")\s+ACT)\b\s*(.*)$")
STAGE_SCENE = r"(?i)^SCENE(?:\s+(" + ROMAN + r"|\d+))?\s*([.\-:—])?\s*(.*)$"
STAGE_DIRECTION = (r"(?i)^_?(?:Enter|Exit|Exeunt|Re-enter|Re-enters|Manet|Manent|Curtain|"
                   r"The\s+Curtain|End\s+of|The\s+End|Finis)\b")


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def is_transition(line: Column) -> Column:
    # Every form holds one of these; few lines do, and looking for them is cheap.
    some = F.contains(line, F.lit("TO:"))
    for sign in ("FADE", "CUT", "MONTAGE"):
        some = some | F.contains(line, F.lit(sign))
    return some & line.rlike(TRANSITION)


def is_shot(line: Column) -> Column:
    return line.rlike(SHOT)


def scene_number(heading: Column) -> Column:
    number = F.regexp_extract(heading, SCENE_NUMBER, 1)
    return F.when(number != "", number)


def without_number(heading: Column) -> Column:
    return strip(F.regexp_replace(heading, SCENE_NUMBER, ""))


def split_heading(heading: Column) -> Column:
    """struct(int_ext, location, time_of_day); nothing is inherited."""
    text = F.regexp_replace(strip(heading), SCENE_NUMBER, "")
    matched = is_heading(text)
    prefix = F.rtrim(F.upper(F.regexp_extract(text, HEADING, 1)), F.lit("."))
    int_ext = F.when(prefix.isin("I/E", "EXT/INT"), "INT/EXT").otherwise(prefix)
    rest = strip(F.regexp_extract(text, HEADING, 2))
    tail = F.upper(F.rtrim(strip(F.substring_index(rest, " - ", -1)), F.lit(".")))
    timed = F.contains(rest, F.lit(" - ")) & tail.isin(*vocab.TIMES_OF_DAY)
    head = strip(F.left(rest, F.char_length(rest)
                        - F.char_length(F.substring_index(rest, " - ", -1)) - 3))
    location = F.when(timed, head).otherwise(rest)
    return F.struct(
        F.when(matched, int_ext).alias("int_ext"),
        F.nullif(F.when(matched, location).otherwise(text), F.lit("")).alias("location"),
        F.when(matched & timed, tail).alias("time_of_day"))


def _cue(line: Column, found) -> Column:
    """``found(text, name)`` of a line that is a cue, else null; each step of the test is worked out once."""
    def named(text):
        name = bound(F.regexp_extract(text, CUE, 1), lambda raw: F.btrim(F.rtrim(
            F.btrim(strip(raw), F.lit("_")), F.lit(".")), F.lit("_")))
        plain = (text != "") & (text == F.upper(text)) & ~is_heading(text) & ~is_transition(text)
        # Without a match the name is empty and has no letter.
        return F.when(plain, bound(name, lambda n: F.when(n.rlike(r"\p{L}"), found(text, n))))
    return bound(strip(line), named)


def cue(line: Column) -> Column:
    """struct(name, extension, dual), or null when the line is not a cue."""
    def parts(text, name):
        extension = F.when(F.contains(text, F.lit("(")), bound(
            strip(F.regexp_extract(text, CUE, 2)), lambda said: F.nullif(said, F.lit(""))))
        dual = F.when(F.contains(text, F.lit("^")), F.regexp_extract(text, CUE, 3) != "").otherwise(False)
        return F.struct(name.alias("name"), extension.alias("extension"), dual.alias("dual"))
    return _cue(line, parts)


def is_cue(line: Column) -> Column:
    """The test half of F5, without building the struct."""
    test = F.coalesce(_cue(line, lambda text, name: F.lit(True)), F.lit(False))
    return F.when(line.isNotNull(), test)


def _inline_once(text: Column, found) -> Column:
    """``found(raw, name, speech)`` of one split of the line, else null; the pattern's first group is never empty."""
    def named(raw):
        name = strip(F.btrim(F.rtrim(F.btrim(strip(raw), F.lit("_")), F.lit(".")), F.lit("_")))
        return F.when(raw != "", bound(name, lambda n: found(raw, n, strip(F.regexp_extract(text, INLINE_CUE, 2)))))
    return bound(F.regexp_extract(text, INLINE_CUE, 1), named)


def _inline_name_ok(name: Column) -> Column:
    def few(parts):
        return F.size(parts).between(1, 5) & ~F.arrays_overlap(parts, F.array(F.lit("SCENE"), F.lit("ACT")))
    return (F.char_length(name).between(2, 35) & name.rlike(r"\p{L}")
            & bound(F.filter(F.split(name, r"\s+"), lambda w: w != ""), few))


def inline_cue(line: Column) -> Column:
    """struct(name, speech) of "NAME. words" or "NAME [dir] words", else null.

    A title such as MRS ends in a period without ending the name, so the text
    after it is split once more on its own.
    """
    def pair(name, speech):
        return F.struct(name.alias("name"), speech.alias("speech"))

    def split(text):
        def found(raw, name, speech):
            after_title = F.ltrim(F.substring(text, F.char_length(raw) + 1, 1 << 30), F.lit(". "))

            def inner(_, inner_name, inner_speech):
                joined = F.concat(name, F.lit(". "), inner_name)
                return F.when(_inline_name_ok(inner_name) & _inline_name_ok(joined), pair(joined, inner_speech))
            titled = F.upper(name).isin(*vocab.TITLE_ABBREVIATIONS)
            return F.when(titled, bound(after_title, lambda rest: F.when(
                rest.rlike(INLINE_CUE), _inline_once(strip(rest), inner)))).when(_inline_name_ok(name), pair(name, speech))
        return _inline_once(text, found)
    return bound(strip(line), split)


def ordinal(token: Column) -> Column:
    """a roman numeral, arabic numeral or number word as an integer."""
    t = strip(token)
    by_word = F.create_map(*[F.lit(x) for kv in vocab.WORD_ORDINALS.items() for x in kv])
    by_digit = F.create_map(*[F.lit(x) for kv in vocab.ROMAN_DIGITS.items() for x in kv])
    digits = F.reverse(F.filter(F.split(F.upper(t), ""), lambda d: d != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("high"))

    def step(acc, digit):
        value = by_digit[digit]
        return F.struct(
            (acc["total"] + F.when(value < acc["high"], -value).otherwise(value)).alias("total"),
            F.greatest(acc["high"], value).alias("high"))
    roman = F.aggregate(digits, start, step, lambda acc: acc["total"])
    return (F.when(t.rlike(r"^\d+$"), t.try_cast("int"))
            .when(F.lower(t).isin(*vocab.WORD_ORDINALS), by_word[F.lower(t)])
            .when(F.upper(t).rlike("^" + ROMAN + "$"), F.nullif(roman, F.lit(0))))


def act_ordinal(line: Column) -> Column:
    """struct(matched, ordinal) for an act heading."""
    text = strip(line)
    token = F.coalesce(F.nullif(F.regexp_extract(text, ACT, 1), F.lit("")),
                       F.regexp_extract(text, ACT, 2))
    return F.struct(text.rlike(ACT).alias("matched"), ordinal(token).alias("ordinal"))


def stage_scene(line: Column) -> Column:
    """struct(matched, ordinal, setting) for a stage-play scene heading."""
    text = strip(line)
    token = F.regexp_extract(text, STAGE_SCENE, 1)
    rest = strip(F.regexp_extract(text, STAGE_SCENE, 3))
    sep = F.regexp_extract(text, STAGE_SCENE, 2)
    matched = (text.rlike(STAGE_SCENE) & ~text.startswith("scene")
               & ((token != "") | (sep != "") | (rest == "")))
    return F.struct(matched.alias("matched"), ordinal(token).alias("ordinal"),
                    rest.alias("setting"))


def location_of(setting: Column) -> Column:
    """F8: whole sentences of a setting, stopping once a place is named."""
    text = strip(F.btrim(strip(setting), F.lit("[]_ ")))
    text = F.regexp_replace(text, r"(?i)^(?:THE\s+)?(?:SAME\s+)?SCENE\b[.\-:—\s]*", "")
    parts = F.split(text, r"(?<=[.!?])\s+")
    start = F.struct(F.lit("").alias("place"), F.lit(False).alias("done"))

    def step(acc, part):
        candidate = strip(F.concat(acc["place"], F.lit(" "), strip(part)))
        stop = acc["done"] | ((acc["place"] != "") & (F.char_length(candidate) > 120))
        place = F.when(stop, acc["place"]).otherwise(candidate)
        two = F.size(F.filter(F.split(place, r"\s+"), lambda w: w != "")) >= 2
        return F.struct(place.alias("place"), (stop | two).alias("done"))
    place = F.aggregate(parts, start, step, lambda acc: acc["place"])
    place = F.when(place != "", place).otherwise(F.left(text, F.lit(120)))
    return strip(F.rtrim(strip(place), F.lit(".")))
